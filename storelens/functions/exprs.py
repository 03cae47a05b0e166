"""Column-expression helpers (JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """``greatest(lo, least(hi, c))``."""
    out = col(c)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    return out


def trunc_int(c: Column) -> Column:
    """Python ``int(x)``: truncation toward zero."""
    return c.cast("int")


def ordered_when(cases: Sequence[tuple[Column, object]], default: object) -> Column:
    """First-match ``CASE WHEN`` (an ``if/elif/else`` chain)."""
    out = None
    for cond, val in cases:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def map_lookup(c: str | Column, mapping: Mapping, default: object = None) -> Column:
    """Value -> label through a literal map."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    looked = F.element_at(F.create_map(*items), col(c)) if items else F.lit(None)
    return looked if default is None else F.coalesce(looked, F.lit(default))


def any_substring(text: Column, words: Sequence[str]) -> Column:
    """True when any of ``words`` occurs as a substring of ``text``."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def count_substrings_present(text: Column, words: Sequence[str]) -> Column:
    """Number of distinct ``words`` that occur as substrings of ``text``."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def money(c: str | Column) -> Column:
    """Exact value with six decimals (order-independent sums); only what is
    shown is rounded further."""
    return col(c).cast("decimal(38,6)")


def exact_mean(c: str | Column, scale: int = 6) -> Column:
    """Mean of fixed-point values: exact decimal sum / count, one division.

    Independent of summation order, so every partitioning (and any other
    engine doing the same) gives the same double.
    """
    x = col(c)
    return F.sum(x.cast(f"decimal(38,{scale})")).cast("double") / F.count(x)


def py_round(c: str | Column, digits: int = 0) -> Column:
    """numpy's ``round(x, digits)`` for doubles, engine-independent: the scaled
    double is rounded half-even to an integer and scaled back, and every engine
    computes the same bits.  ``bround`` on a double rounds its shortest decimal
    text; Python's own ``round`` is :func:`python_round`.
    """
    if digits == 0:
        return F.bround(col(c), 0)
    k = float(10 ** digits)
    return F.bround(col(c) * F.lit(k), 0) / F.lit(k)


_SPLIT = float((1 << 27) + 1)


def python_round(c: str | Column, digits: int = 0) -> Column:
    """Python's ``round(x, digits)``: the exact binary value rounded half-even.

    The scaled value x * 10^digits is split into the nearest double and the error of
    that product (from products of 26-bit halves, which are exact); the error
    decides where the double itself is halfway (2.675 * 100 is 267.5, but 2.675 lies
    below).  The result is the double nearest to the rounded decimal.
    """
    x = col(c)
    if digits == 0:
        return F.bround(x, 0)
    k = float(10 ** digits)
    k_high = k * _SPLIT - (k * _SPLIT - k)
    k_low = k - k_high
    wide = x * F.lit(_SPLIT)
    high = wide - (wide - x)
    low = x - high
    p = x * F.lit(k)
    error = ((high * F.lit(k_high) - p) + high * F.lit(k_low) + low * F.lit(k_high)) + low * F.lit(k_low)
    down = F.floor(p).cast("double")
    part = p - down
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(down, F.lit(2.0)) == 1.0))))
    return F.when(F.abs(p) >= float(1 << 52), x).otherwise(F.when(up, down + 1.0).otherwise(down) / F.lit(k))


def py_round_sql(x: str, digits: int = 0) -> str:
    """The SQL (DuckDB) spelling of :func:`py_round`."""
    if digits == 0:
        return f"round_even({x}, 0)"
    k = float(10 ** digits)
    return f"(round_even(({x}) * {k!r}, 0) / {k!r})"
