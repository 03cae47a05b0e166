"""Registry of named queries and their SQL oracles.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or
views Spark derives from them).  Its oracle, when the result is expressible
in SQL, is a DuckDB statement over the same tables; the fixture views it
uses are prefixed as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storelens.sources.fixtures import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _split_args(body: str) -> list[str]:
    out, depth, cur, quote = [], 0, "", False
    for ch in body:
        if ch == "'":
            quote = not quote
        if not quote:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                out.append(cur.strip())
                cur = ""
                continue
        cur += ch
    out.append(cur.strip())
    return out


def explicit_quantiles(sql: str) -> str:
    """Rewrite ``quantile_cont(x, p)`` as explicit linear interpolation.

    DuckDB interpolates with a fused multiply-add, which no Spark expression
    reproduces bit for bit; the oracle spells out ``lo + (hi - lo) * frac``
    over the sorted values instead (the same rule, pandas' linear method,
    in the arithmetic order of Spark's exact ``percentile``).
    """
    key = "quantile_cont("
    while key in sql:
        i = sql.index(key)
        j, depth = i + len(key), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        x, p = _split_args(sql[i + len(key):j - 1])
        xs = f"CAST({x} AS DOUBLE)"
        srt = f"list_sort(list({xs}) FILTER (WHERE {x} IS NOT NULL AND NOT isnan({xs})))"
        pos = f"(CAST({p} AS DOUBLE) * CAST(len({srt}) - 1 AS DOUBLE))"
        lo = f"{srt}[CAST(floor({pos}) AS BIGINT) + 1]"
        hi = f"{srt}[CAST(ceil({pos}) AS BIGINT) + 1]"
        expr = (f"(CASE WHEN floor({pos}) = ceil({pos}) OR {lo} = {hi} THEN {lo} ELSE "
                f"(CAST(ceil({pos}) AS DOUBLE) - {pos}) * {lo} + ({pos} - CAST(floor({pos}) AS DOUBLE)) * {hi} END)")
        sql = sql[:i] + expr + sql[j:]
    return sql


def explicit_rounding(sql: str) -> str:
    """Rewrite ``round(x, d)`` as ``round_even(x * 10^d, 0) / 10^d``.

    Spark rounds a double through its shortest decimal text, DuckDB through
    a scaled binary value; they disagree when that text ends in 5.  Scaling
    first and rounding half-even to an integer gives the same bits in both
    (the Spark side uses :func:`storelens.functions.exprs.py_round`).
    """
    out, i = [], 0
    pat = re.compile(r"(?<![A-Za-z_])round\(")
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        j, depth = m.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        args = _split_args(sql[m.end():j - 1])
        x = explicit_rounding(args[0])
        d = int(args[1]) if len(args) > 1 else 0
        rep = (f"round_even({x}, 0)" if d == 0 else
               f"(round_even(({x}) * {float(10 ** d)!r}, 0) / {float(10 ** d)!r})")
        out.append(sql[i:m.start()])
        out.append(rep)
        i = j


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: register ``fn`` under ``name`` with an optional oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = explicit_rounding(explicit_quantiles(
                with_views(sql, *views) if views else sql.strip()))
        return fn

    return deco
