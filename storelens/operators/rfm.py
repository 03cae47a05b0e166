"""Recency / frequency / monetary tables and rule scores.

RFM is one ``groupBy(customer)`` with algebraic aggregates (max, count, sum):
partial aggregation on the map side reduces even the hot "unknown customer"
key to one row per map task before the shuffle.  The per-customer table is
kept in the shared checkpoint folder; the as-of timestamp is read from it and
applied as a literal, so the lines are scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import money, ordered_when
from storelens.functions.sizing import cut_lineage


def rfm(df: DataFrame, customer: str = "customer_id", ts: str = "invoice_date",
        invoice: str = "invoice", amount: str = "total_amount", as_of: str | None = None,
        distinct_invoices: bool = False, by: list[str] | None = None) -> DataFrame:
    """Per-customer recency (whole 24 h periods), frequency, monetary.

    * recency = floor((as_of - last purchase) / 1 day); ``as_of`` defaults
      to the latest timestamp of the input table.
    * frequency = number of invoice lines (the reference counts lines), or
      distinct invoices with ``distinct_invoices=True``.
    * monetary = exact sum of the amounts (six decimals).

    With ``by`` (e.g. country) the table is computed per group, each group
    with its own latest timestamp as the as-of (the reference's one-country
    RFM, for every country at once).
    """
    keys = list(by or [])
    freq = F.countDistinct(invoice) if distinct_invoices else F.count(invoice)
    # kept in a table, so that the as-of needs no second pass over the lines
    per = cut_lineage(df.groupBy(*keys, customer).agg(
        F.max(ts).alias("_last"),
        freq.alias("frequency"),
        F.sum(money(amount)).cast("double").alias("monetary")))
    if as_of is None and keys:
        # one as-of per group (small: one row per group; AQE sizes the join)
        ref = per.groupBy(*keys).agg(F.max("_last").alias("_asof"))
        return per.join(ref, keys).select(
            *keys, F.col(customer),
            F.timestamp_diff("DAY", F.col("_last"), F.col("_asof")).cast("int").alias("recency"),
            F.col("frequency").cast("long").alias("frequency"), F.col("monetary"))
    # one value, applied as a literal
    latest = as_of if as_of is not None else per.agg(F.max("_last").cast("string")).first()[0]
    return per.select(
        *keys, F.col(customer),
        F.timestamp_diff("DAY", F.col("_last"), F.lit(latest).cast(df.schema[ts].dataType)).cast("int").alias("recency"),
        F.col("frequency").cast("long").alias("frequency"),
        F.col("monetary"))


def score_columns(r: Column, f: Column, m: Column, r_cut: float = 60, f_cut: float = 5,
                  m_cut: float = 200) -> tuple[Column, Column, Column]:
    """Reference score rules (R1).  r is 0..4 (5 - min(int(R/cut)+1, 5));
    f and m are 1..5.  ``int()`` truncates toward zero."""
    rs = F.lit(5) - F.least((r / F.lit(r_cut)).cast("int") + 1, F.lit(5))
    fs = F.least((f / F.lit(f_cut)).cast("int") + 1, F.lit(5))
    ms = F.least((m / F.lit(m_cut)).cast("int") + 1, F.lit(5))
    return rs, fs, ms


def rfm_scores(df: DataFrame, recency: str = "recency", frequency: str = "frequency",
               monetary: str = "monetary", r_cut: float = 60, f_cut: float = 5,
               m_cut: float = 200) -> DataFrame:
    """Add r_score, f_score, m_score and the text code ``"{r}{f}{m}"``."""
    rs, fs, ms = score_columns(F.col(recency), F.col(frequency), F.col(monetary), r_cut, f_cut, m_cut)
    out = df.withColumns({"r_score": rs, "f_score": fs, "m_score": ms})
    return out.withColumn("rfm_score", F.concat(F.col("r_score").cast("string"),
                                                F.col("f_score").cast("string"),
                                                F.col("m_score").cast("string")))


# Nine-way segment scheme of the reference notebook, in rule
# order: name, description, strategy.
NINE_SEGMENTS = [
    ("Champions", "Best customers who bought recently, buy often and spend the most",
     "Reward these customers. They can become ambassadors for your brand."),
    ("Loyal Customers", "Regular customers who spend well",
     "Engage with special offers and loyalty rewards to maintain their interest."),
    ("Big Spenders", "Customers who spend a lot but buy less frequently",
     "Incentivize them to shop more frequently with exclusive offers."),
    ("New Customers", "Recently acquired customers with lower spend",
     "Focus on onboarding and early relationship building."),
    ("At Risk Champions", "Previously valuable customers who haven't purchased recently",
     "Reactivation campaign to win them back with targeted offers."),
    ("At Risk Customers", "Once active customers who haven't purchased recently",
     "Re-engagement campaign with special discounts."),
    ("Lost Customers", "Customers who haven't purchased in a long time",
     "Deep discounts or win-back promotions to reactivate."),
    ("One-Time Big Spenders", "Made a significant purchase but haven't returned",
     "Follow-up with related products and incentives."),
    ("Standard Customers", "Average customers in terms of recency, frequency and monetary value",
     "Regular engagement to increase their value over time."),
]

# Eight-name scheme of the reference service, in rule order.
EIGHT_SEGMENTS = ["Champions", "Loyal Customers", "New Customers", "At-Risk Customers",
                  "Lost Customers", "Big Spenders", "At-Risk High Value", "Regular Customers"]


def _nine_conditions(r: Column, f: Column, m: Column) -> list[Column]:
    return [
        (r >= 4) & (f >= 4) & (m >= 4),
        (r >= 4) & (f >= 3) & (m >= 3),
        (r >= 3) & (f >= 1) & (m >= 4),
        (r >= 4) & (f <= 2) & (m <= 2),
        (r <= 2) & (f >= 4) & (m >= 4),
        (r <= 2) & (f >= 3),
        (r <= 2) & (f <= 2) & (m <= 2),
        (r <= 3) & (f <= 3) & (m >= 4),
    ]


def _eight_conditions(r: Column, f: Column, m: Column) -> list[Column]:
    return [
        (r >= 4) & (f >= 4) & (m >= 4),
        (r >= 4) & (f >= 3),
        (r >= 4) & (f <= 2),
        (r <= 2) & (f >= 3),
        (r <= 2) & (f <= 2) & (m <= 2),
        (m >= 4) & (f <= 2),
        (r <= 2) & (m >= 4),
    ]


def name_segments(df: DataFrame, scheme: str = "nine", r: str = "r_score", f: str = "f_score",
                  m: str = "m_score") -> DataFrame:
    """Ordered rule naming over score columns (R2 'nine', R3 'eight').

    'nine' adds segment, description and strategy; 'eight' adds segment and
    the ordering key r*100 + f*10 + m.
    """
    rc, fc, mc = F.col(r), F.col(f), F.col(m)
    if scheme == "nine":
        conds = _nine_conditions(rc, fc, mc)
        idx = ordered_when([(c, i) for i, c in enumerate(conds)], len(NINE_SEGMENTS) - 1)
        names = F.array(*[F.lit(s[0]) for s in NINE_SEGMENTS])
        descs = F.array(*[F.lit(s[1]) for s in NINE_SEGMENTS])
        strats = F.array(*[F.lit(s[2]) for s in NINE_SEGMENTS])
        return df.withColumn("_seg", idx + 1).withColumns({
            "segment": F.element_at(names, F.col("_seg")),
            "description": F.element_at(descs, F.col("_seg")),
            "strategy": F.element_at(strats, F.col("_seg")),
        }).drop("_seg")
    if scheme == "eight":
        conds = _eight_conditions(rc, fc, mc)
        seg = ordered_when([(c, EIGHT_SEGMENTS[i]) for i, c in enumerate(conds)], EIGHT_SEGMENTS[-1])
        return df.withColumns({"segment": seg, "rfm_rank_key": rc * 100 + fc * 10 + mc})
    raise ValueError(f"unknown scheme {scheme!r}")
