"""Mixing sources to target weights by entropy balancing (operator 9).

Sources in code-point order (null last) weigh ``weights``, repeating, and share
all tokens of the input; a target stops at ``cap`` times its source's size and
the excess is shared again by weight.  The document rates that meet the targets
and stay closest (in relative entropy over tokens) to their prior rates are
exponentially tilted: rate = min(cap, prior * exp(lambda of the source)).  The
lambdas solve the convex dual by Newton steps; each step is one distributed
aggregate over (source, prior) cells, and the state stays in a table.

Rates become whole copies by error feedback: within a chunk of a source (a
hash of id and text, about ``chunk_docs`` each, so that a hot source is split)
documents go from the largest down, and each takes the number of copies that
brings the words taken so far closest to the rates' words, from 0 to cap.  What
a chunk misses is then at most about half of its smallest documents.

A document's size is its number of ``[^\\x20\\x09-\\x0D]+`` runs; null text: 0.  An
empty document takes 0.  Repeated rows: each counts as a document.  An empty
table: an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.sizing import cut_lineage

#: Most sources whose rows (about 100 bytes each) are broadcast.
SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source with its ``target`` (``sizes``: source, source_size).

    With the sources in ascending order of size per weight, those before some
    place are held at their caps and the rest share what is left by weight;
    the place is the first one that its own share doesn't lift above its cap.
    """
    every = Window.partitionBy()
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    order = Window.orderBy(F.col("ratio"), F.col("rank"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("rank", F.row_number().over(named) - 1).withColumn("weight", weight)
              .withColumn("ratio", F.col("source_size") / F.col("weight"))
              .withColumn("total", F.sum("source_size").over(every)))
    left = F.col("total") - cap * F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                             F.lit(0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    shared = ranked.withColumn("level", level).withColumn(
        "level", F.min(F.when(cap * F.col("source_size") >= F.col("weight") * F.col("level"),
                              F.struct("ratio", "rank", "level"))).over(every)["level"])
    most = (cap * F.col("source_size")).cast("double")
    return shared.select("source", "source_size", F.least(most, F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
                         .alias("target"))


def tilt(cells: DataFrame, targets: DataFrame, cap: float = 3.0, tolerance: float = 1e-12, steps: int = 200) -> DataFrame:
    """Newton's method on the dual: source, source_size, target and ``tilt``
    (lambda).  ``cells``: source, prior, tokens."""
    state = cut_lineage(targets.withColumn("tilt", F.lit(0.0)))
    sources = state.count()
    inside = F.col("prior") * F.exp("tilt") < cap
    rate = F.least(F.lit(cap), F.col("prior") * F.exp("tilt"))
    for _ in range(steps):
        joined = cells.alias("c").join(state.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        moments = joined.groupBy(F.col("t.source").alias("source"), "source_size", "target", "tilt").agg(
            F.sum(F.col("tokens") * rate).alias("gain"), F.sum(F.when(inside, F.col("tokens") * rate)).alias("slope"))
        gap = F.col("target") - F.col("gain")
        # a step beyond all caps has no slope: come back towards them
        step = F.when(F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0)), 0.0).when(
            F.coalesce("slope", F.lit(0.0)) > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / F.col("slope")))
        ).otherwise(F.when(gap < 0, -0.5).otherwise(0.0))
        state = cut_lineage(moments.withColumn("step", step).select(
            "source", "source_size", "target", (F.col("tilt") + F.col("step")).alias("tilt"), "step"), rows=sources)
        if not state.where(F.abs("step") > 1e-14).agg(F.count("*")).first()[0]:
            break
        state = state.drop("step")
    else:
        raise ArithmeticError(f"the targets are not met after {steps} steps")
    return state.select("source", "source_size", "target", "tilt")


def _copies(rows: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Error feedback over one chunk (``size`` and ``rate``), largest first."""
    rows = rows.sort_values(["size", "doc_id", "mark"], ascending=[False, True, True], kind="stable", na_position="first")
    owed, out = 0.0, np.zeros(len(rows), np.int64)
    for i, (size, rate) in enumerate(zip(rows["size"].to_numpy(), rows["rate"].to_numpy())):
        if size:
            owed += size * rate
            out[i] = min(cap, max(0, int(np.floor(owed / size + 0.5))))
            owed -= out[i] * size
    return rows.assign(copies=out)


def entropy_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, prior=None, chunk_docs: int = 128) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken (copies *
    size) and mark (the text's hash) of every document.  ``prior``: a column of
    prior rates; where it is one for all, a source's tilt has the closed form
    log(target / size), which Newton's steps find."""
    docs = cut_lineage(df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("mark"),
        (F.lit(1.0) if prior is None else prior.cast("double")).alias("prior")))
    cells = cut_lineage(docs.groupBy("source", "prior").agg(F.sum("size").alias("tokens"), F.count("*").alias("docs")))
    per_source = cells.groupBy("source").agg(F.sum("tokens").alias("source_size"), F.sum("docs").alias("docs"))
    state = tilt(cells, source_targets(per_source.select("source", "source_size"), weights, cap), float(cap))
    chunks = F.ceil(F.col("docs") / chunk_docs)
    known = cut_lineage(state.alias("t").join(per_source.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source"))).select(
        "t.*", chunks.alias("chunks")))
    # one short row a source: broadcast up to a checked number of them, so that a hot source's rows stay where they are
    known = F.broadcast(known) if known.count() <= SOURCES else known
    rated = docs.alias("d").join(known.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source"))).select(
        "d.doc_id", "d.mark", "d.source", "d.size", "k.source_size", "k.target",
        F.round(F.least(F.lit(float(cap)), F.col("d.prior") * F.exp("k.tilt")), 10).alias("rate"),
        # by id and text: rows without an id, or with the same one, are dealt too
        F.pmod(F.xxhash64(F.col("d.doc_id"), F.col("d.mark")), F.col("k.chunks")).alias("chunk"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, mark long, source string, size long, source_size long, target double, rate double, chunk long, "
              "copies long")
    taken = rated.groupBy("source", "chunk").applyInPandas(lambda rows: _copies(rows, cap), schema)
    return taken.select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"), "mark")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``df``, all columns, each as often as the mix takes it (rows
    that share an id and a text: as often as the one that the mix takes most)."""
    copies = entropy_mix(df, id_col, text_col, **parameters).where("copies > 0").groupBy(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.max("copies").alias("_copies"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_mark"))
    taken = df.join(cut_lineage(copies), same)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*df.columns)
