"""The registered queries of the thirteen operators: each applies its operator,
with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, write the flat token files, read them back."""
    from storelens.llm.token_files import read_token_files, shared_folder, write_token_files

    out = shared_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path(VOCABULARY))
    return read_token_files(spark, out)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and whether over 2048 tokens, of every document."""
    from storelens.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=2048)


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from storelens.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the digest is of the base spans."""
    from storelens.llm.pii import find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
                        "spans", "n_added", "n_rejected")


@query
def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights 5, 2, 1."""
    from storelens.llm.mixing import entropy_mix

    return entropy_mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3).drop("mark")


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every document and of its edited text."""
    from storelens.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside fold 2 of 4."""
    from storelens.llm.langid import folded_languages

    return folded_languages(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned outside fold 0 of 5."""
    from storelens.llm.quality import folded_quality

    return folded_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from storelens.llm.near_copies import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it leaks."""
    from storelens.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document (a tenth of them made periodic)."""
    from storelens.llm.periodic import periodic_runs, planted

    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.withColumn("text", planted(F.col("text"), F.col("doc_id"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256)
        .alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 256 to 4096 tokens."""
    from storelens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False).drop("ids")


@query
def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids aligned with pieces, in every document."""
    from storelens.llm.alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("piece_bpe_32k.model")).drop("groups")
