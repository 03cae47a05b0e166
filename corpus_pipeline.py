"""A training corpus from documents: quality, near copies, test items, mixture,
token files.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents.  Each stage works on
every row that the stages before it kept:

  quality    rows that the positive-unlabelled classifier scores under 0.3 go
  near       one document of each near-duplicate class stays
  clean      documents that leak a benchmark item go
  mix        rows are repeated (or left out) as the source weights ask
  tokens     all texts become token files; the result is the files' digest

Nulls: a null text counts as empty; rows without an id are told apart by their
texts in near, else they are one document; null sources are a source of their own.  Empty tables pass through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from storelens.llm.base import table
from storelens.llm.decontaminate import drop_leaks
from storelens.llm.mixing import mixed_rows
from storelens.llm.near_copies import drop_near_duplicates
from storelens.llm.quality import drop_rejected, fit
from storelens.llm.token_files import read_token_files, shared_folder, write_token_files
from storelens.session import ensure_checkpoint_dir, ship_package

VOCABULARY = "word_bpe_49k.json"


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    _ready(spark)
    return drop_rejected(docs, fit(docs, table(spark, sf_dir, "labels"), held=None), threshold=0.3)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    _ready(spark)
    return drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    _ready(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights 5, 2, 1 ask."""
    _ready(spark)
    return mixed_rows(docs, weights=(5, 2, 1), cap=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the written token files."""
    _ready(spark)
    out = shared_folder(spark, "pipeline-tokens")
    write_token_files(docs, out, public_tokenizers.path(VOCABULARY))
    return read_token_files(spark, out)


STAGES = [("quality", quality), ("near", near), ("clean", clean), ("mix", mix), ("tokens", tokens)]

#: Signatures, a fitted model and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
