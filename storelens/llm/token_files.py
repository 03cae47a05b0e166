"""Token-id files (operator 6): flat unsigned integers with 64-bit offsets.

Layout under ``out_dir`` - one triple of files per partition, partitions in
ascending doc_id order:

  part-<p>.bin  the token ids of all its documents end to end, little-endian
                unsigned integers of ``width`` bytes (2 if the vocabulary
                fits, else 4)
  part-<p>.off  n + 1 little-endian unsigned 64-bit offsets into the .bin
                (in ids, from 0): document i is ids[off[i]:off[i + 1]]
  part-<p>.ids  n little-endian signed 64-bit document ids (null: the
                smallest value)
  manifest      one Parquet row per partition: part, n_docs, n_tokens, width

A partition's base - the number of ids before it - is the prefix sum of the
manifest's counts.  Texts are range-partitioned and sorted by (doc_id, text)
once, then encoded and written by the task that holds them, so ids are never
shuffled.  Each task writes under a name of its own and renames at the end:
a repeated or speculative attempt leaves the same whole files.

Null text: the empty text, just the end id.  Repeated rows: written each, by
(doc_id, text).  Null doc_id: first.  An empty table: no files, an empty result.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.llm.base import id_text, slices
from storelens.llm.tokens import id_width, worker_encoder
from storelens.session import ensure_checkpoint_dir

NULL_ID = np.iinfo(np.int64).min


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        pafs.LocalFileSystem(), folder)


def _local(folder: str) -> str | None:
    store, path = _open(folder)
    return path if isinstance(store, pafs.LocalFileSystem) else None


class _Writer:
    """One partition's files, written beside their final names and then renamed."""

    def __init__(self, folder: str, part: int):
        self.store, self.path = _open(folder)
        self.store.create_dir(self.path, recursive=True)
        self.names = {x: f"{self.path}/part-{part:06d}.{x}" for x in ("bin", "off", "ids")}
        self.mark = f".{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}-{uuid.uuid4().hex[:8]}"
        self.open = {x: self.store.open_output_stream(n + self.mark) for x, n in self.names.items()}
        self.n_docs = self.n_tokens = 0
        self.open["off"].write(np.zeros(1, "<u8").tobytes())

    def add(self, ids: np.ndarray, lengths: np.ndarray, encoded: list[bytes]) -> None:
        self.open["bin"].write(b"".join(encoded))
        self.open["off"].write((self.n_tokens + np.cumsum(lengths)).astype("<u8").tobytes())
        self.open["ids"].write(ids.astype("<i8").tobytes())
        self.n_docs += len(ids)
        self.n_tokens += int(lengths.sum())

    def commit(self) -> None:
        for x, f in self.open.items():
            f.close()
            self.store.move(self.names[x] + self.mark, self.names[x])


def write_token_files(df: DataFrame, out_dir: str, path: str, end_id: int | None = 2,
                      id_col: str = "doc_id", text_col: str = "text", cache_size: int = 1_000_000) -> DataFrame:
    """Write the files and the manifest; returns the manifest (see the module text)."""
    width = id_width(path, end_id)
    kind = f"<u{width}"
    tail = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def write(batches):
        writer = None
        encoder = worker_encoder(path, True, cache_size)
        for batch in batches:
            for part in slices(batch):
                writer = writer or _Writer(out_dir, TaskContext.get().partitionId())
                raw = [x.astype(kind).tobytes() + tail for x in encoder.ids(part.column(1).to_pylist())]
                ids = np.asarray(pa.compute.fill_null(part.column(0), NULL_ID), dtype=np.int64)
                writer.add(ids, np.array([len(e) // width for e in raw], np.int64), raw)
        if writer:
            writer.commit()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "n_docs": pa.array([writer.n_docs], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64()),
                "width": pa.array([width], pa.int32())})

    docs = id_text(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = ordered.mapInArrow(write, "part int, n_docs long, n_tokens long, width int")
    done.write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return docs.sparkSession.read.parquet(f"{out_dir}/manifest")


def bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: ids before each partition (one row a partition)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    store, path = _open(folder)
    full = f"{path}/{name}"
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(full, kind, mode="r") if os.path.getsize(full) else np.zeros(0, kind)
    with store.open_input_file(full) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) of each document in the files, and with ``with_ids`` the ids."""
    manifest = bases(spark.read.parquet(f"{out_dir}/manifest"))
    rows = 4096

    def read(batches):
        for batch in batches:
            for m in batch.to_pylist():
                stem, n = f"part-{m['part']:06d}", m["n_docs"]
                data = _mapped(out_dir, f"{stem}.bin", f"<u{m['width']}")
                offsets = _mapped(out_dir, f"{stem}.off", "<u8")
                ids = _mapped(out_dir, f"{stem}.ids", "<i8")
                if len(offsets) != n + 1 or len(ids) != n or len(data) != m["n_tokens"]:
                    raise ValueError(f"{stem}: the files do not have the manifest's counts")
                for a in range(0, n, rows):
                    b = min(n, a + rows)
                    off = offsets[a:b + 1].astype(np.int64)
                    wide = np.asarray(data[off[0]:off[-1]], "<u4")
                    raw, at = memoryview(wide.tobytes()), (off - off[0]) * 4
                    own = np.asarray(ids[a:b])
                    cols = {
                        "doc_id": pa.array(own, mask=own == NULL_ID), "start": pa.array(off[:-1] + m["base"]),
                        "n_tokens": pa.array(np.diff(off)),
                        "ids_crc32": pa.array([zlib.crc32(raw[i:j]) for i, j in zip(at[:-1], at[1:])], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array([wide[i // 4:j // 4].astype(np.int64) for i, j in zip(at[:-1], at[1:])],
                                               pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return manifest.repartition("part").mapInArrow(read, schema)
