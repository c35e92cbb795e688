"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; bounds its memory whatever the batch size.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the setting is absent and the master is local (tests), a temporary folder is set instead;
    on a cluster an absent setting is an error, since a machine-local folder would not be seen by all.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="dialoom-")
        sc.setCheckpointDir(folder)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: How GPT-like byte-level tokenizers cut a text into pieces; possessive where that changes nothing but the time.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Paths made by new_path that nobody has removed.
MADE: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, for tables that Spark writes."""
    MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return MADE[-1]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more, wherever they are."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in MADE:
            MADE.remove(path)


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, as executors' Python sees it; it must be a mounted file system."""
    folder = shared_dir(spark)
    if folder.startswith("file:"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    elif "://" in folder:
        raise RuntimeError(f"memory-mapped files need a mounted shared folder, not {folder}")
    path = os.path.join(folder, f"{what}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Parts of the batch with about `most` bytes of text each; one row at least, however long."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-case white-space words of each text: row offsets, word numbers, and the distinct words."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    keep = np.asarray(pc.binary_length(values)) > 0
    before = np.concatenate([[0], np.cumsum(keep)])
    coded = values.filter(pa.array(keep)).dictionary_encode()
    return before[offsets - offsets[0]], np.asarray(coded.indices).astype(np.int64), coded.dictionary


def row_key(*columns) -> F.Column:
    """A 64-bit key that tells rows apart by the given columns; nulls count as values."""
    parts = []
    for c in columns:
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)
