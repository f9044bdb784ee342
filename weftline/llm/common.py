"""Helpers shared by the operators: scratch folders, text chunks, code-point tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text turned into Python objects at a time, so that a worker's memory doesn't follow the batch.
CHUNK_CHARS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only on one machine is it set here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="weftline-")
    spark.sparkContext.setCheckpointDir(base)
    return f"file://{base}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class Shared:
    """A file in the shared folder that workers map into memory, so that those of one machine share its pages and none holds a copy. It stays until the
    session ends, as the frames that read it may be run at any time."""

    path: str

    @classmethod
    def write(cls, spark: SparkSession, name: str, parts: Iterable[bytes]) -> Shared:
        """A new file of the parts, one after the other."""
        path = scratch(spark, name)
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getScheme() == "file":
            local = str(at.toUri().getPath())
            Path(local).parent.mkdir(parents=True, exist_ok=True)
            with open(local, "wb") as out:
                out.writelines(parts)
            path = local
        else:
            out = fs.create(at)
            for part in parts:
                for k in range(0, len(part), 1 << 22):
                    out.write(bytearray(part[k : k + (1 << 22)]))
            out.close()
            # Spark brings it to the executors' own work folders.
            spark.sparkContext.addFile(path)
        fs.deleteOnExit(at)
        return cls(path)

    def array(self, dtype: type, n: int, at: int = 0) -> np.ndarray:
        path = self.path if os.path.exists(self.path) else SparkFiles.get(os.path.basename(self.path))
        return np.asarray(np.memmap(path, dtype, "r", at, (n,))) if n else np.zeros(0, dtype)


#: Whether Spark drops a query's shuffle files when the query has ended.
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; its files go when nothing refers to them any more. The shuffle files that led
    to it aren't needed afterwards and go at once."""
    spark = df.sparkSession
    shared_dir(spark)
    had = spark.conf.get(_DROP, "false")
    spark.conf.set(_DROP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_DROP, had)


def utf8(text: Column | str) -> Column:
    """The text as a string column, whatever type came."""
    return (F.col(text) if isinstance(text, str) else text).cast("string")


def slices(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_CHARS) -> Iterator[pa.Array]:
    """The texts in parts of about ``most`` bytes each, in order; a longer text makes a part of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, len(texts)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of the ``slices``."""
    start = 0
    for own in slices(texts, most):
        yield start, own.to_pylist()
        start += len(own)


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_FOLD: dict[bool, np.ndarray] = {}


def fold_table(digits: bool) -> np.ndarray:
    """For each code point its lower-case form where it is a letter (or a digit, if asked), else 0."""
    if digits not in _FOLD:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalnum() if digits else s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD[digits] = table
    return _FOLD[digits]


#: Stands between two texts in ``joined``; no folded letter has this code.
EDGE = 1


def joined(texts: Iterable[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of all texts in one array, and the place of the separator before each text.

    Runs of code points without a letter become one 0. After each text stand 0, EDGE, 0, so that nothing matches
    across two texts. A null is an empty text.
    """
    texts = ["" if t is None else t for t in texts]
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 3)
    folded = table[codes("\n" + "".join(t + "\n\n\n" for t in texts))]
    folded[ends - 1] = EDGE
    keep = folded != 0
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    place = np.cumsum(keep) - 1
    return folded[keep], place[np.concatenate([[0], ends[:-1]])]
