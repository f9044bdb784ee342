"""Gates over a stream of source files.

Files arrive in versions (path, version, text). What counts is each path's newest version, so a file's counts are state by path and
dimension; a newer version replaces them, an older one that comes late changes nothing, and a version without a text takes
the file away. Totals over all files are kept by the batches' changes, and go through the same ratchet as a whole tree's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from weftline import model
from weftline.operators import gates

_CHANGE = "path string, dim string, change bigint"
_COUNTS = "path string, version bigint, counts array<bigint>"


def counted(files: DataFrame) -> DataFrame:
    """(path, version, counts): the lines of each dimension of hard-coded style in each file, counted in the JVM; null counts for no text."""
    ls = F.filter(F.split("text", "\n"), lambda x: ~x.contains("ds-allow:"))

    def lines_of(rx: str, out: str | None) -> Column:
        return F.size(F.filter(ls, lambda x: x.rlike(rx) & ~x.rlike(out) if out else x.rlike(rx))).cast("bigint")

    counts = [lines_of(rx, out) for _, rx, out in model.HARDCODE]
    return files.select("path", F.col("version").cast("bigint").alias("version"), F.when(F.col("text").isNotNull(), F.array(*counts)).alias("counts")).where("path is not null and version is not null")


def changes(files: DataFrame) -> DataFrame:
    """(path, dim, change): how each newer version changes its file's counts. A stream; state is one row of numbers for each path."""
    dims = [d for d, _, _ in model.HARDCODE]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, *had = state.get if state.exists else (None, *[0] * len(dims))
        before = list(had)
        for pdf in batches:
            for v, counts in zip(pdf["version"], pdf["counts"], strict=True):
                if version is None or v > version:
                    version, had = int(v), [0] * len(dims) if counts is None else [int(c) for c in counts]
        state.update((version, *had))
        rows = [(key[0], d, n - b) for d, n, b in zip(dims, had, before, strict=True) if n != b]
        yield pd.DataFrame(rows, columns=["path", "dim", "change"]).astype({"change": "int64"})

    kept = ", ".join(["version bigint", *(f"n{i} bigint" for i in range(len(dims)))])
    return counted(files).groupBy("path").applyInPandasWithState(step, _CHANGE, kept, "append", "NoTimeout")


def totals(stored: DataFrame) -> DataFrame:
    """(dim, value) with zeros and the total, from the changes that a stream has written."""
    every = stored.sparkSession.createDataFrame([(d,) for d, _, _ in model.HARDCODE], "dim string")
    own = stored.groupBy("dim").agg(F.sum("change").alias("n"))
    return gates.with_total(every.join(own, "dim", "left").select("dim", F.coalesce("n", F.lit(0)).cast("bigint").alias("value")))


def run(files: DataFrame, output: str, checkpoint: str) -> None:
    """Write a stream's changes until its source has no more."""
    changes(files).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output).awaitTermination()
