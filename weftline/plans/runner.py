"""A runner of phases that goes on where it stopped: an append-only journal in a shared folder.

A phase is a name, what it needs, and a function of (spark, outputs of the phases done) that gives a DataFrame or None. A phase's
rows are written to a folder of their own before its end is put in the journal, so that a run that was ended, or lost its
driver, repeats only what hadn't ended. A phase that failed is tried again by the next run; one whose needs failed is blocked.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Phase = tuple[str, Sequence[str], Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame | None]]
_ENTRY = "at double, run string, phase string, state string, output string, detail string"


def journal(spark: SparkSession, root: str) -> DataFrame:
    """All entries (at, run, phase, state, output, detail) in the order in which they came."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/journal")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).json(f"{root}/journal").orderBy("at")


def states(entries: DataFrame) -> DataFrame:
    """(phase, state, output): the last entry of each phase."""
    return entries.groupBy("phase").agg(F.max_by(F.struct("state", "output"), "at").alias("x")).select("phase", "x.state", "x.output")


def run(spark: SparkSession, root: str, phases: Sequence[Phase]) -> dict[str, str]:
    """Run what isn't done, in the given order, and say each phase's state: done, failed or blocked."""
    names = [p[0] for p in phases]
    if len(set(names)) < len(names) or any(n not in names[:i] for i, (_, needs, _) in enumerate(phases) for n in needs):
        raise ValueError("phases need different names, and needs that come before them")
    own = uuid.uuid4().hex

    def note(phase: str, state: str, output: str = "", detail: str = "") -> None:
        spark.createDataFrame([(time.time(), own, phase, state, output, detail)], _ENTRY).coalesce(1).write.mode("append").json(f"{root}/journal")

    done = {r["phase"]: r["output"] for r in states(journal(spark, root)).where("state = 'done'").collect()}
    result, rows = {}, {n: spark.read.parquet(at) for n, at in done.items() if at}
    for name, needs, work in phases:
        if name in done:
            result[name] = "done"
            continue
        if any(result[n] != "done" for n in needs):
            result[name] = "blocked"
            note(name, "blocked")
            continue
        note(name, "begun")
        try:
            made, at = work(spark, rows), ""
            if made is not None:
                at = f"{root}/{name}-{own}"
                made.write.parquet(at)
                rows[name] = spark.read.parquet(at)
        except Exception as e:  # a phase's failure is a state, whatever it was
            result[name] = "failed"
            note(name, "failed", detail=str(e)[:1000])
            continue
        note(name, "done", at)
        result[name] = "done"
    return result
