"""Sinks: baselines, immutable promotion, reports, codemods, staleness."""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_baseline(counts: DataFrame, path: str, *, form: str = "json") -> None:
    """Write (dim, value) as one sorted JSON object or as lines k=v (K01). A baseline is a few numbers."""
    values = {r["dim"]: int(r["value"]) for r in counts.select("dim", "value").collect()}
    body = json.dumps(values, indent=2, sort_keys=True) + "\n" if form == "json" else "".join(f"{k}={v}\n" for k, v in sorted(values.items()))
    _put(counts.sparkSession, path, body)


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """(dim, value) of either form, or None where there is no file."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    body = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if body.lstrip().startswith("{"):
        values = json.loads(body)
    else:
        values = dict(x.split("=", 1) for x in body.splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return spark.createDataFrame([(k.strip(), int(v)) for k, v in values.items()], "dim string, value bigint")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, body: str) -> None:
    at, fs = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(body.encode()))
    out.close()


def promote(df: DataFrame, path: str, check=lambda df: True) -> None:
    """Write to a staging folder, read it back, check it, and rename it to its name; a name that is taken is an error."""
    spark = df.sparkSession
    at, fs = _fs(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    stage = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.json(stage)
    staged, _ = _fs(spark, stage)
    try:
        if not check(spark.read.schema(df.schema).json(stage)):
            raise ValueError(f"what was written for {path} doesn't hold")
        if fs.exists(at) or not fs.rename(staged, at):
            raise FileExistsError(path)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)


def stale(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that differ between what a generator gives and what is stored, with the side."""
    return expected.exceptAll(stored).withColumn("side", F.lit("expected")).unionByName(stored.exceptAll(expected).withColumn("side", F.lit("stored")))


def outcome(rows: DataFrame, verdict: dict, most: int = 40) -> tuple[str, int]:
    """A gate's table, its first rows only, and its exit code (K07, O03); counts come from the verdict, not from what is shown."""
    shown = rows.limit(most + 1).collect()
    lines = ["\t".join(rows.columns), *("\t".join("" if v is None else str(v) for v in r) for r in shown[:most])]
    return "\n".join(lines + (["..."] if len(shown) > most else [])), int(verdict["exit_code"])


def codemod(source: DataFrame, bundles: dict[str, str]) -> DataFrame:
    """(path, before, after, sites) of files that change when class lists equal to a bundle, in any order, are replaced.

    bundles: sorted class list -> replacement; the first of equal ones counts. Only double-quoted literals are looked at. Nothing is written.
    """
    key = lambda s: " ".join(sorted(s.split()))
    table: dict[str, str] = {}
    for k, v in bundles.items():
        table.setdefault(key(k), v)
    rx = re.compile(r'(className=)"([^"]*)"')

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            n = 0

            def put(m: re.Match) -> str:
                nonlocal n
                to = table.get(key(m[2]))
                n += to is not None
                return m[0] if to is None else f"{m[1]}{{{to}}}"

            after = None if t is None else rx.sub(put, t)
            out.append({"after": after, "sites": n})
        return pa.array(out, pa.struct([("after", pa.string()), ("sites", pa.int32())]))

    own = source.withColumn("r", F.arrow_udf(run, "struct<after: string, sites: int>")("text"))
    return own.select("path", F.col("text").alias("before"), "r.after", "r.sites").where("sites > 0")


def reverse_codemod(source: DataFrame, names: dict[str, str]) -> DataFrame:
    """(path, before, after, sites): identifiers in braces put back as class lists, by their text."""
    after, sites = F.col("text"), F.lit(0)
    for name, classes in names.items():
        form = rf"className=\{{{re.escape(name)}\}}"
        sites = sites + F.regexp_count(after, F.lit(form))
        after = F.regexp_replace(after, form, f'className="{classes}"')
    return source.select("path", F.col("text").alias("before"), after.alias("after"), sites.cast("int").alias("sites")).where("sites > 0")


def tally_faults(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, found, expected) where the call sites aren't as many as the census says, which stops a codemod."""
    own = found.select("name", F.col("n").alias("found")).join(expected.select("name", F.col("n").alias("expected")), "name", "full")
    return own.select("name", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected")).where("found != expected")


def report(pairs: DataFrame, title: str) -> str:
    """A Markdown report of paired captures (key, state, signature): states first, then a section for each pair."""
    counts = {r["state"]: r["count"] for r in pairs.groupBy("state").count().collect()}
    out = [f"# {title}", "", *(f"- {k}: {v}" for k, v in sorted(counts.items())), ""]
    for r in pairs.orderBy("key").toLocalIterator():
        out += [f"## {r['key']}", "", f"State: {r['state']}", *(["", r["signature"]] if "signature" in pairs.columns and r["signature"] else []), ""]
    return "\n".join(out)
