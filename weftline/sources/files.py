"""Files as frames. Paths are relative to the root that was read; reading is Spark's, pruned by globs where they can say it."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _relative(root: str) -> Column:
    """The path below the root, whatever the scheme in front of it is."""
    bare = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"^[a-z0-9]+:/{0,2}(?=/)", ""), "^/+", "/")
    prefix = "/" + root.split("://")[-1].strip("/") + "/"
    return F.when(bare.startswith(prefix), F.substring(bare, len(prefix) + 1, 1 << 30)).otherwise(bare)


def _exists(spark: SparkSession, root: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def texts(spark: SparkSession, root: str, suffixes: Sequence[str] = (), *, deny: Sequence[str] = (), skip_dirs: Sequence[str] = ()) -> DataFrame:
    """(path, text) of a tree's files (S01 to S06). suffixes: with the dot; none for all. deny: substrings that no path may hold;
    skip_dirs: names that none of its directories may have. A missing root gives no rows; unreadable files are left out."""
    if not _exists(spark, root):
        return spark.createDataFrame([], "path string, text string")
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    own = reader.text(root, wholetext=True).select(_relative(root).alias("path"), F.col("value").alias("text"))
    return pruned(own, deny=deny, skip_dirs=skip_dirs)


def pruned(files: DataFrame, *, deny: Sequence[str] = (), skip_dirs: Sequence[str] = ()) -> DataFrame:
    for d in deny:
        files = files.where(~F.col("path").contains(d))
    if skip_dirs:
        folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
        files = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, skip_dirs))))
    return files


def binaries(spark: SparkSession, root: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """(path, content, modified) of a tree's files."""
    if not _exists(spark, root):
        return spark.createDataFrame([], "path string, content binary, modified timestamp")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    return reader.load(root).select(_relative(root).alias("path"), "content", F.col("modificationTime").alias("modified"))


def inventory(spark: SparkSession, root: str, *, skip_dirs: Sequence[str] = ("__pycache__", ".git")) -> DataFrame:
    """(path, sha256) of a tree."""
    return pruned(binaries(spark, root), skip_dirs=skip_dirs).select("path", F.sha2("content", 256).alias("sha256"))


def fingerprint(files: DataFrame) -> str:
    """One hash over a tree's paths and hashes in order; an empty set is an error (X11). files: (path, sha256). The list of
    hashes is one short line for each file, and is folded in order on the driver."""
    import hashlib

    rows = files.select("path", "sha256").orderBy("path").collect()
    if not rows:
        raise ValueError("no files to fingerprint")
    h = hashlib.sha256()
    for r in rows:
        h.update(f"{r['path']}\0{r['sha256']}\0".encode())
    return h.hexdigest()


def style_sheets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_ord, path, text) of style sheets whose order is their precedence (S12); missing ones are left out."""
    own = [(i, p) for i, p in enumerate(paths) if _exists(spark, p)]
    if not own:
        return spark.createDataFrame([], "file_ord int, path string, text string")
    out = None
    for i, p in own:
        one = spark.read.text(p, wholetext=True).select(F.lit(i).alias("file_ord"), F.lit(p).alias("path"), F.col("value").alias("text"))
        out = one if out is None else out.unionAll(one)
    return out


def declarations(sheets: DataFrame, themes: dict[str, str]) -> DataFrame:
    """(theme, name, value, file_ord, pos) of custom properties in the blocks whose heads match each theme's pattern, comments blanked."""
    import re

    def each(batches):
        from weftline.functions.text import blank_comments, braces

        for batch in batches:
            rows = []
            for order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bare = blank_comments(text or "")
                for theme, head in themes.items():
                    body = "\n".join(braces(bare, head + r"\s*\{", len(bare) + 1))
                    rows += [(theme, m[1], m[2].strip(), order, k) for k, m in enumerate(re.finditer(r"--([A-Za-z0-9_-]+)\s*:\s*([^;}]+)", body))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))], ["theme", "name", "value", "file_ord", "pos"])

    return sheets.select("file_ord", "text").mapInArrow(each, "theme string, name string, value string, file_ord int, pos int")


def emitted_css(candidates: DataFrame) -> str | None:
    """The emitted style sheet (S13): of (kind, text) the explicit file, else the server's if it's over 50,000 bytes, else the largest
    built one; None if there is none, which callers read as nothing to check."""
    size = F.octet_length("text")
    rank = F.when(F.col("kind") == "explicit", 0).when((F.col("kind") == "server") & (size > 50_000), 1).when(F.col("kind") == "dist", 2)
    row = candidates.withColumn("_r", rank).where("_r is not null").orderBy("_r", F.desc(size)).first()
    return row["text"] if row else None


def flatten(data: Any, prefix: str = "", sep: str = "-") -> dict[str, str]:
    """Nested maps of colours as one map."""
    out: dict[str, str] = {}
    for k, v in data.items():
        out |= flatten(v, f"{prefix}{k}{sep}", sep) if isinstance(v, dict) else {f"{prefix}{k}": str(v)}
    return out


def token_document(spark: SparkSession, document: str | dict) -> DataFrame:
    """(tier, theme, theme_ord, grp, path, value) of a token document (S14, E5): keys with $ are metadata, but for $root, which is a token."""
    data = json.loads(Path(document).read_text(encoding="utf-8")) if isinstance(document, str) else document
    rows: list[tuple] = []

    def walk(at: Any, path: tuple[str, ...], head: tuple) -> None:
        if not isinstance(at, dict):
            return
        if "$value" in at:
            rows.append((*head, list(path), json.dumps(at["$value"]) if not isinstance(at["$value"], str) else at["$value"]))
        found = False
        for k, v in at.items():
            if k == "$root" or not k.startswith("$"):
                found = True
                walk(v, (*path, k), head)
        if not found and "$value" not in at:
            rows.append((*head, list(path), None))

    for tier, themes in data.items():
        if tier.startswith("$") or not isinstance(themes, dict):
            continue
        order = 0
        for theme, groups in themes.items():
            if theme.startswith("$") or not isinstance(groups, dict):
                continue
            for group, own in groups.items():
                if not group.startswith("$"):
                    walk(own if isinstance(own, dict) else {"$value": str(own)}, (group,), (tier, theme, order, group))
            order += 1
    return spark.createDataFrame(rows, "tier string, theme string, theme_ord int, grp string, path array<string>, value string")


def vocabulary(doc: DataFrame, start: str, end: str, *, text: str = "text") -> DataFrame:
    """(owner): the terms in backticks between two headings of a document; the headings must be there."""
    own = doc.select(F.when(F.instr(text, start) == 0, F.raise_error(F.lit(f"no heading {start}"))).otherwise(F.substring_index(F.expr(f"substring({text}, instr({text}, '{start}'))"), end, 1)).alias("part"))
    return own.select(F.explode(F.regexp_extract_all("part", F.lit("`([a-z][a-z0-9-]*)`"), F.lit(1))).alias("owner")).distinct()


def allowlist(lines: DataFrame, *, column: str = "value") -> DataFrame:
    """(pattern): the lines of an allow-list without comments and blanks."""
    own = F.trim(F.regexp_replace(column, r"\s*#.*$", ""))
    return lines.select(own.alias("pattern")).where("pattern != ''")


def glob_regex(pattern: Column) -> Column:
    """A glob as a regular expression in which * also crosses slashes."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*+", ".*"), r"\?", "."), F.lit("$"))


def index_corpus(docs: DataFrame) -> DataFrame:
    """One row with the text of all index, log and read-me files of (path, text); those at the top come twice."""
    own = docs.where(F.col("path").rlike(r"(^|/)(index|log|README)\.md$"))
    twice = own.unionAll(own.where(~F.col("path").contains("/")))
    return twice.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "\n").alias("corpus"))


def json_document(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON document; anything that isn't the schema's is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def transcript_tail(lines: DataFrame, *, most: int = 400, role: str = "assistant") -> DataFrame:
    """(line, text): what a role said in the last lines of a transcript (line, value); lines that are no JSON are skipped."""
    from pyspark.sql import Window

    last = lines.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("line")))).where(F.col("_n") <= most)
    shape = "role string, message struct<role: string, content: string>, content string"
    own = last.withColumn("j", F.from_json("value", shape, {"mode": "PERMISSIVE"})).where(F.coalesce("j.message.role", "j.role") == role)
    raw = F.coalesce("j.message.content", "j.content")
    parts = F.from_json(raw, "array<struct<type: string, text: string>>")
    said = F.when(raw.startswith("["), F.array_join(F.transform(F.filter(parts, lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")).otherwise(raw)
    return own.select("line", said.alias("text")).where("text is not null and text != ''")


def first_row(df: DataFrame, where: Column | str, *order: str) -> DataFrame:
    """The first row that a condition leaves, by an order."""
    return df.where(where).orderBy(*order).limit(1)


def captures(files: DataFrame) -> DataFrame:
    """(stem, png_path, meta_path, status) of images and metadata files of (path): ok, missing-metadata or orphan."""
    png = files.where(F.col("path").endswith(".png")).select(F.regexp_replace("path", r"\.png$", "").alias("stem"), F.col("path").alias("png_path"))
    meta = files.where(F.col("path").endswith(".meta.json")).select(F.regexp_replace("path", r"\.meta\.json$", "").alias("stem"), F.col("path").alias("meta_path"))
    both = png.join(meta, "stem", "full")
    return both.withColumn("status", F.when(F.col("meta_path").isNull(), "missing-metadata").when(F.col("png_path").isNull(), "orphan").otherwise("ok"))


FIXTURES = "schemaVersion string, readOnly boolean, fixtures array<struct<id: string, routePattern: string, routeParams: map<string,string>, contractSources: array<string>, responses: array<struct<method: string, path: string, status: int, body: string>>>>"


def fixture_registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, routePattern, routeParams, contractSources, responses) of a network-fixture registry (S25); it must be read-only and hold its rules."""
    from weftline.plans.routes import fixture_faults

    document = json_document(spark, path, FIXTURES)
    rows = document.select(F.explode("fixtures").alias("f")).select("f.*")
    head = document.agg(F.bool_and(F.coalesce("readOnly", F.lit(False))).alias("safe")).first()
    wrong = [tuple(r) for r in fixture_faults(rows).limit(20).collect()]
    if not head["safe"] or wrong:
        raise ValueError(f"the fixtures can't be used: read-only {head['safe']}, {wrong}")
    return rows


def valid_flows(files: DataFrame) -> DataFrame:
    """(path, id, name) of flow files (path, text) with an id of letters, digits, dots, dashes and underscores, a name, and steps."""
    own = files.select("path", F.from_json("text", "id string, name string, steps array<string>").alias("f"))
    return own.where(F.col("f.id").rlike("^[A-Za-z0-9._-]+$") & (F.trim("f.name") != "") & F.col("f.steps").isNotNull()).select("path", "f.id", "f.name")
