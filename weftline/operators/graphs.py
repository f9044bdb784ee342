"""Iterative operators: reachability, alias chains, convergence. Rounds are reliably checkpointed and bounded; reaching
the bound is an error, never a silent end."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _ready(spark: SparkSession) -> None:
    """The shared folder for checkpoints; on one machine a folder of our own if none is set."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))


def reach(edges: DataFrame, starts: DataFrame, *, src: str = "src", dst: str = "dst", most: int = 1000) -> DataFrame:
    """(node, hops): everything reachable from the starts (a frame of ``node``) with the least number of hops, starts at 0."""
    return _spread(edges, starts.select("node"), ["node"], src, dst, most)


def reach_each(edges: DataFrame, starts: DataFrame, *, src: str = "src", dst: str = "dst", most: int = 1000) -> DataFrame:
    """(start, node, hops): as ``reach``, for each start by itself; all starts spread in the same rounds."""
    return _spread(edges, starts.select(F.col("node").alias("start"), "node"), ["start", "node"], src, dst, most)


def _spread(edges: DataFrame, starts: DataFrame, keys: list[str], src: str, dst: str, most: int) -> DataFrame:
    spark = edges.sparkSession
    _ready(spark)
    own = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null").distinct().checkpoint()
    seen = starts.where("node is not null").distinct().select(*keys, F.lit(0).alias("hops")).checkpoint()
    front = seen
    for hop in range(1, most + 1):
        step = front.join(own, front["node"] == own["s"]).select(*keys[:-1], F.col("d").alias("node")).distinct()
        front = step.join(seen, keys, "left_anti").select(*keys, F.lit(hop).alias("hops")).checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)
        if hop % 8 == 0:
            seen = seen.checkpoint()
    raise RuntimeError(f"not done after {most} hops")


def reverse(edges: DataFrame) -> DataFrame:
    """The edges the other way round."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def components(pairs: DataFrame, *, most: int = 100) -> DataFrame:
    """(id, root) of all ids in pairs (a, b): the least id connected, by min-label rounds with pointer jumping."""
    spark = pairs.sparkSession
    _ready(spark)
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("a", "b").distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).checkpoint()
    for _ in range(most):
        near = both.join(labels.select(F.col("a").alias("b"), F.col("root").alias("other")), "b").groupBy("a").agg(F.min("other").alias("low"))
        lowered = labels.join(near, "a").select("a", F.least("root", "low").alias("root"))
        jumped = lowered.join(lowered.select(F.col("a").alias("root"), F.col("root").alias("up")), "root", "left").select("a", F.coalesce("up", "root").alias("root")).checkpoint()
        if jumped.join(labels.withColumnRenamed("root", "was"), "a").where("root != was").isEmpty():
            return labels.select(F.col("a").alias("id"), "root")
        labels = jumped
    raise RuntimeError(f"not converged after {most} rounds")


def resolve_aliases(values: DataFrame, *, base: str = "dark", most: int = 64) -> DataFrame:
    """(theme, name, value, status) of declarations (theme, name, value): var(--x) followed to a value, each theme falling
    back to the base theme (G01, J07). status: resolved, missing (a name without a declaration) or cycle; the value is
    null unless resolved. Alias chains longer than ``most`` are an error.
    """
    _ready(values.sparkSession)
    alias = r"^\s*var\(\s*--([A-Za-z0-9_-]+)\s*\)\s*$"
    themes = values.select("theme").distinct()
    names = values.select("name").distinct()
    own, under = values.select("theme", "name", "value"), values.where(F.col("theme") == base).select("name", F.col("value").alias("inherited"))
    table = themes.crossJoin(names).join(own, ["theme", "name"], "left").join(under, "name", "left").select("theme", "name", F.coalesce("value", "inherited").alias("value")).where("value is not null").checkpoint()
    step = table.select("theme", F.col("name").alias("target"), F.col("value").alias("next"))
    now = table.withColumn("target", F.nullif(F.regexp_extract("value", alias, 1), F.lit(""))).withColumn("seen", F.array("name"))
    done = now.where("target is null").select("theme", "name", "value", F.lit("resolved").alias("status"))
    open_ = now.where("target is not null")
    for _ in range(most):
        looped = open_.where("array_contains(seen, target)").select("theme", "name", F.lit(None).cast("string").alias("value"), F.lit("cycle").alias("status"))
        moved = open_.where("not array_contains(seen, target)").join(step, ["theme", "target"], "left")
        lost = moved.where("next is null").select("theme", "name", F.lit(None).cast("string").alias("value"), F.lit("missing").alias("status"))
        moved = moved.where("next is not null").select("theme", "name", F.col("next").alias("value"), F.nullif(F.regexp_extract("next", alias, 1), F.lit("")).alias("target"), F.array_append("seen", F.col("target")).alias("seen"))
        done = done.unionByName(looped).unionByName(lost).unionByName(moved.where("target is null").select("theme", "name", "value", F.lit("resolved").alias("status"))).checkpoint()
        open_ = moved.where("target is not null").checkpoint()
        if open_.isEmpty():
            return done
    raise RuntimeError(f"an alias chain is longer than {most}")


def inherited(nodes: DataFrame, *, most: int = 64) -> DataFrame:
    """(node, pattern, modules, guards) down a route tree (node, parent, path, modules, guards): paths composed, modules and
    guards of the ancestors first (G06, P21)."""
    _ready(nodes.sparkSession)
    front = nodes.where("parent is null").select("node", route_path(F.lit(""), F.col("path")).alias("pattern"), "modules", "guards").checkpoint()
    done = front
    for _ in range(most):
        up = front.select(F.col("node").alias("parent"), F.col("pattern").alias("above"), F.col("modules").alias("m"), F.col("guards").alias("g"))
        front = nodes.join(up, "parent").select("node", route_path(F.col("above"), F.col("path")).alias("pattern"), F.array_distinct(F.concat("m", "modules")).alias("modules"), F.array_distinct(F.concat("g", "guards")).alias("guards")).checkpoint()
        if front.isEmpty():
            return done
        done = done.unionAll(front)
    raise RuntimeError(f"the tree is deeper than {most}, or has a cycle")


def route_path(parent, path):
    """A child path under its parent: one slash between, * kept, no slash at the end but for the root."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", parent, F.coalesce(path, F.lit(""))))
    short = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), whole), "/+", "/"), "(.)/$", "$1")
    return F.when((path == "*") & parent.isin("", "/"), "*").otherwise(short)


def cascade(declarations: DataFrame, *, last: bool = True) -> DataFrame:
    """The winning declaration of each (theme, name) among (theme, name, value, file_ord, pos): the last by file order and
    place, or the first (W06)."""
    order = [F.col("file_ord"), F.col("pos")]
    ranked = declarations.withColumn("_n", F.row_number().over(Window.partitionBy("theme", "name").orderBy(*[c.desc() if last else c.asc() for c in order])))
    return ranked.where("_n = 1").select("theme", "name", "value")


def impact(routes: DataFrame, edges: DataFrame, changed: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """(pattern, hops, reason) of the routes that changed files reach through reversed imports.

    routes: (pattern, modules); edges: importer src, imported dst; changed: ``node``. Files in ``reasons`` (node, reason) touch every
    route at hop 0 and no search is needed for those.
    """
    wide = None
    if reasons is not None:
        hit = changed.join(reasons, "node").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reason"))
        wide = routes.select("pattern").crossJoin(hit.where("reason != ''")).select("pattern", F.lit(0).alias("hops"), "reason")
    near = reach(reverse(edges), changed)
    found = routes.select("pattern", F.explode("modules").alias("node")).join(near, "node").groupBy("pattern").agg(F.min("hops").alias("hops")).withColumn("reason", F.lit("import"))
    if wide is None:
        return found
    return wide.unionByName(found.join(wide.select("pattern"), "pattern", "left_anti"))
