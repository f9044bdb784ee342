"""Coverage, differences and pairings of sets and multisets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import is_scenario


def coverage(sides: DataFrame, *, side: str = "side", key: str = "id", valid=is_scenario) -> DataFrame:
    """Exact coverage of expected by produced ids (U01): one row with the missing, extra, repeated and invalid ids of a
    frame (side: expected or produced, id), raw counts, and ``exact``, which also needs both sides to have rows.

    One shuffle: both sides are counted by id at once.
    """
    is_expected = F.col(side) == "expected"
    ids = sides.groupBy(F.col(key).alias("id")).agg(F.count_if(is_expected).alias("e"), F.count_if(~is_expected).alias("p")).withColumn("ok", valid(F.col("id")))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    own = ids.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected_count"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("actual_count"),
        pick(F.col("ok") & (F.col("e") > 0) & (F.col("p") == 0)).alias("missing"),
        pick(F.col("ok") & (F.col("p") > 0) & (F.col("e") == 0)).alias("extra"),
        pick(F.col("ok") & (F.col("e") > 1)).alias("duplicate_expected"),
        pick(F.col("ok") & (F.col("p") > 1)).alias("duplicate_produced"),
        pick(~F.col("ok") & (F.col("e") > 0)).alias("invalid_expected"),
        pick(~F.col("ok") & (F.col("p") > 0)).alias("invalid_produced"),
    )
    lists = ("missing", "extra", "duplicate_expected", "duplicate_produced", "invalid_expected", "invalid_produced")
    return own.withColumn("exact", reduce(lambda a, b: a & b, (F.size(c) == 0 for c in lists), (F.col("expected_count") > 0) & (F.col("actual_count") > 0)))


def coverage_counts(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """Of two frames of ids: how many are missing, extra and repeated, without listing them."""
    both = expected.select(F.col(key).alias("id"), F.lit(1).alias("e"), F.lit(0).alias("p")).unionAll(produced.select(F.col(key), F.lit(0), F.lit(1)))
    ids = both.groupBy("id").agg(F.sum("e").alias("e"), F.sum("p").alias("p"))
    return ids.agg(F.count_if(F.expr("e > 0 and p = 0")).alias("missing"), F.count_if(F.expr("p > 0 and e = 0")).alias("extra"), F.count_if(F.expr("e > 1")).alias("duplicate_expected"), F.count_if(F.expr("p > 1")).alias("duplicate_produced"))


def added(after: DataFrame, before: DataFrame) -> DataFrame:
    """The rows of after beyond those of before, with their multiplicity."""
    return after.exceptAll(before)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that come more than once, with how often (A10)."""
    return df.groupBy(*keys).count().where("count > 1")


def pairing(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): same, changed, only_before or only_after (J08). Two nulls count as changed, not as the same."""
    b, a = before.select(F.col(key).alias("key"), F.struct(F.col(value).alias("v")).alias("b")), after.select(F.col(key).alias("key"), F.struct(F.col(value).alias("v")).alias("a"))
    state = F.when(F.col("a").isNull(), "only_before").when(F.col("b").isNull(), "only_after").when(F.col("a.v") == F.col("b.v"), "same").otherwise("changed")
    return b.join(a, "key", "full").select("key", state.alias("state"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): files that are missing, extra or changed between two inventories (path, sha256)."""
    found = pairing(before, after, "path", "sha256").where("state != 'same'")
    return found.select(F.col("key").alias("path"), F.when(F.col("state") == "only_before", "missing").when(F.col("state") == "only_after", "extra").otherwise("changed").alias("change"))


def union(*frames: DataFrame) -> DataFrame:
    """Rows of all, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def partition_faults(all_ids: DataFrame, *parts: DataFrame) -> DataFrame:
    """(id, fault) where parts don't partition the whole: in none, in several, or unknown (U06, U07). Frames of ``id``."""
    whole = all_ids.select("id", F.lit(1).alias("w"), F.lit(0).alias("n"))
    every = reduce(DataFrame.unionAll, (p.select("id", F.lit(0), F.lit(1)) for p in parts), whole)
    own = every.groupBy("id").agg(F.max("w").alias("w"), F.sum("n").alias("n"))
    fault = F.when((F.col("w") == 1) & (F.col("n") == 0), "uncovered").when((F.col("w") == 0) & (F.col("n") > 0), "unknown").when(F.col("n") > 1, "overlap")
    return own.select("id", fault.alias("fault")).where("fault is not null")


def declared(contexts: DataFrame, skipped: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, fault) where contexts and skips together aren't the declared patterns."""
    own = contexts.select(F.col("pattern").alias("id")).union(skipped.select("pattern")).distinct()
    return partition_faults(patterns.select(F.col("pattern").alias("id")).distinct(), own).select(F.col("id").alias("pattern"), "fault")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def numbered(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows with ``nth``, the number of each among equal keys; joined on it, multisets pair off one by one."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or map(F.col, keys)))))
