"""Ratchets: current counts against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratchet(current: DataFrame, baseline: DataFrame, *, unknown: str = "zero") -> DataFrame:
    """(dim, current, baseline, status) with status up, down or same; up is a regression.

    Frames of (dim, value), the baseline's with ``direction`` too where more is better: lower (default) or higher.
    unknown: what a dimension without a baseline is held against: zero, or current (then it's same). A dimension that
    is gone has the value 0.
    """
    if "direction" not in baseline.columns:
        baseline = baseline.withColumn("direction", F.lit("lower"))
    both = current.select("dim", F.col("value").alias("c")).join(baseline.select("dim", F.col("value").alias("b"), "direction"), "dim", "full")
    now = F.coalesce("c", F.lit(0)).cast("bigint")
    was = F.coalesce(F.col("b").cast("bigint"), F.lit(0).cast("bigint") if unknown == "zero" else now)
    worse = F.when(F.coalesce("direction", F.lit("lower")) == "higher", was - now).otherwise(now - was)
    return both.select("dim", now.alias("current"), was.alias("baseline"), F.when(worse > 0, "up").when(worse < 0, "down").otherwise("same").alias("status"))


def verdict(rows: DataFrame, *, decrease: bool = False) -> DataFrame:
    """One row of a ratchet: pass, exit_code, and the dimensions that regressed; with ``decrease`` the total must fall."""
    up = F.col("status") == "up"
    own = rows.agg(F.array_sort(F.collect_list(F.when(up, F.col("dim")))).alias("regressed"), F.coalesce(F.sum("current"), F.lit(0)).alias("current"), F.coalesce(F.sum("baseline"), F.lit(0)).alias("baseline"))
    ok = F.size("regressed") == 0
    if decrease:
        ok = ok & (F.col("current") < F.col("baseline"))
    return own.withColumn("passed", ok).withColumn("exit_code", F.when(F.col("passed"), 0).otherwise(1))


def without_baseline(current: DataFrame, *, closed: bool) -> DataFrame:
    """The outcome where there is no baseline: failing for the naming law (closed), a mere report for the others."""
    return current.agg(F.sum("value").alias("current")).select("current", F.lit(not closed).alias("passed"), F.lit(int(closed)).alias("exit_code"))


def permille(part, whole):
    """1000 * part / whole, rounded half to even; 0 for an empty whole."""
    return F.when(whole == 0, 0).otherwise(F.bround(1000 * part / F.nullif(whole, F.lit(0)))).cast("bigint")


def with_total(counts: DataFrame, dim: str = "dim", value: str = "value") -> DataFrame:
    """Counts with a TOTAL row."""
    return counts.select(dim, value).unionByName(counts.agg(F.coalesce(F.sum(value), F.lit(0)).alias(value)).select(F.lit("TOTAL").alias(dim), value))


def severest(df: DataFrame, keys: list[str], verdict_col: str, ranks: tuple[str, ...]) -> DataFrame:
    """The gravest verdict of each key, ranks from harmless to grave."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(verdict_col))
    return df.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, ranks)), F.max(rank).cast("int")).alias(verdict_col))
