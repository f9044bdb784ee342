"""Clusters of occurrences and their fusion until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graphs import _ready
from weftline.operators.naming import decide, fusion_scores

AXES = ("tag", "role", "component", "property", "state", "owner")


def preflight(signals: dict[str, bool]) -> None:
    """Every signal must be live, or nothing runs."""
    lost = sorted(k for k, ok in signals.items() if not ok)
    if lost or not signals:
        raise RuntimeError(f"signals that don't resolve: {lost or 'none given'}")


def census(source: DataFrame, tokens: DataFrame) -> DataFrame:
    """(path, line, prefix, token): each occurrence of a known token behind a utility prefix."""
    from weftline.functions.text import lines

    own = lines(source).select("path", "line", F.explode(F.regexp_extract_all("content", F.lit(r"(?:^|[^\w-])((?:bg|border|divide|fill|outline|placeholder|ring|shadow|stroke|text)-[a-z][a-z0-9-]*)"), F.lit(1))).alias("use"))
    split = own.select("path", "line", F.regexp_extract("use", "^([a-z]+)-", 1).alias("prefix"), F.regexp_replace("use", "^[a-z]+-", "").alias("token"))
    return split.join(tokens.select("token").distinct(), "token", "left_semi").select("path", "line", "prefix", "token")


def clusters(occurrences: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Groups of occurrences alike on all axes, with uses and tokens."""
    return occurrences.groupBy(*axes).agg(F.count("*").alias("uses"), F.array_sort(F.collect_set("token")).alias("tokens"))


def owners_by_context(occurrences: DataFrame, rules: DataFrame) -> DataFrame:
    """occurrences with an owner from a table of rules (tag, role, container, owner), nulls as wildcards; the rule with most given parts wins."""
    keys = ("tag", "role", "container")
    kinds = occurrences.select(*keys).distinct().alias("o")
    met = kinds.join(rules.alias("r"), F.expr(" and ".join(f"(r.{k} is null or r.{k} = o.{k})" for k in keys)))
    weight = sum((F.col(f"r.{k}").isNotNull().cast("int") for k in keys), F.lit(0))
    best = met.groupBy(*(F.col(f"o.{k}").alias(k) for k in keys)).agg(F.max_by(F.col("r.owner"), F.struct(weight, F.col("r.owner"))).alias("owner")).alias("b")
    own = occurrences.drop("owner").alias("o")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return own.join(best, same[0] & same[1] & same[2], "left").select("o.*", "b.owner")


def converge(contracts: DataFrame, differences: DataFrame, *, least: float = 70.0, most: int = 50) -> tuple[DataFrame, int]:
    """Contracts after fusing, and how many rounds it took (D05 to D07): within a derived name, pairs that score enough, or outliers, fuse into the
    one with more uses, then the smaller id, until two rounds in a row change nothing. Uses are kept in sum.

    contracts: (id, name, contract, component, strength, tag, role, uses); differences: (id1, id2, delta_e), id1 < id2.
    """
    _ready(contracts.sparkSession)
    now, quiet = contracts.checkpoint(), 0
    for turn in range(1, most + 1):
        side = lambda k: now.select(*(F.col(c).alias(f"{c}{k}") for c in now.columns))  # noqa: B023, E731
        pairs = side(1).join(side(2), (F.col("name1") == F.col("name2")) & (F.col("id1") < F.col("id2"))).join(differences, ["id1", "id2"])
        scored = decide(fusion_scores(pairs), uncertainty=100 - least).where("decision != 'queue'")
        first = (F.col("uses1") > F.col("uses2")) | ((F.col("uses1") == F.col("uses2")) & (F.col("id1") < F.col("id2")))
        moves = scored.select(F.when(first, F.col("id2")).otherwise(F.col("id1")).alias("gone"), F.when(first, F.col("id1")).otherwise(F.col("id2")).alias("into"), "confidence")
        best = moves.withColumn("_n", F.row_number().over(Window.partitionBy("gone").orderBy(F.desc("confidence"), "into"))).where("_n = 1").select("gone", "into")
        # Only what is absorbed by something that stays fuses in this round; chains go on in the next.
        best = best.join(best.select(F.col("gone").alias("into")), "into", "left_anti").checkpoint()
        if best.isEmpty():
            quiet += 1
            if quiet == 2:
                return now, turn
            continue
        quiet = 0
        moved = now.join(best, now["id"] == best["gone"], "left").withColumn("id", F.coalesce("into", "id"))
        gained = moved.groupBy("id").agg(F.sum("uses").alias("total"))
        now = now.join(gained, "id").withColumn("uses", F.col("total")).drop("total").checkpoint()
    raise RuntimeError(f"not converged after {most} rounds")


def chapters(scored: DataFrame) -> DataFrame:
    """scored pairs or clusters with ``chapter``: decided, exposed or needs-owner."""
    return scored.withColumn("chapter", F.when(F.col("owner").isNull(), "needs-owner").when(F.col("decision") == "queue", "exposed").otherwise("decided"))
