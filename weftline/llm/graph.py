"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut


def components(edges: DataFrame, *, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): for each node of an edge list the least node that it is connected with.

    Large-star and small-star steps in turn; each round is checkpointed, and the rounds end when a round changes no edge.
    The number of rounds is logarithmic in the size of the largest component. No edges give no rows; edges from a node
    to itself and those with a null end are dropped.
    """
    now = cut(edges.select(F.greatest(u, v).cast("bigint").alias("a"), F.least(u, v).cast("bigint").alias("b")).where(f"{u} is not null and {v} is not null and a != b").distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a")).toDF("a", "b")
        large = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        now = cut(small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").where("a != b").distinct())
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
