"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps; each step is written to the shared folder, so
    neither lineage nor the driver holds the graph.
    """
    spark = edges.sparkSession
    now = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    count = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = count(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).filter("u <> v").distinct()
        step = common.written(large, label)
        least = step.groupBy("u").agg(F.min("v").alias("w"))
        small = step.join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("w").alias("v"))).distinct()
        after_df = common.written(small, label)
        common.drop_written(spark, step)
        common.drop_written(spark, now)
        now, after = after_df, count(after_df)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
