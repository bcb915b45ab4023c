"""As-of and interval joins, which the dialect has no words for, without pairs that are thrown away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, time: str, keys: Sequence[str], within: str | None = None) -> DataFrame:
    """Each row of left with the latest row of right (same keys) of an earlier time, at most `within` (an
    interval) before; else with NULLs. Both are sorted together once per key, so no pair is made:
    a row's match is the last right row before it in that order. Of right rows of one time the one that is
    greatest by its other columns counts."""
    extra = [c for c in right.columns if c not in keys and c != time]
    both = left.select(*keys, time, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("_r")).unionByName(
        right.select(*keys, time, F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*right.columns).alias("_r"))
    )
    # at one time the left rows come first, so that only earlier rows match
    order = Window.partitionBy(*keys).orderBy(F.col(time), F.col("_l").isNull(), F.col("_r")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(order)).filter(F.col("_l").isNotNull())
    if within:
        found = found.withColumn("_m", F.when(F.col(f"_m.{time}") >= F.col(time) - F.expr(within), F.col("_m")))
    return found.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in extra])


def interval_join(left: DataFrame, right: DataFrame, start: str, at: str, seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs where right.at lies in [left.start, left.start + seconds). Rows meet in buckets of that length: a left
    row in its own and the next one, so it is an equi-join of the keys and the bucket."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    a = left.withColumn("_b", F.explode(F.array(bucket(start), bucket(start) + 1)))
    b = right.withColumn("_b", bucket(at))
    joined = a.join(b, [*keys, "_b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.expr(f"INTERVAL {seconds} SECONDS")))
    return joined.drop("_b")
