"""The one rule of the log: newest record wins, a tombstone hides its key, an expired record reveals the older one.

Expired records leave before the ranking and tombstones never do (an expired tombstone still hides); tombstones leave
after it. The ranking's `rn = 1` plans as a partial and a final WindowGroupLimit, so a shuffle carries few rows a key and
map task, and a predicate on the key is pushed below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.scalars import expired


def live(log: DataFrame, now: int) -> DataFrame:
    return log.where(F.col("tombstone") | ~expired(F.col("expires_at_sec"), now))


def newest(log: DataFrame, now: int) -> DataFrame:
    """The deciding record of each key that has one."""
    w = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return live(log, now).withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")


def visible(log: DataFrame, now: int) -> DataFrame:
    return newest(log, now).where(~F.col("tombstone"))


def deleted(log: DataFrame, now: int) -> DataFrame:
    return newest(log, now).where("tombstone")


def top_code(now: int, flag: Column) -> Column:
    """Aggregate: the newest deciding record's seq times four plus its flag; null if only expired records are there.

    A maximum of longs is a hash aggregation with partial sums on the map side, where a ranking would need a sort.
    """
    counts = F.col("tombstone") | ~expired(F.col("expires_at_sec"), now)
    return F.max(F.when(counts, F.shiftleft(F.col("seq"), 2) + flag))


def states(log: DataFrame, now: int) -> DataFrame:
    """(key, state): selected, deleted, or undecided (only expired records), in one shuffle."""
    top = log.groupBy("key").agg(top_code(now, F.col("tombstone").cast("long")).alias("top__"))
    return top.select("key", F.when(F.col("top__").isNull(), "undecided").when(F.col("top__") % 4 == 1, "deleted").otherwise("selected").alias("state"))


def decisions(log: DataFrame, now: int, by: str = "page_id") -> DataFrame:
    """(key, page, decision) of each page alone: tombstone, valid, overflow or continue."""
    big = F.col("overflow") if "overflow" in log.columns else F.lit(False)
    flag = F.when(F.col("tombstone"), 1).when(big, 2).otherwise(0).cast("long")
    top = log.groupBy("key", by).agg(top_code(now, flag).alias("top__"))
    kind = F.col("top__") % 4
    return top.select("key", by, F.when(F.col("top__").isNull(), "continue").when(kind == 1, "tombstone").when(kind == 2, "overflow").otherwise("valid").alias("decision"))


def exists_decisions(log: DataFrame, now: int, by: str = "page_id") -> DataFrame:
    """(key, page, decision) of each page alone without reading a value: tombstone, present or continue."""
    top = log.select("key", by, "expires_at_sec", "tombstone", "seq").groupBy("key", by).agg(top_code(now, F.col("tombstone").cast("long")).alias("top__"))
    return top.select("key", by, F.when(F.col("top__").isNull(), "continue").when(F.col("top__") % 4 == 1, "tombstone").otherwise("present").alias("decision"))
