"""Writes as rows appended to the log; a batch is one append, so it lands as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.ordered import numbered
from emberlog.schema import OPS

#: Rows of an order block when numbers are assigned.
BLOCK = 65536


def parsed_ops(rows: DataFrame, column: str = "json") -> DataFrame:
    """(ord, op, key, value, expires_at_sec) of JSON arrays of operations; an unknown operation or a put without value fails all."""
    each = rows.select("batch", F.posexplode(F.from_json(column, OPS)).alias("i", "o")).select("batch", "i", F.lower("o.op").alias("op"), "o.key", "o.value", F.coalesce("o.expires_at_sec", F.lit(0).cast("long")).alias("expires_at_sec"))
    good = F.col("op").isin("put", "del") & ((F.col("op") == "del") | F.col("value").isNotNull()) & F.col("key").isNotNull()
    return each.withColumn("op", F.when(good, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("bad operation: "), F.coalesce("op", F.lit("null"))))))


def op_rows(ops: DataFrame, after_seq: int, order: list[Column], block: Column) -> DataFrame:
    """Log rows of operations, with seq from after_seq + 1 in order."""
    rows = numbered(ops, order, block, "seq")
    put = F.col("op") == "put"
    return rows.select("key", F.when(put, F.col("value")).alias("value"), F.when(put, F.col("expires_at_sec")).otherwise(F.lit(0).cast("long")).alias("expires_at_sec"), (~put).alias("tombstone"), (F.col("seq") + F.lit(after_seq)).alias("seq"))


def appended(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log after an append; on disk this is one Parquet append job."""
    return log.select(rows.columns).unionByName(rows)


def put(log: DataFrame, key: Column, value: Column, seq: int, expires_at_sec: int = 0) -> DataFrame:
    one = log.sparkSession.range(1)
    return appended(log, one.select(key.alias("key"), value.alias("value"), F.lit(expires_at_sec).cast("long").alias("expires_at_sec"), F.lit(False).alias("tombstone"), F.lit(seq).cast("long").alias("seq")))


def delete(log: DataFrame, keys: DataFrame, seq: int) -> DataFrame:
    """Tombstones for keys (key, i), numbered after seq."""
    return appended(log, keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("expires_at_sec"), F.lit(True).alias("tombstone"), (F.lit(seq) + F.col("i")).cast("long").alias("seq")))


def last_heads(updates: DataFrame) -> DataFrame:
    """The last update of each bucket by ord; -1 stands for no page and becomes null."""
    top = updates.groupBy("bucket").agg(F.max_by("head_pid", "ord").alias("head_pid"))
    return top.select("bucket", F.when(F.col("head_pid") >= 0, F.col("head_pid")).alias("head_pid"))


def set_heads(heads: DataFrame, updates: DataFrame) -> DataFrame:
    new = last_heads(updates).select("bucket", F.col("head_pid").alias("new__"), F.lit(True).alias("hit__"))
    return heads.join(new, "bucket", "left").select("bucket", F.when(F.col("hit__"), F.col("new__")).otherwise(F.col("head_pid")).alias("head_pid"))


def assign_lsn(pages: DataFrame, after: int, order: list[Column], block: Column) -> DataFrame:
    """One LSN for each page image, in commit order."""
    return numbered(pages, order, block, "lsn").withColumn("lsn", F.col("lsn") + F.lit(after))
