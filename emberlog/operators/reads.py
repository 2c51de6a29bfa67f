"""Point and multi-key reads and scans over a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.scalars import display_text, prefix_predicate
from emberlog.operators.fold import newest, visible


def get(log: DataFrame, key: Column, now: int) -> DataFrame:
    """The visible record of one key: the predicate reaches the scan."""
    return visible(log.where(F.col("key") == key), now)


def exists(log: DataFrame, key: Column, now: int) -> DataFrame:
    """One row, found; no value is read."""
    return visible(log.where(F.col("key") == key).select("key", "expires_at_sec", "tombstone", "seq"), now).agg((F.count("*") > 0).alias("found"))


def get_many(log: DataFrame, probes: DataFrame, now: int) -> DataFrame:
    """(idx, key, value) for every probe, repeated ones too, null where nothing is visible.

    Only records of probed keys are ranked; Spark broadcasts the probes if they are small.
    """
    asked = log.join(probes.select("key"), "key", "left_semi")
    return probes.join(visible(asked, now).select("key", "value"), "key", "left").select("idx", "key", "value")


def exists_many(log: DataFrame, probes: DataFrame, now: int) -> DataFrame:
    asked = log.select("key", "expires_at_sec", "tombstone", "seq").join(probes.select("key"), "key", "left_semi")
    found = visible(asked, now).select("key", F.lit(True).alias("found"))
    return probes.join(found, "key", "left").select("idx", "key", F.coalesce("found", F.lit(False)).alias("found"))


def missing_many(log: DataFrame, probes: DataFrame, now: int) -> DataFrame:
    keys = visible(log.select("key", "expires_at_sec", "tombstone", "seq"), now).select("key")
    return probes.join(keys, "key", "left_anti").select("idx", "key")


def scan_all(log: DataFrame, now: int) -> DataFrame:
    return visible(log, now).select("key", "value", "expires_at_sec")


def scan_prefix(log: DataFrame, prefix: str | bytes, now: int) -> DataFrame:
    """Text keys by startswith, which Spark pushes; binary keys by a range, which it pushes too."""
    inside = F.col("key").startswith(prefix) if isinstance(prefix, str) else prefix_predicate(F.col("key"), prefix)
    return visible(log.where(inside), now).select("key", "value", "expires_at_sec")


def scan_json(rows: DataFrame) -> DataFrame:
    """One JSON line for each pair."""
    line = F.struct(F.lower(F.hex("key")).alias("key_hex"), F.lower(F.hex("value")).alias("value_hex"), F.octet_length("key").alias("key_len"), F.octet_length("value").alias("value_len"))
    return rows.select("key", F.to_json(line).alias("line"))


def scan_text(rows: DataFrame) -> DataFrame:
    """One readable line for each pair; bytes that are no UTF-8 are named by their number."""
    return rows.select("key", F.concat(display_text(F.col("key")), F.lit(" = "), display_text(F.col("value"))).alias("line"))


def keydir(log: DataFrame, now: int) -> DataFrame:
    """Where the deciding record of each key lies; page and slot are null under a tombstone."""
    at = newest(log.drop("value"), now)
    where = lambda c: F.when(~F.col("tombstone"), F.col(c).cast("long")).alias(c)
    return at.select("key", where("page_id"), where("slot"), F.when(F.col("tombstone"), "deleted").otherwise("located").alias("state"))


def as_of_lsn(log: DataFrame, lsn: int, now: int) -> DataFrame:
    return scan_all(log.where(F.col("lsn") <= lsn), now)


def stream(rows: DataFrame):
    """An iterator over pairs, a partition at a time in the driver; for callbacks on executors use foreachPartition."""
    return rows.toLocalIterator(prefetchPartitions=True)
