"""Storage statistics: small aggregates over the log and its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.scalars import ratio


def used_buckets(heads: DataFrame) -> DataFrame:
    return heads.agg(F.count("*").alias("buckets"), F.count("head_pid").alias("used_buckets"))


def chain_stats(log: DataFrame) -> DataFrame:
    """Pages of a chain over buckets that have any; zeros if none has."""
    per = log.groupBy("bucket").agg(F.count_distinct("page_id").alias("n"))
    zero = lambda c, kind, name: F.coalesce(c, F.lit(0)).cast(kind).alias(name)
    return per.agg(F.count("*").alias("buckets"), zero(F.min("n"), "long", "min_len"), zero(F.avg("n"), "double", "avg_len"), zero(F.max("n"), "long", "max_len"))


def chain_length(log: DataFrame, bucket: int) -> DataFrame:
    """Pages of one bucket; the predicate reaches the scan."""
    return log.where(F.col("bucket") == bucket).agg(F.count_distinct("page_id").alias("chain_len"))


def throughput(ops: DataFrame, by: str, at: str) -> DataFrame:
    """(by, ops, seconds, per_second) of operations with a Unix time in seconds; zero where all came at once."""
    span = (F.max(at) - F.min(at)).cast("double")
    return ops.groupBy(by).agg(F.count("*").alias("ops"), span.alias("seconds")).withColumn("per_second", ratio(F.col("ops"), F.col("seconds")))


def overflow_stats(parts: DataFrame) -> DataFrame:
    return parts.agg(F.count("*").alias("pages"), F.coalesce(F.sum("chunk_len"), F.lit(0)).cast("long").alias("bytes"))


def pack_stats(log: DataFrame) -> DataFrame:
    """Records of a page on average, and pages with one record."""
    per = log.groupBy("bucket", "page_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("pages"), ratio(F.sum("n"), F.count("*")).alias("avg_records"), F.count_if(F.col("n") == 1).alias("single_record_pages"))


def ratios(counters: DataFrame) -> DataFrame:
    """Hit ratios and mean batch pages of rows (name, hits, misses, pages, batches)."""
    return counters.select("name", ratio(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_ratio"), ratio(F.col("pages"), F.col("batches")).alias("avg_batch_pages"))


def status_json(one_row: DataFrame) -> DataFrame:
    return one_row.select(F.to_json(F.struct("*")).alias("status"))


def prometheus_text(one_row: DataFrame, prefix: str = "emberlog_") -> DataFrame:
    """One line a counter, names in alphabetical order."""
    lines = [F.concat(F.lit(f"{prefix}{c} "), F.col(c).cast("string")) for c in sorted(one_row.columns)]
    return one_row.select(F.explode(F.array(*lines)).alias("line"))


def stored_bytes(spark, path: str, pattern: str = "*") -> DataFrame:
    """Files and bytes under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
