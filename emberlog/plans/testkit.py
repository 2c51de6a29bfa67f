"""The log model derived from the driver's tables; every query runs over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.scalars import bucket_of, seconds_of

NOW, BUCKETS, PAGE_RECORDS, PAGE_SIZE, THRESHOLD = 1706745600, 32, 16, 4096, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or of the machine's own where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ev_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of users: views expire after up to nine days, errors delete."""
    e = table(spark, sf_dir, "events")
    key = F.col("user_id").cast("string")
    expires = F.when(F.col("event_type") == "view", seconds_of(F.col("ts")) + 86400 * (F.col("event_id") % 10)).otherwise(F.lit(0).cast("long"))
    return e.select(key.alias("key"), F.col("props").alias("value"), expires.alias("expires_at_sec"), (F.col("event_type") == "error").alias("tombstone"), F.col("event_id").alias("seq"), F.col("event_id").alias("lsn"), bucket_of(key, BUCKETS).alias("bucket"))


def ev_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with page_id and slot: pages of PAGE_RECORDS records in write order of a bucket."""
    w = Window.partitionBy("bucket").orderBy("seq")
    rn = F.row_number().over(w) - 1
    return ev_log(spark, sf_dir).withColumn("rn__", rn).withColumn("page_id", F.floor(F.col("rn__") / PAGE_RECORDS).cast("long")).withColumn("slot", (F.col("rn__") % PAGE_RECORDS).cast("int")).drop("rn__")


def conv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return c.select(key.alias("key"), F.col("text").alias("value"), F.lit(0).cast("long").alias("expires_at_sec"), (F.col("role") == "system").alias("tombstone"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), bucket_of(key, BUCKETS).alias("bucket"))


def doc_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chain_id"), F.encode("text", "UTF-8").alias("value"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("idx"), (F.col("c_custkey") % 400).cast("string").alias("key"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of eight streams, out of order by up to 64 places: ord is the arrival."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", 6).when(F.col("event_type") == "error", 5).when(F.col("event_type") == "purchase", 4).otherwise(2)
    late = F.pmod(F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 4), 16, 10).cast("long"), F.lit(64))
    return e.select((F.col("user_id") % 8).cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("lsn"), ((F.col("event_id") + late) * 1000000 + F.col("event_id")).alias("ord"), kind.alias("rec_type"), F.col("user_id").alias("page_id"), F.octet_length("props").cast("long").alias("len"), F.col("props").alias("payload"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image for each part; a few broken in each way."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    err = F.when(k % 11 == 0, "bad checksum").when(k % 13 == 0, "short read").when(k % 17 == 0, "tag mismatch")
    kind = F.when(k % 5 == 0, F.lit(3)).when(k % 7 == 0, F.lit(None)).when(k % 19 == 0, F.lit(9)).otherwise(F.lit(2))
    content = F.concat("p_name", F.lit("|"), "p_brand", F.lit("|"), "p_type")
    return p.select(k.alias("page_id"), kind.cast("int").alias("page_type"), (k * 3).alias("lsn"), content.alias("content"), F.octet_length(content).cast("long").alias("bytes_len"), err.isNull().alias("ok"), err.alias("err"), (k % 23 == 0).alias("zero_crc"))


def manifest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots s0..s4 of document pages; copies share objects."""
    d = table(spark, sf_dir, "documents")
    snap = F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"))
    return d.select(snap.alias("snapshot_id"), F.col("doc_id").alias("page_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("hash_hex"), F.octet_length("text").cast("long").alias("bytes"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buckets, with the last page of those that have any."""
    last = ev_pages(spark, sf_dir).groupBy("bucket").agg(F.max("page_id").alias("head_pid"))
    return spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(last, "bucket", "left")
