"""Change shipping and idempotent apply, batch form. Every gate is a running maximum over arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.ordered import max_before, numbered
from emberlog.sources.wal import HEADER, HEADS, IMAGE, MAGIC, TRUNCATE

#: Bytes of one entry of a heads payload: a bucket and a page id.
HEAD_ENTRY = 12


def ship_since(frames: DataFrame, since: int, inclusive: bool = False) -> DataFrame:
    """Frames to ship; the LSN predicate reaches the scan."""
    return frames.where(F.col("lsn") >= since if inclusive else F.col("lsn") > since)


def ship_summary(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("frames"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.max("lsn"), F.lit(0)).cast("long").alias("last_lsn"))


def with_seq(frames: DataFrame, after: int, order: list[Column], block: Column) -> DataFrame:
    return numbered(frames, order, block, "seq").withColumn("seq", F.col("seq") + F.lit(after))


def seq_gate(frames: DataFrame, floor: int, block: Column, by: list[str]) -> DataFrame:
    """Frames whose seq is above every earlier one's of their stream and above the floor.

    The running maximum over all frames equals the one over accepted frames, so a window is enough.
    """
    gated = max_before(frames, F.col("seq"), F.col("ord"), block, by, "top")
    return gated.where(F.col("seq") > F.greatest(F.coalesce("top", F.lit(floor)), F.lit(floor))).drop("top")


def violations(frames: DataFrame, floor: int, block: Column, by: list[str]) -> DataFrame:
    gated = max_before(frames, F.col("seq"), F.col("ord"), block, by, "top")
    return gated.where(F.col("seq") <= F.greatest(F.coalesce("top", F.lit(floor)), F.lit(floor))).drop("top")


def foreign(frames: DataFrame, stream_id: str | None) -> DataFrame:
    """Frames of another stream than the one held; zero or null is never valid."""
    bad = F.col("stream_id").isNull() | (F.col("stream_id") == "0")
    return frames.where(bad if stream_id is None else bad | (F.col("stream_id") != stream_id))


def applied_pages(frames: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The image that stays for each page: the greatest LSN, the first arrival of equals; what is there already wins ties."""
    rows = frames.select("page_id", "lsn", "ord", "payload")
    if current is not None:
        rows = rows.unionByName(current.select("page_id", "lsn", F.lit(-1).cast("long").alias("ord"), "payload"))
    w = Window.partitionBy("page_id").orderBy(F.col("lsn").desc(), F.col("ord").asc())
    return rows.withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")


def heads_valid() -> Column:
    n = F.coalesce(F.octet_length("payload"), F.lit(0))
    return (n > 0) & (n % HEAD_ENTRY == 0)


def bad_heads(frames: DataFrame) -> DataFrame:
    return frames.where(~heads_valid())


def little_endian(digits: Column, at: Column, n: int) -> Column:
    """Unsigned integer of n bytes from hex digits, `at` counted in bytes from 1; within a signed 64-bit range (an all-ones value becomes -1)."""
    turned = F.concat(*(F.substring(digits, 2 * (at + (n - 1 - k)) - 1, F.lit(2)) for k in range(n)))
    return F.when(turned == "F" * 2 * n, F.lit(-1).cast("long")).otherwise(F.conv(turned, 16, 10).cast("decimal(20,0)").cast("long"))


def decoded_heads(frames: DataFrame) -> DataFrame:
    """(lsn, ord, i, bucket, head_pid) of valid payloads of 12-byte entries; a payload is turned into digits once, then cut into entries."""
    digits = frames.where(heads_valid()).select("lsn", "ord", F.hex("payload").alias("h"))
    entries = F.split(F.regexp_replace("h", f"(.{{{2 * HEAD_ENTRY}}})(?=.)", "$1,"), ",")
    each = digits.select("lsn", "ord", F.posexplode(entries).alias("i", "e"))
    one = lambda n: F.lit(n)
    return each.select("lsn", "ord", "i", little_endian(F.col("e"), one(1), 4).cast("int").alias("bucket"), little_endian(F.col("e"), one(5), 8).alias("head_pid"))


def applied_heads(frames: DataFrame, floor: int, block: Column) -> DataFrame:
    """(bucket, head_pid) after all heads frames that the LSN gate lets pass; later entries win."""
    good = frames.where(heads_valid()).withColumn("one__", F.lit(1))
    gated = max_before(good, F.col("lsn"), F.col("ord"), block, ["one__"], "top")
    passed = gated.where(F.col("lsn") > F.greatest(F.coalesce("top", F.lit(floor)), F.lit(floor)))
    last = decoded_heads(passed).groupBy("bucket").agg(F.max_by("head_pid", F.struct("ord", "i")).alias("head_pid"))
    return last.select("bucket", F.when(F.col("head_pid") >= 0, F.col("head_pid")).alias("head_pid"))


def mid_headers(frames: DataFrame, by: str = "stream_id", block: Column | None = None) -> DataFrame:
    """Repeated stream headers (rec_type 0) and whether they may be skipped: right after a truncation, or first of all.

    The frame before is the last in the order of (ord, rec_type), found block by block, so a hot stream is no single task.
    """
    block = F.floor(F.col("ord") / F.lit(1 << 32)) if block is None else block
    rows = max_before(frames, F.struct("ord", "rec_type"), F.col("ord"), block, [by], "before").where("rec_type = 0")
    return rows.select(by, "ord", (F.col("before").isNull() | (F.col("before.rec_type") == TRUNCATE)).alias("skipped"))


def progress(frames: DataFrame, by: list[str]) -> DataFrame:
    return frames.groupBy(*by).agg(F.max("lsn").alias("last_lsn"), F.max(F.when(F.col("rec_type") == HEADS, F.col("lsn"))).alias("last_heads_lsn"), F.count("*").alias("frames"))


def replayed(frames: DataFrame, current: DataFrame) -> DataFrame:
    """Page state after a crash: images are gated by LSN, a commit record is not required."""
    return applied_pages(frames.where(F.col("rec_type") == IMAGE), current)


def oversized(frames: DataFrame, page_size: int, buckets: int) -> DataFrame:
    """Frames above the largest that a sound stream can hold."""
    cap = min(28 + max(page_size, buckets * HEAD_ENTRY) + (64 << 10), 32 << 20)
    return frames.where(F.octet_length("payload") > cap)


def without_hello(frames: DataFrame, header_len: int = HEADER) -> DataFrame:
    """Streams whose first frame is not the log's header."""
    first = frames.groupBy("stream_id").agg(F.min_by("payload", "ord").alias("first"))
    magic = F.substring(F.col("first"), 1, 8) == F.lit(bytearray(MAGIC))
    return first.where(~((F.octet_length("first") == header_len) & magic)).select("stream_id")
