"""Large values: placement, chunking and reassembly. A placeholder is an explicit column, never bytes inside a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.scalars import PAGE_HEADER, PAGE_TRAILER, zstd_compress, zstd_decompress


def capacity(page_size: int) -> int:
    return page_size - PAGE_HEADER - PAGE_TRAILER


def placed(rows: DataFrame, threshold: int) -> DataFrame:
    """Adds value_len and placement (overflow above the threshold, else inline)."""
    n = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    return rows.withColumn("value_len", n).withColumn("placement", F.when(n > threshold, "overflow").otherwise("inline"))


def chunks(rows: DataFrame, page_size: int, codec: int = 0) -> DataFrame:
    """(chain_id, chunk_no, codec_id, chunk_len, payload) of the values of (chain_id, value) rows.

    With codec 1 a chunk is zstd-compressed where that makes it smaller.
    """
    cap = capacity(page_size)
    last = F.greatest(F.ceil(F.octet_length("value") / F.lit(cap)) - 1, F.lit(0)).cast("int")
    each = rows.select("chain_id", "value", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    raw = each.select("chain_id", "chunk_no", F.substring("value", F.col("chunk_no") * cap + 1, F.lit(cap)).alias("payload"))
    if codec:
        raw = raw.withColumn("packed", zstd_compress("payload"))
        raw = raw.withColumn("codec_id", (F.octet_length("packed") < F.octet_length("payload")).cast("int")).withColumn("payload", F.when(F.col("codec_id") == 1, F.col("packed")).otherwise(F.col("payload")))
    else:
        raw = raw.withColumn("codec_id", F.lit(0))
    return raw.select("chain_id", "chunk_no", "codec_id", F.octet_length("payload").alias("chunk_len"), "payload")


def reassembled(parts: DataFrame, zstd: bool = False) -> DataFrame:
    """(chain_id, value, total_len): chunks of a chain in order, put together."""
    if zstd:
        parts = parts.withColumn("payload", F.when(F.col("codec_id") == 1, zstd_decompress(F.when(F.col("codec_id") == 1, F.col("payload")))).otherwise(F.col("payload")))
    joined = parts.groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "payload"))).alias("p"))
    value = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["payload"])), ""))
    return joined.select("chain_id", value.alias("value")).withColumn("total_len", F.octet_length("value").cast("long"))


def bad_lengths(chains: DataFrame, parts: DataFrame) -> DataFrame:
    """Chains (chain_id, total_len) whose chunks do not add up to the stated length."""
    have = parts.groupBy("chain_id").agg(F.sum("chunk_len").cast("long").alias("found_len"))
    return chains.join(have, "chain_id", "left").withColumn("found_len", F.coalesce("found_len", F.lit(0).cast("long"))).where("total_len != found_len").select("chain_id", "total_len", "found_len")


def guarded(values: DataFrame, limit: int = 1 << 30) -> DataFrame:
    """Fails when a value is larger than the limit."""
    size = F.octet_length("value")
    return values.withColumn("value", F.when(F.coalesce(size, F.lit(0)) <= limit, F.col("value")).otherwise(F.raise_error(F.lit("value above the limit")).cast("binary")))


def inflated(parts: DataFrame) -> DataFrame:
    """Chunks with chunk_len as the length of what they stand for."""
    packed = F.col("codec_id") == 1
    plain = F.when(packed, zstd_decompress(F.when(packed, F.col("payload")))).otherwise(F.col("payload"))
    return parts.withColumn("payload", plain).withColumn("codec_id", F.lit(0)).withColumn("chunk_len", F.octet_length("payload"))


def expanded(chains: DataFrame, parts: DataFrame, max_bytes: int = 1 << 30, max_chunks: int = 1_000_000, zstd: bool = True) -> DataFrame:
    """(chain_id, value) of chains (chain_id, total_len): a chain above either limit, or of another length, is an error.

    The limits are held against the stated length and the number of chunks before any chunk is put together.
    """
    counts = parts.groupBy("chain_id").agg(F.count("*").alias("n__"))
    held = chains.join(counts, "chain_id", "left")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("chain_id").cast("string")))
    sound = F.when(F.col("total_len") > max_bytes, fail("value above the limit: chain ")).when(F.coalesce("n__", F.lit(0)) > max_chunks, fail("too many chunks: chain "))
    checked = held.withColumn("bad__", sound.cast("string")).where(F.col("bad__").isNull()).select("chain_id", "total_len")
    whole = reassembled(parts.join(checked.select("chain_id"), "chain_id", "left_semi"), zstd).withColumnRenamed("total_len", "found__")
    got = checked.join(whole, "chain_id", "left")
    ok = F.coalesce(F.col("found__"), F.lit(0)) == F.col("total_len")
    return got.select("chain_id", F.when(ok, F.col("value")).otherwise(fail("another length than stated: chain ").cast("binary")).alias("value"))
