"""Bloom filters of buckets over visible keys: one row a bucket, its bits as bytes.

A key sets bit (h1 + i * h2) mod 2^64 mod nbits for i below k, where h1 and h2 are XXH64 under two seeds. Bits are numbered
from the lowest of the first byte. Filters only grow: an update ORs the bits of new keys in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the filter: its seeds and its usual size.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BYTES, HASHES = 4096, 6


def bits_of(key: Column, bytes_each: int = BYTES, hashes: int = HASHES) -> Column:
    """The bits that a binary key sets, as an array."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(keys: pd.Series) -> pd.Series:
        import xxhash

        h1, h2 = (np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64) for seed in SEEDS)
        at = (h1[:, None] + np.arange(hashes, dtype=np.uint64) * h2[:, None]) % np.uint64(8 * bytes_each)
        return pd.Series(list(at.astype(np.int64)))

    return run(key)


def set_bits(keys: DataFrame, bytes_each: int = BYTES, hashes: int = HASHES) -> DataFrame:
    """(bucket, bit), each once, of rows (bucket, key)."""
    return keys.where(F.col("key").isNotNull()).select("bucket", F.explode(bits_of(F.col("key"), bytes_each, hashes)).alias("bit")).distinct()


def packed(bits: DataFrame, bytes_each: int = BYTES) -> DataFrame:
    """(bucket, bits as bytes) of rows (bucket, bit): words of 64 bits are ORed together, at most one row a word and bucket."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    words = bits.groupBy("bucket", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("w"))
    # a word's bytes stand lowest first
    digits = F.lpad(F.hex("w"), 16, "0")
    turned = F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8)))
    held = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", turned.alias("h")))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(bytes_each // 8 - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit("0" * 16)))
    return held.select("bucket", F.unhex(F.array_join(whole, "")).alias("bits"))


def built(keys: DataFrame, bytes_each: int = BYTES, hashes: int = HASHES) -> DataFrame:
    """(bucket, bits) of rows (bucket, key); buckets without keys have no row."""
    return packed(set_bits(keys, bytes_each, hashes), bytes_each)


def updated(filters: DataFrame, keys: DataFrame, bytes_each: int = BYTES, hashes: int = HASHES) -> DataFrame:
    """The filters with the bits of new keys (bucket, key) ORed in; empty keys add nothing."""
    new = built(keys.where(F.octet_length("key") > 0), bytes_each, hashes).withColumnRenamed("bits", "new__")
    byte = lambda c, k: F.conv(F.substring(F.hex(c), 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    both = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bytes_each - 1)), lambda k: F.lpad(F.hex(byte("bits", k).bitwiseOR(byte("new__", k))), 2, "0")), ""))
    rows = filters.select("bucket", "bits").join(new, "bucket", "full")
    return rows.select("bucket", F.when(F.col("bits").isNotNull() & F.col("new__").isNotNull(), both).otherwise(F.coalesce("bits", "new__")).alias("bits"))


def tested(filters: DataFrame, probes: DataFrame, bytes_each: int = BYTES, hashes: int = HASHES) -> DataFrame:
    """probes (bucket, key, ...) with maybe: false says that the key is not there; a bucket without a filter has no keys."""
    rows = probes.withColumn("at__", bits_of(F.col("key"), bytes_each, hashes)).join(filters.select("bucket", "bits"), "bucket", "left")
    byte = lambda b: F.conv(F.hex(F.substring(F.col("bits"), F.floor(b / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.forall("at__", lambda b: F.getbit(byte(b), (b % 8).cast("int")) == 1)
    return rows.withColumn("maybe", F.col("bits").isNotNull() & F.coalesce(on, F.lit(False))).drop("at__", "bits")


def freshness(found: int | None, buckets: int, last_lsn: int, made_for: int | None, made_at: int | None) -> str:
    """Why a filter may be used or not: absent, buckets_mismatch, stale_last_lsn or fresh."""
    if not found:
        return "absent"
    return "buckets_mismatch" if made_for != buckets else "fresh" if made_at == last_lsn else "stale_last_lsn"
