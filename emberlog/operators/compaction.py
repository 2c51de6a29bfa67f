"""Compaction, maintenance and orphan sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.fold import newest, visible


def survivors(log: DataFrame, now: int, reset_ttl: bool = False) -> DataFrame:
    """What a compaction writes: visible records, their expiry kept unless reset_ttl."""
    rows = visible(log, now).select("bucket", "key", "value", "expires_at_sec")
    return rows.withColumn("expires_at_sec", F.lit(0).cast("long")) if reset_ttl else rows


def write_compacted(log: DataFrame, now: int, path: str, files: int) -> None:
    """Survivors dealt by ranges of bucket and key and sorted, so that Parquet statistics prune later reads and a hot bucket fills several files."""
    survivors(log, now).repartitionByRange(files, "bucket", "key").sortWithinPartitions("bucket", "key").write.mode("overwrite").parquet(path)


def bucket_reports(log: DataFrame, now: int, page_records: int) -> DataFrame:
    """Per bucket: pages before, keys kept and deleted, pages after at page_records records each."""
    before = log.groupBy("bucket").agg(F.count_distinct("page_id").alias("old_chain_len"))
    top = newest(log.drop("value"), now).groupBy("bucket").agg(F.count_if(~F.col("tombstone")).alias("keys_kept"), F.count_if("tombstone").alias("keys_deleted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return before.join(top, "bucket", "left").select("bucket", "old_chain_len", zero("keys_kept"), zero("keys_deleted")).withColumn("pages_written", F.ceil(F.col("keys_kept") / F.lit(page_records)).cast("long"))


def summary(reports: DataFrame) -> DataFrame:
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return reports.agg(F.count("*").alias("buckets_compacted"), add("old_chain_len"), add("keys_kept"), add("keys_deleted"), add("pages_written"))


def vacuum(reports: DataFrame, orphans: DataFrame) -> DataFrame:
    """The summary and the pages that the sweep frees; both are single rows."""
    freed = orphans.agg(F.count("*").alias("overflow_pages_freed"))
    return summary(reports).withColumn("one__", F.lit(1)).join(freed.withColumn("one__", F.lit(1)), "one__").drop("one__")


def first_buckets(heads: DataFrame, n: int) -> DataFrame:
    """The first n buckets that have pages, in order: a top-n, no full sort."""
    return heads.where("head_pid is not null").select("bucket").orderBy("bucket").limit(n)


def auto_maintenance(log: DataFrame, heads: DataFrame, n: int, now: int, page_records: int) -> DataFrame:
    return bucket_reports(log.join(F.broadcast(first_buckets(heads, n)), "bucket", "left_semi"), now, page_records)


def auto_summary(reports: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """What a round of maintenance did: buckets looked at and written, pages written, overflow pages freed by a sweep."""
    done = reports.agg(F.count("*").alias("buckets_scanned"), F.count_if(F.col("pages_written") > 0).alias("buckets_compacted"), F.coalesce(F.sum("pages_written"), F.lit(0)).cast("long").alias("pages_written_sum"))
    if orphans is None:
        return done.withColumn("overflow_pages_freed", F.lit(0).cast("long"))
    freed = orphans.agg(F.count("*").alias("overflow_pages_freed")).withColumn("one__", F.lit(1))
    return done.withColumn("one__", F.lit(1)).join(freed, "one__").drop("one__")


def long_chains(log: DataFrame, threshold: int = 64) -> DataFrame:
    return log.groupBy("bucket").agg(F.count_distinct("page_id").alias("chain_len")).where(F.col("chain_len") >= threshold)


def orphans(ovf_pages: DataFrame, log: DataFrame) -> DataFrame:
    """Overflow pages of chains that no record names; old versions count as references. Running it twice frees nothing new."""
    named = log.where(~F.col("tombstone") & F.col("chain_id").isNotNull()).select("chain_id").distinct()
    return ovf_pages.join(named, "chain_id", "left_anti")


def packed(rows: DataFrame, page_size: int, data: Column, by: str = "bucket") -> DataFrame:
    """(bucket, page_no, records, data_bytes) by greedy filling: a page takes records while 64 + data + 6 a record + 16 fits.

    Filling is sequential within a bucket; the rows are numbers only and stream through in order, bucket by bucket.
    """
    sized = rows.select(by, "seq", data.cast("long").alias("size__")).repartition(by).sortWithinPartitions(by, "seq")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, page, n, used = None, 0, 0, 0
        for part in parts:
            out = []
            for b, size in zip(part[by].tolist(), part["size__"].tolist(), strict=True):
                if at is not None and (b != at or 64 + used + size + 6 * (n + 1) + 16 > page_size):
                    out.append((at, page, n, used))
                    page, n, used = (page + 1 if b == at else 0), 0, 0
                at, n, used = b, n + 1, used + size
            yield pd.DataFrame(out, columns=[by, "page_no", "records", "data_bytes"])
        if at is not None:
            yield pd.DataFrame([(at, page, n, used)], columns=[by, "page_no", "records", "data_bytes"])

    return sized.mapInPandas(run, f"{by} int, page_no long, records long, data_bytes long")
