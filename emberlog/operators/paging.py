"""Records as binary pages and back, in frames: what the page sources read from files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.scalars import little_endian_bytes
from emberlog.sources import pages as P

#: Page ids of a bucket begin at its number times this.
OF_BUCKET = 1 << 32


def to_pages(rows: DataFrame, page_size: int) -> DataFrame:
    """(bucket, page_id, bytes) of records (bucket, key, value, expires_at_sec, tombstone, seq, lsn), filled greedily in order of seq.

    A page points at the one before it, so the last of a bucket is its head; its LSN is the largest of its records. Where the rows
    have them, chain_id and total_len put a placeholder in the value's place. Filling is sequential within a bucket, but
    streams: a task holds one page.
    """
    value = F.coalesce(F.col("value").cast("binary"), F.lit(bytearray()))
    if "chain_id" in rows.columns:
        stands = F.concat(F.lit(bytearray(P.CHAIN_TAG)), little_endian_bytes(F.col("total_len"), 8), little_endian_bytes(F.col("chain_id"), 8))
        value = F.when(F.col("chain_id").isNotNull(), stands).otherwise(value)
    cols = rows.select(F.col("bucket").cast("int").alias("bucket"), F.col("key").cast("binary").alias("key"), value.alias("value"), "expires_at_sec", "tombstone", "seq", "lsn")
    room = page_size - P.HEADER - P.TRAILER

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, number, held, used, lsn = None, 0, [], 0, 0

        def page() -> tuple:
            at = bucket * OF_BUCKET + number
            return bucket, at, P.kv_page(at, held, page_size, lsn, at - 1 if number else P.NONE)

        for part in parts:
            out = []
            for b, key, val, expires, tomb, _, own in part.itertuples(index=False):
                size = P.RECORD.size + len(key) + len(val)
                if held and (b != bucket or used + size + P.SLOT * (len(held) + 1) > room):
                    out.append(page())
                    number, held, used, lsn = (number + 1 if b == bucket else 0), [], 0, 0
                bucket = b
                held.append((bytes(key), bytes(val), int(expires), bool(tomb)))
                used, lsn = used + size, max(lsn, int(own))
            yield pd.DataFrame(out, columns=["bucket", "page_id", "bytes"])
        if held:
            yield pd.DataFrame([page()], columns=["bucket", "page_id", "bytes"])

    return cols.repartition("bucket").sortWithinPartitions("bucket", "seq").mapInPandas(run, "bucket int, page_id long, bytes binary")


def checked(pages: DataFrame) -> DataFrame:
    """The columns of the page source for rows (page_id, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [P.page_row(page, at) for at, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema=SCHEMA)

    return pages.select("page_id", "bytes").mapInArrow(run, P.PAGES)


NAMES = [c.split()[0] for c in P.PAGES.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in P.PAGES.split(", ")])


RECORD_NAMES = ["page_id", "slot", "lsn", "key", "value", "expires_at_sec", "tombstone", "ovf"]
CHAIN = pa.struct([("total_len", pa.int64()), ("chain_id", pa.int64())])
RECORD_SCHEMA = pa.schema(list(zip(RECORD_NAMES, [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), CHAIN], strict=True)))


def _decoded(pages: DataFrame, rows_of) -> DataFrame:
    """What rows_of(page) gives of sound pages (page_id, bytes); a page whose checksum does not hold is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for at, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                told = P.page_row(page, at)
                if not told[7]:
                    raise ValueError(f"page {told[0]}: {told[8]}")
                rows += [dict(zip(RECORD_NAMES, [*r[:7], None if r[7] is None else dict(zip(("total_len", "chain_id"), r[7], strict=True))], strict=True)) for r in rows_of(page)]
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD_SCHEMA)

    return pages.select("page_id", "bytes").mapInArrow(run, P.RECORDS)


def records(pages: DataFrame) -> DataFrame:
    """All records of key-value pages."""
    return _decoded(pages, lambda page: list(P.record_rows(page)))


def found(pages: DataFrame, key: bytes) -> DataFrame:
    """The newest record of a key on each page that has one; other records are not decoded."""
    return _decoded(pages, lambda page: [r for r in [P.find(page, key)] if r is not None])
