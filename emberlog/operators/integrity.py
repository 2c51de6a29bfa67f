"""Audits over page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.ordered import max_before
from emberlog.functions.scalars import page_location, unwrapped_key
from emberlog.sources.pages import KV, OVERFLOW

#: LSNs of one block when pages are matched with key epochs.
EPOCH_BLOCK = 1 << 16


def classified(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Adds status: ok, zero_checksum, crc_fail or io_fail; an error that speaks of a checksum or tag is a crc_fail."""
    said = F.lower(F.coalesce("err", F.lit("")))
    crc = said.contains("checksum") | said.contains("tag")
    zero = F.col("zero_crc")
    return pages.withColumn("status", F.when(zero, "crc_fail" if strict else "zero_checksum").when(F.col("ok"), "ok").when(crc, "crc_fail").otherwise("io_fail")).withColumn("zero", zero)


def doctor(pages: DataFrame, strict: bool = False) -> DataFrame:
    """One pass of conditional counts. Zero checksums are counted on their own; strict ones fail too."""
    rows = classified(pages, strict)
    is_ = lambda s: F.count_if(F.col("status") == s)
    ok = F.col("status") == "ok"
    return rows.agg(
        F.count("*").alias("pages_total"), is_("ok").alias("ok_pages"), F.count_if("zero").alias("zero_checksum"), is_("crc_fail").alias("crc_fail"), is_("io_fail").alias("io_fail"),
        F.count_if(ok & (F.col("page_type") == KV)).alias("kv_pages"), F.count_if(ok & (F.col("page_type") == OVERFLOW)).alias("overflow_pages"),
        F.count_if(ok & F.col("page_type").isNotNull() & ~F.col("page_type").isin(KV, OVERFLOW)).alias("other_magic"), F.count_if(ok & F.col("page_type").isNull()).alias("no_magic"),
    )


def inventory(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.coalesce(F.col("page_type"), F.lit(0)).alias("page_type")).agg(F.count("*").alias("pages"), F.max("lsn").alias("last_lsn"), F.coalesce(F.sum("bytes_len"), F.lit(0)).cast("long").alias("bytes"))


def trusted(tag_ok: Column, crc_ok: Column, lsn: Column, since: Column, strict: bool = False) -> Column:
    """tag, crc or none: a page older than the newest key epoch may fall back to its checksum unless strict."""
    old = F.lit(not strict) & crc_ok & (since.isNull() | (lsn < since))
    return F.when(tag_ok & since.isNotNull() & (lsn >= since), "tag").when(old, "crc").otherwise("none")


def epoch_of(pages: DataFrame, epochs: DataFrame) -> DataFrame:
    """The key epoch of each page: the last with since_lsn <= lsn; pages before the first have none.

    Both sides are dealt by coarse blocks of LSNs; an epoch that still holds when a later block begins goes to the blocks
    where none begins too, by the same running maximum over the table of blocks. Nothing is collected or crossed.
    """
    width = F.lit(EPOCH_BLOCK)
    kind = F.struct(F.col("since_lsn").alias("since"), F.col("kid"))
    both = epochs.select(F.col("since_lsn").alias("lsn"), F.lit(0).alias("is_page"), kind.alias("e")).unionByName(pages.select("lsn", F.lit(1).alias("is_page"), F.lit(None).cast(epochs.select(kind.alias("e")).schema["e"].dataType).alias("e"), F.struct("*").alias("row")), allowMissingColumns=True)
    order = F.struct("lsn", "is_page")
    held = max_before(both, F.col("e"), order, F.floor(F.col("lsn") / width), [], "last").where("is_page = 1")
    return held.select("row.*", F.col("last.kid").alias("kid"))


def valid_epochs(epochs: DataFrame) -> DataFrame:
    """Rows whose since_lsn does not grow strictly over all before, by ord."""
    held = max_before(epochs, F.col("since_lsn"), F.col("ord"), F.floor(F.col("ord") / F.lit(EPOCH_BLOCK)), [], "before")
    return held.where("before >= since_lsn")


def last_keys(entries: DataFrame) -> DataFrame:
    """(kid, wrapped) of a key ring (ord, kid, wrapped): the last entry of each key id wins."""
    return entries.groupBy("kid").agg(F.max_by("wrapped", "ord").alias("wrapped"))


def key_id(explicit: str | None, journal: DataFrame | None, default: str | None) -> str:
    """Which key is used: the one asked for, else the journal's last (since_lsn, kid), else the environment's, else `default`."""
    if explicit is not None:
        return explicit
    last = journal.agg(F.max_by("kid", "since_lsn")).first()[0] if journal is not None else None
    return last if last is not None else default if default is not None else "default"


def data_key(kid: str, ring: DataFrame | None, kek: bytes | None, static: bytes | None) -> bytes:
    """The 32 bytes of a key: unwrapped from the ring's last entry, or the environment's where the ring has none."""
    row = last_keys(ring.where(F.col("kid") == kid)).first() if ring is not None else None
    if row is not None:
        if kek is None:
            raise ValueError(f"key {kid} is wrapped and there is no key to unwrap it")
        one = ring.sparkSession.createDataFrame([(bytearray(row.wrapped), bytearray(kek))], "wrapped binary, kek binary")
        found = bytes(one.select(unwrapped_key(F.col("wrapped"), F.col("kek"))).first()[0])
    elif static is not None:
        found = static
    else:
        raise KeyError(kid)
    if len(found) != 32:
        raise ValueError(f"key {kid} has {len(found)} bytes, not 32")
    return found


def unallocated(pages: DataFrame, next_page_id: int, segment_bytes: DataFrame | None = None, page_size: int = 65536) -> DataFrame:
    """Page ids (page_id) that must not be read: at or beyond the next one to be given out.

    With the bytes (segment, bytes) of segments the lenient rule holds: such a page may be read where its segment has it whole.
    """
    beyond = pages.where(F.col("page_id") >= next_page_id)
    if segment_bytes is None:
        return beyond
    at = beyond.withColumn("at__", page_location(F.col("page_id"), page_size)).withColumn("segment", F.col("at__.segment"))
    held = at.join(segment_bytes.select("segment", F.col("bytes").alias("held__")), "segment", "left")
    return held.where(F.coalesce("held__", F.lit(0)) < F.col("at__.offset") + page_size).select(pages.columns)
