"""Content-addressed snapshots: objects by SHA-256, reference counts derived from manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.ordered import numbered_by


def objects_of(pages: DataFrame) -> DataFrame:
    """(page_id, hash_hex, bytes) of readable pages."""
    return pages.where("ok").select("page_id", F.sha2("content", 256).alias("hash_hex"), F.octet_length("content").cast("long").alias("bytes"))


#: Puts of one block of their order.
BLOCK = 65536


def put_trace(puts: DataFrame) -> DataFrame:
    """(ord, hash_hex, existed_before, refcount) of objects put one after another."""
    rows = numbered_by(puts.select("ord", F.sha2("content", 256).alias("hash_hex")), ["hash_hex"], F.col("ord"), F.floor(F.col("ord") / BLOCK), "refcount")
    return rows.select("ord", "hash_hex", (F.col("refcount") > 1).alias("existed_before"), "refcount")


def deduplicated(puts: DataFrame) -> DataFrame:
    """One row for each content, with its size."""
    return puts.select(F.sha2("content", 256).alias("hash_hex"), F.octet_length("content").cast("long").alias("bytes")).groupBy("hash_hex").agg(F.min("bytes").alias("bytes"))


def refcounts(manifest_objects: DataFrame) -> DataFrame:
    return manifest_objects.groupBy("hash_hex").agg(F.count("*").alias("refcount"))


def collectable(manifest_objects: DataFrame, deleted: str) -> DataFrame:
    """Objects that nothing refers to once snapshot `deleted` is gone."""
    gone = manifest_objects.where(F.col("snapshot_id") == deleted).select("hash_hex").distinct()
    rest = manifest_objects.where(F.col("snapshot_id") != deleted).select("hash_hex").distinct()
    return gone.join(rest, "hash_hex", "left_anti")


def manifest(objects: DataFrame, heads: DataFrame, meta: dict) -> DataFrame:
    """One row in the manifest's JSON shape (meta, heads, objects), for export: as large as the number of pages. Within the engine manifests are tables of objects, a row each."""
    parts = objects.agg(F.sort_array(F.collect_list(F.struct("page_id", "hash_hex", "bytes"))).alias("objects")).withColumn("one__", F.lit(1))
    of_heads = heads.agg(F.sort_array(F.collect_list(F.struct("bucket", "head_pid"))).alias("heads")).withColumn("one__", F.lit(1))
    told = F.struct(*(F.lit(v).alias(k) for k, v in meta.items()))
    return parts.join(of_heads, "one__").select(told.alias("meta"), "heads", "objects")


def listed(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.col("snapshot_id")).distinct().orderBy("snapshot_id")


def restored(manifest_objects: DataFrame, store: DataFrame, snapshot_id: str, verify: bool = False, page_size: int | None = None) -> DataFrame:
    """(page_id, hash_hex, content) of a snapshot; an object that the store lacks is an error.

    With `verify`, so is one whose content has another hash, or another length than page_size if that is given.
    """
    wanted = manifest_objects.where(F.col("snapshot_id") == snapshot_id).select("page_id", "hash_hex")
    found = wanted.join(store.select("hash_hex", "content"), "hash_hex", "left")
    kind = store.schema["content"].dataType
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("hash_hex"))).cast(kind)
    content = F.when(F.col("content").isNull(), fail("object missing: "))
    if verify:
        content = content.when(F.sha2("content", 256) != F.col("hash_hex"), fail("content of another hash: "))
    if page_size is not None:
        content = content.when(F.octet_length("content") != page_size, fail("content of another length: "))
    return found.select("page_id", "hash_hex", content.otherwise(F.col("content")).alias("content"))


def same_geometry(manifest: dict, page_size: int, buckets: int) -> None:
    """Fails where a snapshot's pages or buckets are not the destination's."""
    for name, own in (("page_size", page_size), ("buckets", buckets)):
        if manifest[name] != own:
            raise ValueError(f"{name} {own} here, {manifest[name]} in the snapshot")


def sizes(store: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash_hex, bytes) of asked objects, null for those that the store lacks."""
    return hashes.join(store.select("hash_hex", F.octet_length("content").cast("long").alias("bytes")), "hash_hex", "left")


def present(store: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash_hex, found) of asked objects; no content is read."""
    held = store.select("hash_hex").distinct().withColumn("found", F.lit(True))
    return hashes.join(held, "hash_hex", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def fetched(store: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash_hex, content) of asked objects, null for those that the store lacks."""
    return hashes.join(store.select("hash_hex", "content"), "hash_hex", "left")
