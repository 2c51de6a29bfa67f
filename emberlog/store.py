"""A log on disk: the operators behind one handle.

    <path>/_config.json                           the options it was created with
    <path>/_at/<n>                                pointers: generation n, with the seq and LSN that were last when it began
    <path>/log/gen=<n>/commit=<lsn>/*.parquet     its rows; every commit is a folder of its own, named by its last LSN
    <path>/chunks/commit=<lsn>/*.parquet          chunks of large values; the log holds (chain_id, total_len) in their place
    <path>/snapshots/id=<id>/*.json               manifests: generation, LSN, message, labels, parent
    <path>/bloom/...                              filters of the buckets over the visible keys
    <path>/_epochs/<lsn>                          from which LSN on each key id holds

A commit's rows land as a whole or not at all, by Spark's output commit; its chunks are written before, and a sweep takes
what no record names. Pointers are only ever added, under a temporary name and renamed, and the highest counts: a crash at
any point leaves the old generation or the new one. Seq and LSN never go back, whatever a compaction leaves out, as the
pointer keeps them. Compaction writes the next generation, dealt by ranges of bucket and key, and keeps tombstones, so that
replicas still hear of deletes; `forget` says up to which LSN all replicas have heard. A snapshot pins a generation up to
an LSN, which costs no copy; vacuum drops generations that nothing pins. One writer at a time is assumed. Paths are any
that Spark can write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.config import Config
from emberlog.functions.scalars import bucket_of
from emberlog.operators import bloom, compaction, fold, overflow, reads, snapshots, stats, writes

ROWS = "key BINARY, value BINARY, expires_at_sec BIGINT, tombstone BOOLEAN, seq BIGINT, lsn BIGINT, bucket INT, chain_id BIGINT, total_len BIGINT"
CHUNKS = "chain_id BIGINT, chunk_no INT, codec_id INT, chunk_len INT, payload BINARY"
SHIPPED = "key BINARY, value BINARY, expires_at_sec BIGINT, tombstone BOOLEAN, seq BIGINT, lsn BIGINT"
MANIFEST = "id STRING, parent STRING, message STRING, labels ARRAY<STRING>, created_unix_ms BIGINT, generation BIGINT, lsn BIGINT, seq BIGINT, buckets INT, page_size INT, heads ARRAY<STRUCT<bucket: INT, records: BIGINT>>"
ONE = "key binary, value binary, expires_at_sec long, tombstone boolean, seq long"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.config = Config.from_json(self._text("_config.json")) if self._has("_config.json") else Config()

    # ---- files

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 128, config: Config | None = None) -> Store:
        """An empty store; an existing one is an error."""
        store = cls(spark, path)
        if store._has("_at"):
            raise FileExistsError(path)
        store.config = config or Config(buckets=buckets)
        store._put("_config.json", store.config.to_json())
        store._fs.mkdirs(store._path(store._generation(1)))
        store._point(1, 0, 0)
        return store

    def _has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _put(self, name: str, text: str) -> None:
        """Written beside and renamed to a name that was not there."""
        new, at = self._path(f"{self.path}/_new.{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        out = self._fs.create(new)
        out.write(text.encode())
        out.close()
        self._fs.mkdirs(at.getParent())
        if not self._fs.rename(new, at):
            raise OSError(f"cannot move {new} to {at}")

    def _text(self, name: str) -> str:
        at = self._path(f"{self.path}/{name}")
        stream = self._fs.open(at)
        try:
            return bytes(stream.readNBytes(self._fs.getFileStatus(at).getLen())).decode()
        finally:
            stream.close()

    def _generation(self, n: int) -> str:
        return f"{self.path}/log/gen={n:08d}"

    def _point(self, n: int, seq: int, lsn: int) -> None:
        self._put(f"_at/{n:08d}", json.dumps({"seq": seq, "lsn": lsn}))

    def generation(self) -> int:
        return int(self._names(f"{self.path}/_at")[-1])

    def commits(self, generation: int | None = None) -> list[int]:
        """LSNs that the commits of a generation end with; folders of commits that never landed are left out."""
        folder = self._generation(generation or self.generation())
        found = [x for x in self._names(folder) if x.startswith("commit=")]
        return [int(x.split("=")[1]) for x in found if self._fs.exists(self._path(f"{folder}/{x}/_SUCCESS"))]

    def log(self, generation: int | None = None, after: int = -1) -> DataFrame:
        """Rows of the commits that end beyond `after`; values of large records are null (see values())."""
        generation = generation or self.generation()
        paths = [f"{self._generation(generation)}/commit={n:020d}" for n in self.commits(generation) if n > after]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def chunks(self) -> DataFrame:
        folder = f"{self.path}/chunks"
        paths = [f"{folder}/{x}" for x in self._names(folder) if self._fs.exists(self._path(f"{folder}/{x}/_SUCCESS"))]
        return self.spark.read.schema(CHUNKS).parquet(*paths) if paths else self.spark.createDataFrame([], CHUNKS)

    def last(self) -> tuple[int, int]:
        """(seq, lsn) of the last commit: from the names of the commits, and of rows those of the last one only."""
        n = self.generation()
        at, commits = json.loads(self._text(f"_at/{n:08d}")), self.commits(n)
        if not commits:
            return at["seq"], at["lsn"]
        seq, lsn = self.log(n, commits[-1] - 1).agg(F.max("seq"), F.max("lsn")).first()
        return max(at["seq"], seq or 0), max(at["lsn"], lsn or 0, commits[-1])

    # ---- writes

    def _append(self, rows: DataFrame, lsn: Column, last: int) -> int:
        """Rows (key, value, expires_at_sec, tombstone, seq) as one commit; large values become chunks, named by their seq."""
        key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
        rows = rows.select(key.alias("key"), value.alias("value"), F.col("expires_at_sec").cast("long").alias("expires_at_sec"), "tombstone", F.col("seq").cast("long").alias("seq"), lsn.cast("long").alias("lsn"), bucket_of(key, self.config.buckets).alias("bucket"))
        placed = overflow.placed(rows, self.config.threshold)
        big = F.col("placement") == "overflow"
        if placed.where(big).limit(1).count():
            parts = overflow.chunks(placed.where(big).select(F.col("seq").alias("chain_id"), "value"), self.config.page_size, int(self.config.zstd))
            parts.write.mode("overwrite").parquet(f"{self.path}/chunks/commit={last:020d}")
        full = placed.select("key", F.when(~big, F.col("value")).alias("value"), "expires_at_sec", "tombstone", "seq", "lsn", "bucket", F.when(big, F.col("seq")).alias("chain_id"), F.when(big, F.col("value_len")).alias("total_len"))
        full.write.mode("overwrite").parquet(f"{self._generation(self.generation())}/commit={last:020d}")
        return last

    def _one(self, key: bytes, value: bytes | None, expires_at_sec: int, tombstone: bool) -> int:
        seq, lsn = self.last()
        row = (bytearray(key), None if value is None else bytearray(value), expires_at_sec, tombstone, seq + 1)
        return self._append(self.spark.createDataFrame([row], ONE), F.lit(lsn + 1), lsn + 1)

    def put(self, key: bytes, value: bytes, expires_at_sec: int = 0) -> int:
        """The commit's LSN."""
        return self._one(key, value, expires_at_sec, False)

    def delete(self, key: bytes, now: int) -> bool:
        """Whether the key was visible; a tombstone is written either way."""
        found = self.exists(key, now)
        self._one(key, None, 0, True)
        return found

    def batch(self, ops: DataFrame, now: int | None = None) -> int:
        """Operations (ord, op, key, value, expires_at_sec) as one commit, in order of ord. With `now` and the option compact_at, buckets that have grown long are compacted after it."""
        seq, lsn = self.last()
        done = self._append(writes.op_rows(ops, seq, [F.col("ord")], F.floor(F.col("ord") / writes.BLOCK)), F.lit(lsn + 1), lsn + 1)
        if now is not None and self.config.compact_at is not None:
            touched = self.log(after=lsn).select("bucket").distinct()
            long = [r.bucket for r in compaction.long_chains(self._pages(), self.config.compact_at).join(touched, "bucket", "left_semi").toLocalIterator()]
            if long:
                self.compact(now, buckets=long)
        return done

    def batch_json(self, text: str, now: int | None = None) -> int:
        """A JSON array of {op, key, value, expires_at_sec}; one bad operation fails all, before anything is written."""
        ops = writes.parsed_ops(self.spark.createDataFrame([(0, text)], "batch long, json string"))
        return self.batch(ops.select(F.col("i").cast("long").alias("ord"), "op", F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), "expires_at_sec"), now)

    # ---- reads

    def values(self, rows: DataFrame) -> DataFrame:
        """Rows with the values of large records put together; one that is cut short, too large or of too many chunks is an error."""
        large = rows.where(F.col("chain_id").isNotNull())
        named = large.select("chain_id", "total_len").distinct()
        parts = self.chunks().join(named.select("chain_id"), "chain_id", "left_semi")
        whole = overflow.expanded(named, parts, self.config.max_value_bytes, self.config.max_chunks, self.config.zstd)
        # records without chunks are not joined, so they are not dealt by an empty key
        return rows.where(F.col("chain_id").isNull()).unionByName(large.drop("value").join(whole, "chain_id").select(rows.columns))

    def get(self, key: bytes, now: int) -> bytes | None:
        row = reads.get(self.log(), F.lit(bytearray(key)), now).select("value", "chain_id", "total_len").first()
        if row is not None and row.chain_id is not None:
            row = self.values(self.spark.createDataFrame([row], "value binary, chain_id long, total_len long")).first()
        return bytes(row.value) if row else None

    def exists(self, key: bytes, now: int) -> bool:
        return reads.exists(self.log(), F.lit(bytearray(key)), now).first().found

    def get_many(self, probes: DataFrame, now: int) -> DataFrame:
        asked = self.log().join(probes.select("key"), "key", "left_semi")
        found = self.values(fold.visible(asked, now)).select("key", "value")
        return probes.join(found, "key", "left").select("idx", "key", "value")

    def exists_many(self, probes: DataFrame, now: int) -> DataFrame:
        return reads.exists_many(self.log(), probes, now)

    def scan(self, now: int, prefix: bytes = b"") -> DataFrame:
        log = self.log()
        inside = log.where(reads.prefix_predicate(F.col("key"), prefix)) if prefix else log
        return self.values(fold.visible(inside, now)).select("key", "value", "expires_at_sec")

    def as_of(self, lsn: int, now: int) -> DataFrame:
        """Only as far back as the current generation goes."""
        return self.values(fold.visible(self.log().where(F.col("lsn") <= lsn), now)).select("key", "value", "expires_at_sec")

    def _pages(self, page_records: int = 64) -> DataFrame:
        """The log with pages of page_records records in write order."""
        return self.log().withColumn("page_id", F.floor(F.col("seq") / page_records))

    def status(self, now: int) -> DataFrame:
        """One row: geometry, what is stored, what is visible, and whether the filters of the buckets may be used."""
        log, (seq, lsn) = self.log(), self.last()
        seen = fold.newest(log.drop("value"), now).agg(F.count_if(~F.col("tombstone")).alias("visible_keys"), F.count_if("tombstone").alias("deleted_keys")).withColumn("one__", F.lit(1))
        inline = F.coalesce(F.sum(F.octet_length("value")), F.lit(0))
        whole = log.agg(F.count("*").alias("versions"), F.count_distinct("bucket").alias("used_buckets"), inline.alias("inline_bytes"), F.count("chain_id").alias("large_values")).withColumn("one__", F.lit(1))
        chains = stats.chain_stats(self._pages()).select("min_len", "avg_len", "max_len").withColumn("one__", F.lit(1))
        large = stats.overflow_stats(self.chunks()).select(F.col("pages").alias("chunks"), F.col("bytes").alias("chunk_bytes")).withColumn("one__", F.lit(1))
        rows = whole.join(seen, "one__").join(chains, "one__").join(large, "one__").drop("one__")
        told = {"generation": self.generation(), "last_lsn": lsn, "last_seq": seq, "commits": len(self.commits()), "snapshots": len(self._names(f"{self.path}/snapshots")), "buckets": self.config.buckets, "page_size": self.config.page_size, "overflow_above": self.config.threshold, "bloom": self.bloom_state(), "key_epochs": len(self._names(f"{self.path}/_epochs"))}
        return rows.select("*", *(F.lit(v).alias(k) for k, v in told.items()))

    def status_json(self, now: int) -> str:
        return stats.status_json(self.status(now)).first().status

    # ---- filters of the buckets

    def bloom_state(self) -> str:
        at = json.loads(self._text("bloom/_made")) if self._has("bloom/_made") else {}
        return bloom.freshness(len(at), self.config.buckets, self.last()[1], at.get("buckets"), at.get("lsn"))

    def rebuild_bloom(self, now: int, bytes_each: int = bloom.BYTES, hashes: int = bloom.HASHES) -> None:
        lsn = self.last()[1]
        keys = fold.visible(self.log().drop("value"), now).select("bucket", "key")
        folder = f"made-{uuid.uuid4().hex}"
        bloom.built(keys, bytes_each, hashes).write.parquet(f"{self.path}/bloom/{folder}")
        self._remove("bloom/_made")
        self._put("bloom/_made", json.dumps({"buckets": self.config.buckets, "lsn": lsn, "bytes": bytes_each, "hashes": hashes, "folder": folder}))

    def maybe(self, probes: DataFrame) -> DataFrame:
        """probes (key, ...) with maybe; without a fresh filter everything may be there."""
        if self.bloom_state() != "fresh":
            return probes.withColumn("maybe", F.lit(True))
        at = json.loads(self._text("bloom/_made"))
        filters = self.spark.read.schema("bucket int, bits binary").parquet(f"{self.path}/bloom/{at['folder']}")
        dealt = probes.withColumn("bucket", bucket_of(F.col("key").cast("binary"), self.config.buckets))
        return bloom.tested(filters, dealt, at["bytes"], at["hashes"]).drop("bucket")

    # ---- maintenance

    def compact(self, now: int, files: int | None = None, forget: int = 0, buckets: list[int] | None = None) -> int:
        """The new generation's number. Survivors keep seq, LSN and expiry; tombstones go only up to the LSN `forget`.

        With `buckets`, the others' rows are taken over as they are. Rows are dealt by ranges of bucket and key, so a bucket
        of any size is spread over as many files as it fills.
        """
        old, (seq, lsn) = self.generation(), self.last()
        log = self.log(old)
        mine = F.lit(True) if buckets is None else F.col("bucket").isin(buckets)
        rows = fold.newest(log.where(mine), now).where(~F.col("tombstone") | (F.col("lsn") > forget))
        rows = rows if buckets is None else rows.unionByName(log.where(~mine))
        n = files or self.spark.sparkContext.defaultParallelism
        rows.repartitionByRange(n, "bucket", "key").sortWithinPartitions("bucket", "key", "seq").write.mode("overwrite").parquet(f"{self._generation(old + 1)}/commit={lsn:020d}")
        self._point(old + 1, seq, lsn)
        return old + 1

    def report(self, now: int, page_records: int = 64) -> DataFrame:
        """What compaction finds in each bucket; a page stands for page_records records in write order."""
        return compaction.bucket_reports(self._pages(page_records), now, page_records)

    def auto_maintenance(self, now: int, max_buckets: int = 32, sweep: bool = False, page_records: int = 64) -> dict:
        """Compacts the first buckets that hold anything; how many were looked at and written, pages written, chunks freed."""
        first = [r.bucket for r in self.log().select("bucket").distinct().orderBy("bucket").limit(max_buckets).collect()]
        told = self.report(now, page_records).where(F.col("bucket").isin(first)) if first else None
        written, pages = told.agg(F.count_if(F.col("pages_written") > 0), F.coalesce(F.sum("pages_written"), F.lit(0))).first() if first else (0, 0)
        if first:
            self.compact(now, buckets=first)
        return {"buckets_scanned": len(first), "buckets_compacted": written, "pages_written_sum": pages, "overflow_pages_freed": self.sweep() if sweep else 0}

    def sweep(self) -> int:
        """Chunks freed: those that no record of any generation names. A folder of chunks without orphans is left alone."""
        folder, freed = f"{self.path}/chunks", 0
        logs = [self.log(int(x.split("=")[1])) for x in self._names(f"{self.path}/log")]
        named = self.spark.createDataFrame([], "chain_id long")
        for log in logs:
            named = named.unionByName(log.where(F.col("chain_id").isNotNull()).select("chain_id"))
        for name in self._names(folder):
            parts = self.spark.read.schema(CHUNKS).parquet(f"{folder}/{name}")
            lost = parts.join(named, "chain_id", "left_anti").count()
            if lost:
                kept = parts.join(named, "chain_id", "left_semi")
                if lost < parts.count():
                    kept.write.parquet(f"{folder}/{name}.{uuid.uuid4().hex[:8]}")
                self._fs.delete(self._path(f"{folder}/{name}"), True)
                freed += lost
        return freed

    def vacuum(self) -> list[int]:
        """Generations dropped: all but the current and those that snapshots pin."""
        keep = {self.generation(), *(r.generation for r in self.snapshots().select("generation").distinct().toLocalIterator())}
        gone = []
        for name in self._names(f"{self.path}/log"):
            n = int(name.split("=")[1])
            if n not in keep:
                self._fs.delete(self._path(f"{self.path}/log/{name}"), True)
                gone.append(n)
        return sorted(gone)

    def vacuum_all(self, now: int) -> dict:
        """Compacts everything, drops what nothing pins and sweeps; the sums of the report and what was freed."""
        told = compaction.summary(self.report(now)).first().asDict()
        self.compact(now)
        return told | {"generations_dropped": self.vacuum(), "overflow_pages_freed": self.sweep()}

    def checkpoint(self) -> int:
        """Takes away what crashes have left: temporary files, and folders of commits that never landed. How many there were."""
        folder, gone = self._generation(self.generation()), 0
        left = [f"{self.path}/{x}" for x in self._names(self.path) if x.startswith("_new.")]
        for at in (folder, f"{self.path}/chunks"):
            left += [f"{at}/{x}" for x in self._names(at) if x.startswith("commit=") and not self._fs.exists(self._path(f"{at}/{x}/_SUCCESS"))]
        for name in left:
            gone += bool(self._fs.delete(self._path(name), True))
        return gone

    # ---- key epochs

    def epochs(self) -> DataFrame:
        """(since_lsn, kid): from which LSN on each key id holds."""
        rows = [json.loads(self._text(f"_epochs/{x}")) for x in self._names(f"{self.path}/_epochs")]
        return self.spark.createDataFrame([(r["since_lsn"], r["kid"]) for r in rows], "since_lsn long, kid string")

    def rotate(self, kid: str) -> int:
        """A new key id holds from the next LSN on; LSNs of epochs must grow, so two without a commit between are an error."""
        since = self.last()[1] + 1
        if any(int(x) >= since for x in self._names(f"{self.path}/_epochs")):
            raise ValueError(f"there is an epoch from LSN {since} on already")
        self._put(f"_epochs/{since:020d}", json.dumps({"since_lsn": since, "kid": kid}))
        return since

    def _remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    # ---- snapshots

    def snapshot(self, message: str = "", labels: list[str] | None = None, parent: str | None = None, created_unix_ms: int = 0) -> str:
        """Pins what the store holds now; the id. The manifest has the geometry and how many records each bucket has."""
        seq, lsn = self.last()
        heads = [(r.bucket, r["count"]) for r in self.log().groupBy("bucket").count().orderBy("bucket").collect()]  # a row for each of the store's buckets at most
        one = (uuid.uuid4().hex, parent, message, labels or [], created_unix_ms, self.generation(), lsn, seq, self.config.buckets, self.config.page_size, heads)
        self.spark.createDataFrame([one], MANIFEST).coalesce(1).write.json(f"{self.path}/snapshots/id={one[0]}")
        return one[0]

    def snapshots(self) -> DataFrame:
        """Manifests by id."""
        if not self._names(f"{self.path}/snapshots"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{self.path}/snapshots").orderBy("id")

    def inspect(self, snapshot_id: str) -> dict:
        row = self.snapshots().where(F.col("id") == snapshot_id).first()
        if row is None:
            raise KeyError(snapshot_id)
        return row.asDict(True)

    def snapshot_log(self, snapshot_id: str) -> DataFrame:
        m = self.inspect(snapshot_id)
        return self.log(m["generation"]).where(F.col("lsn") <= m["lsn"])

    def restore(self, snapshot_id: str, path: str, verify: bool = False) -> Store:
        """A store that holds what the snapshot pins: a new one, or an empty one of the same geometry.

        With `verify`, every bucket must come back with as many records as the manifest says, and every large value whole.
        """
        m = self.inspect(snapshot_id)
        new = Store(self.spark, path)
        if new._has("_at"):
            snapshots.same_geometry(m, new.config.page_size, new.config.buckets)
            if new.last() != (0, 0):
                raise FileExistsError(f"{path} is not empty")
        else:
            new = Store.create(self.spark, path, config=self.config)
        rows = self.values(self.snapshot_log(snapshot_id))
        if m["lsn"]:
            new._append(rows, F.col("lsn"), m["lsn"])
        if verify:
            found = [{"bucket": r.bucket, "records": r["count"]} for r in new.log().groupBy("bucket").count().orderBy("bucket").collect()]
            if found != m["heads"]:
                raise ValueError(f"restored {found}, the manifest has {m['heads']}")
            lost = overflow.bad_lengths(new.log().where(F.col("chain_id").isNotNull()).select("chain_id", "total_len"), overflow.inflated(new.chunks()))
            if lost.limit(1).count():
                raise ValueError("a large value came back with another length")
        return new

    def drop_snapshot(self, snapshot_id: str) -> None:
        self.inspect(snapshot_id)
        self._remove(f"snapshots/id={snapshot_id}")

    # ---- change shipping

    def ship(self, since_lsn: int, inclusive: bool = False) -> DataFrame:
        """Rows beyond an LSN, large values whole; commits that end before it are not read."""
        after = since_lsn - 1 if inclusive else since_lsn
        return self.values(self.log(after=after).where(F.col("lsn") > after)).select("key", "value", "expires_at_sec", "tombstone", "seq", "lsn")

    def apply(self, changes: DataFrame) -> int:
        """Appends shipped rows above the own last LSN as one commit; shipping again changes nothing. The new last LSN."""
        _, lsn = self.last()
        new = changes.where(F.col("lsn") > lsn)
        top = new.agg(F.max("lsn")).first()[0]
        return lsn if top is None else self._append(new, F.col("lsn"), top)

    def __repr__(self) -> str:
        return f"Store({json.dumps(self.path)})"
