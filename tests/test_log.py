"""The fold and what is built on it, on toy rows and against a sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.functions import scalars as S
from emberlog.functions.ordered import max_before, nearest_rank, numbered
from emberlog.operators import cdc, compaction, fold, integrity, overflow, reads, snapshots, writes

LOG = "key string, value string, expires_at_sec long, tombstone boolean, seq long"
ROWS = [
    ("a", "1", 0, False, 1), ("a", "2", 0, False, 2),
    ("b", "1", 0, False, 3), ("b", None, 0, True, 4),
    ("c", "1", 0, False, 5), ("c", None, 0, True, 6), ("c", "3", 0, False, 7),
    ("d", "old", 0, False, 8), ("d", "new", 990, False, 9),
    ("e", "x", 1000, False, 10), ("f", "x", 1001, False, 11),
    ("g", "1", 0, False, 12), ("g", None, 500, True, 13),
    ("h", "1", 0, False, 14), ("h", None, 0, True, 15), ("h", "2", 1, False, 16),
    ("i", "1", 5, False, 17), ("i", "2", 6, False, 18),
    ("j", "", 0, False, 19),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, LOG)


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_visible_and_states(log):
    assert pairs(fold.visible(log, 1000), "key", "value") == {("a", "2"), ("c", "3"), ("d", "old"), ("f", "x"), ("j", "")}
    state = dict(pairs(fold.states(log, 1000), "key", "state"))
    assert {k for k, v in state.items() if v == "deleted"} == {"b", "g", "h"}
    assert {k for k, v in state.items() if v == "undecided"} == {"e", "i"}


def test_reads(spark, log):
    assert [r.value for r in reads.get(log, F.lit("d"), 1000).collect()] == ["old"]
    assert reads.exists(log, F.lit("b"), 1000).first().found is False
    probes = spark.createDataFrame([(0, "a"), (1, "zz"), (2, "a"), (3, "j")], "idx long, key string")
    assert pairs(reads.get_many(log, probes, 1000), "idx", "value") == {(0, "2"), (1, None), (2, "2"), (3, "")}
    assert pairs(reads.exists_many(log, probes, 1000), "idx", "found") == {(0, True), (1, False), (2, True), (3, True)}
    assert pairs(reads.missing_many(log, probes, 1000), "idx") == {(1,)}
    plan = reads.get(log, F.lit("a"), 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("= a")  # the key's predicate lies below the window


def test_binary_prefix(spark):
    log = spark.createDataFrame([(bytearray(k), "v", 0, False, i) for i, k in enumerate([b"a", b"a\xff", b"b", b"\xff"])], "key binary, value string, expires_at_sec long, tombstone boolean, seq long")
    assert reads.scan_prefix(log, b"a", 0).count() == 2
    assert reads.scan_prefix(log, b"\xff", 0).count() == 1
    assert S.prefix_end(b"a\xff") == b"b" and S.prefix_end(b"\xff\xff") is None


def test_churn_model(spark):
    rng, rows = random.Random(1), []
    for seq in range(4000):
        kind = rng.random()
        rows.append((f"k{rng.randrange(300)}", None if kind < 0.2 else str(seq), rng.choice([0, 0, 400, 600]) if kind >= 0.2 else 0, kind < 0.2, seq))
    model = {}
    for k, v, exp, tomb, _ in rows:
        model.setdefault(k, []).insert(0, (v, exp, tomb))
    want = {}
    for k, versions in model.items():
        for v, exp, tomb in versions:
            if tomb:
                break
            if exp == 0 or exp > 500:
                want[k] = v
                break
    log = spark.createDataFrame(rows, LOG)
    assert dict(pairs(fold.visible(log, 500), "key", "value")) == want
    kept = compaction.survivors(log.withColumn("bucket", S.bucket_of(F.col("key"), 8)), 500)
    assert dict(pairs(kept, "key", "value")) == want


def test_writes(spark, log):
    ops = spark.createDataFrame([(1, "put", "a", "9", 0), (2, "del", "c", None, 0), (3, "put", "b", "7", 0), (4, "del", "a", None, 0)], "ord long, op string, key string, value string, expires_at_sec long")
    rows = writes.op_rows(ops, 100, [F.col("ord")], F.floor(F.col("ord") / 2))
    assert sorted(r.seq for r in rows.collect()) == [101, 102, 103, 104]
    assert pairs(reads.scan_all(writes.appended(log, rows), 1000), "key", "value") == {("b", "7"), ("d", "old"), ("f", "x"), ("j", "")}
    bad = spark.createDataFrame([(1, '[{"op":"PUT","key":"k"}]')], "batch long, json string")
    with pytest.raises(Exception, match="bad operation"):
        writes.parsed_ops(bad).collect()


def test_overflow(spark):
    rows = spark.createDataFrame([(1, bytearray(b"\xab" * 9000)), (2, bytearray(b"")), (3, bytearray(b"\x01\x10" + b"x" * 16))], "chain_id long, value binary")
    for codec in (0, 1):
        parts = overflow.chunks(rows, 4096, codec)
        assert parts.where("chain_id = 1").count() == 3
        back = {r.chain_id: bytes(r.value) for r in overflow.reassembled(parts, codec == 1).collect()}
        assert back == {r.chain_id: bytes(r.value) for r in rows.collect()}
    stated = rows.select("chain_id", F.octet_length("value").cast("long").alias("total_len"))
    assert pairs(overflow.bad_lengths(stated, overflow.chunks(rows, 4096).where("chunk_no = 0")), "chain_id") == {(1,)}
    with pytest.raises(Exception, match="above the limit"):
        overflow.guarded(rows, 1024).collect()


def test_packing(spark):
    rows = spark.createDataFrame([(0, i, 1000) for i in range(10)] + [(1, 1, 10)], "bucket int, seq long, size long")
    got = sorted((r.bucket, r.page_no, r.records) for r in compaction.packed(rows, 4096, F.col("size")).collect())
    assert got == [(0, 0, 3), (0, 1, 3), (0, 2, 3), (0, 3, 1), (1, 0, 1)]


def test_sweep_is_idempotent(spark):
    pages = spark.createDataFrame([(1, 10), (2, 20)], "page_id long, chain_id long")
    log = spark.createDataFrame([(10, False), (20, True)], "chain_id long, tombstone boolean")
    free = compaction.orphans(pages, log)
    assert pairs(free, "page_id") == {(2,)}
    assert compaction.orphans(pages.join(free, "page_id", "left_anti"), log).count() == 0


def test_gates(spark):
    frames = spark.createDataFrame([("s", i, n) for i, n in enumerate([6, 4, 7, 7, 9])], "stream_id string, ord long, seq long")
    for width in (1, 2, 100):
        got = cdc.seq_gate(frames, 5, F.floor(F.col("ord") / width), ["stream_id"])
        assert sorted(r.seq for r in got.collect()) == [6, 7, 9]
    images = spark.createDataFrame([(1, 3, 0, "x"), (1, 2, 1, "y"), (1, 3, 2, "z"), (2, 5, 3, "w")], "page_id long, lsn long, ord long, payload string")
    assert pairs(cdc.applied_pages(images), "page_id", "payload") == {(1, "x"), (2, "w")}
    twelve = (3).to_bytes(4, "little") + (2**64 - 1).to_bytes(8, "little")
    heads = spark.createDataFrame([(1, 0, bytearray(b"")), (2, 1, bytearray(b"x" * 11)), (3, 2, bytearray(twelve)), (4, 3, bytearray(twelve + twelve))], "lsn long, ord long, payload binary")
    assert pairs(cdc.bad_heads(heads), "lsn") == {(1,), (2,)}
    assert pairs(cdc.applied_heads(heads, 0, F.lit(0)), "bucket", "head_pid") == {(3, None)}


def test_ordered_columns(spark):
    rng = random.Random(3)
    values = [rng.random() * 50 for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = [r.i for r in numbered(df, [F.col("v")], F.floor("v")).orderBy("n").collect()]
    assert got == sorted(range(500), key=lambda i: values[i])
    q = {r.q: r.v for r in nearest_rank(df, "v", [0.5, 0.99]).collect()}
    assert q == {p: sorted(values)[int(499 * p + 0.5)] for p in (0.5, 0.99)}
    top = {r.i: r.t for r in max_before(df.withColumn("g", F.lit(1)), F.col("v"), F.col("i"), F.floor(F.col("i") / 7), ["g"], "t").collect()}
    assert top[0] is None and all(top[i] == max(values[:i]) for i in range(1, 500))


def test_snapshots(spark):
    puts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "ord long, content string")
    assert pairs(snapshots.put_trace(puts), "ord", "existed_before", "refcount") == {(1, False, 1), (2, True, 2), (3, False, 1)}
    objects = spark.createDataFrame([("s1", 1, "h1"), ("s1", 2, "h2"), ("s2", 1, "h1")], "snapshot_id string, page_id long, hash_hex string")
    assert pairs(snapshots.collectable(objects, "s1"), "hash_hex") == {("h2",)}
    store = spark.createDataFrame([("h1", "c1")], "hash_hex string, content string")
    assert pairs(snapshots.restored(objects, store, "s2"), "content") == {("c1",)}
    with pytest.raises(Exception, match="another hash"):
        snapshots.restored(objects, store, "s2", verify=True).collect()
    with pytest.raises(Exception, match="another length"):
        snapshots.restored(objects, store, "s2", page_size=4096).collect()
    with pytest.raises(ValueError, match="page_size"):
        snapshots.same_geometry({"page_size": 4096, "buckets": 8}, 8192, 8)
    with pytest.raises(Exception, match="object missing"):
        snapshots.restored(objects, store, "s1").collect()


def test_scalars(spark):
    row = spark.createDataFrame([("hex:0aFF", b"123456789")], "arg string, data binary").select(S.decode_value(F.col("arg")).alias("v"), S.crc32c("data").alias("c"), S.xxh64_hex(F.lit(b"")).alias("h")).first()
    assert bytes(row.v) == b"\x0a\xff" and row.c == 0xE3069283 and row.h == "ef46db3751d8e999"
    with pytest.raises(Exception, match="hex digits"):
        spark.createDataFrame([("hex:abc",)], "arg string").select(S.decode_value(F.col("arg"))).collect()
    sizes = spark.createDataFrame([(4096,), (5000,), (2048,), (1 << 20,)], "n int").select(S.page_size_valid(F.col("n")).alias("ok"))
    assert [r.ok for r in sizes.collect()] == [True, False, False, True]


def test_epochs(spark):
    pages = spark.createDataFrame([(1, 5), (2, 10), (3, 99)], "page_id long, lsn long")
    epochs = spark.createDataFrame([(10, "k1"), (50, "k2")], "since_lsn long, kid string")
    assert pairs(integrity.epoch_of(pages, epochs), "page_id", "kid") == {(1, None), (2, "k1"), (3, "k2")}
