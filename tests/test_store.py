import random

import pytest
from pyspark.sql import functions as F

from emberlog.config import Config
from emberlog.store import Store

NOW = 1000


def content(rows):
    return {bytes(r.key): bytes(r.value) for r in rows.collect()}


def test_store_life(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/a", 8)
    with pytest.raises(FileExistsError):
        Store.create(spark, f"file://{tmp_path}/a")
    assert s.last() == (0, 0) and s.get(b"nobody", NOW) is None
    s.put(b"lamp", b"on")
    s.put(b"door", b"open", expires_at_sec=2000)
    s.put(b"door", b"ajar", expires_at_sec=1000)
    assert s.get(b"door", 999) == b"ajar" and s.get(b"door", NOW) == b"open" and s.get(b"door", 2000) is None
    assert s.delete(b"lamp", NOW) and not s.delete(b"lamp", NOW) and not s.exists(b"lamp", NOW)
    lsn = s.batch_json('[{"op":"put","key":"win1","value":"x"},{"op":"PUT","key":"win2","value":""},{"op":"del","key":"win1"}]')
    with pytest.raises(Exception, match="bad operation"):
        s.batch_json('[{"op":"put","key":"win9","value":"v"},{"op":"move","key":"win2"}]')
    assert s.last()[1] == lsn == 6 and s.commits() == [1, 2, 3, 4, 5, 6]
    assert content(s.scan(NOW, b"win")) == {b"win2": b""} and s.as_of(1, NOW).count() == 1
    probes = spark.createDataFrame([(0, bytearray(b"win2")), (1, bytearray(b"win1"))], "idx long, key binary")
    assert {(r.idx, None if r.value is None else bytes(r.value)) for r in s.get_many(probes, NOW).collect()} == {(0, b""), (1, None)}
    row = s.status(NOW).first()
    assert (row.visible_keys, row.versions, row.last_lsn, row.bloom, row.buckets) == (2, 8, 6, "absent", 8) and '"versions":8' in s.status_json(NOW)


def test_a_replica_hears_of_deletes_after_a_compaction(spark, tmp_path):
    """The LSN never goes back and tombstones stay, so nothing is skipped."""
    s, other = (Store.create(spark, f"file://{tmp_path}/{x}", n) for x, n in (("a", 8), ("b", 4)))
    s.put(b"a", b"1")
    s.put(b"b", b"2")
    other.apply(s.ship(other.last()[1]))
    s.delete(b"b", NOW)
    assert s.compact(NOW) == 2 and s.last() == (3, 3)
    other.apply(s.ship(other.last()[1]))
    assert other.get(b"b", NOW) is None
    assert s.put(b"c", b"3") == 4
    other.apply(s.ship(other.last()[1]))
    assert content(other.scan(NOW)) == content(s.scan(NOW)) == {b"a": b"1", b"c": b"3"}
    s.compact(NOW, forget=other.last()[1])
    assert s.log().where("tombstone").count() == 0 and s.last() == (4, 4)


def test_churn_of_a_store_and_its_replica(spark, tmp_path):
    rng, model = random.Random(31), {}
    s = Store.create(spark, f"file://{tmp_path}/s", config=Config(buckets=4, page_size=4096, overflow_above=40))
    other = Store.create(spark, f"file://{tmp_path}/o", config=Config(buckets=2))
    for step in range(14):
        kind = rng.choice(["batch", "batch", "delete", "compact", "ship", "ship"])
        if kind == "batch":
            ops = [(i, rng.choice(["put", "put", "del"]), f"k{rng.randrange(12)}".encode(), bytes([rng.randrange(256)]) * rng.randrange(90)) for i in range(rng.randrange(1, 9))]
            s.batch(spark.createDataFrame([(i, o, bytearray(k), bytearray(v), 0) for i, o, k, v in ops], "ord long, op string, key binary, value binary, expires_at_sec long"))
            for _, o, k, v in ops:
                model.pop(k, None)
                model |= {k: v} if o == "put" else {}
        elif kind == "delete":
            s.delete(k := f"k{rng.randrange(12)}".encode(), NOW)
            model.pop(k, None)
        elif kind == "compact":
            (s if step % 2 else other).compact(NOW, buckets=None if rng.random() < 0.5 else [0, 1])
        else:
            other.apply(s.ship(other.last()[1]))
            other.apply(s.ship(0))
            assert content(other.scan(NOW)) == model
        assert content(s.scan(NOW)) == model
    other.apply(s.ship(other.last()[1]))
    assert content(other.scan(NOW)) == model and other.last()[1] == s.last()[1]
    s.compact(NOW, forget=s.last()[1])
    s.vacuum()
    freed = s.sweep()
    assert content(s.scan(NOW)) == model and freed >= 0 and s.sweep() == 0


def test_large_values(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/a", config=Config(buckets=4, page_size=4096, overflow_above=1000, zstd=True, max_value_bytes=50_000))
    big = bytes(range(256)) * 100
    s.put(b"book", big)
    s.put(b"note", b"n" * 1000)
    assert s.log().where("chain_id is not null").count() == 1 and s.chunks().count() == 7
    assert s.get(b"book", NOW) == big and content(s.scan(NOW)) == {b"book": big, b"note": b"n" * 1000}
    snap = s.snapshot()
    back = s.restore(snap, f"file://{tmp_path}/b", verify=True)
    assert back.get(b"book", NOW) == big
    s.put(b"huge", b"h" * 60_000)
    with pytest.raises(Exception, match="above the limit"):
        s.get(b"huge", NOW)
    s.delete(b"book", NOW)
    s.delete(b"huge", NOW)
    assert s.sweep() == 0  # old versions still name them
    s.compact(NOW)
    s.drop_snapshot(snap)
    assert s.vacuum() == [1] and s.sweep() == 7 + 15 and s.sweep() == 0
    s.put(b"book", big)
    path = next((tmp_path / "a" / "chunks").glob("commit=*"))
    spark.read.parquet(f"file://{path}").where("chunk_no < 3").write.parquet(f"file://{tmp_path}/cut")
    s.chunks = lambda: spark.read.parquet(f"file://{tmp_path}/cut")
    with pytest.raises(Exception, match="another length"):
        s.get(b"book", NOW)


def test_what_a_crash_leaves(spark, tmp_path):
    """A commit that never landed, a pointer that was not renamed, chunks without their record."""
    s = Store.create(spark, f"file://{tmp_path}/a", config=Config(buckets=4, overflow_above=10))
    s.put(b"k", b"v")
    lost = tmp_path / "a" / "log" / "gen=00000001" / "commit=00000000000000000002"
    lost.mkdir()
    (lost / "part-0.parquet").write_bytes(b"half")
    (tmp_path / "a" / "_new.1234").write_text("{}")
    spark.createDataFrame([(9, 0, 0, 3, bytearray(b"abc"))], "chain_id long, chunk_no int, codec_id int, chunk_len int, payload binary").write.parquet(f"file://{tmp_path}/a/chunks/commit=00000000000000000002")
    again = Store(spark, f"file://{tmp_path}/a")
    assert again.config.overflow_above == 10 and again.last() == (1, 1) and content(again.scan(NOW)) == {b"k": b"v"}
    assert again.checkpoint() == 2 and again.checkpoint() == 0 and again.last() == (1, 1)
    assert again.sweep() == 1 and again.put(b"k", b"w" * 20) == 2 and again.get(b"k", NOW) == b"w" * 20


def test_snapshots(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/a", 8)
    s.batch_json('[{"op":"put","key":"p","value":"1"},{"op":"put","key":"q","value":"2"},{"op":"put","key":"r","value":"3","expires_at_sec":2000}]')
    snap = s.snapshot("first", ["x"])
    assert len(bytes.fromhex(snap)) == 16 and s.snapshot("again") != snap
    s.drop_snapshot(next(r.id for r in s.snapshots().collect() if r.message == "again"))
    s.put(b"p", b"9")
    s.delete(b"q", NOW)
    assert {(r.keys_kept, r.keys_deleted) for r in s.report(NOW).groupBy().sum().toDF("b", "o", "keys_kept", "keys_deleted", "p").collect()} == {(2, 1)}
    before = content(s.scan(NOW))
    assert s.compact(NOW) == 2 and content(s.scan(NOW)) == before and s.log().count() == 3
    assert s.scan(2000).count() == 1  # the expiry survived compaction
    m = s.inspect(snap)
    assert [r.id for r in s.snapshots().collect()] == [snap] and m["labels"] == ["x"] and sum(h["records"] for h in m["heads"]) == 3
    assert s.vacuum() == []
    back = s.restore(snap, f"file://{tmp_path}/c", verify=True)
    assert content(back.scan(NOW)) == {b"p": b"1", b"q": b"2", b"r": b"3"} and back.last() == (3, 1)
    with pytest.raises(FileExistsError):
        s.restore(snap, f"file://{tmp_path}/c")
    Store.create(spark, f"file://{tmp_path}/d", 16)
    with pytest.raises(ValueError, match="buckets"):
        s.restore(snap, f"file://{tmp_path}/d")
    Store.create(spark, f"file://{tmp_path}/e", 8)
    assert content(s.restore(snap, f"file://{tmp_path}/e", verify=True).scan(NOW)) == content(back.scan(NOW))
    s.drop_snapshot(snap)
    assert s.vacuum() == [1] and content(s.scan(NOW)) == before
    with pytest.raises(KeyError):
        s.inspect(snap)


def test_filters_and_maintenance(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/a", config=Config(buckets=4, compact_at=2))
    s.batch_json("[" + ",".join(f'{{"op":"put","key":"k{i}","value":"v"}}' for i in range(50)) + "]")
    s.rebuild_bloom(NOW, 512, 4)
    probes = spark.createDataFrame([(bytearray(f"k{i}".encode()),) for i in range(200)], "key binary")
    got = {bytes(r.key): r.maybe for r in s.maybe(probes).collect()}
    assert s.bloom_state() == "fresh" and all(got[f"k{i}".encode()] for i in range(50)) and sum(got.values()) < 80
    s.put(b"k77", b"v")
    assert s.bloom_state() == "stale_last_lsn" and s.maybe(probes).where("maybe").count() == 200
    told = s.auto_maintenance(NOW, 2, True)
    assert told["buckets_scanned"] == told["buckets_compacted"] == 2 and s.scan(NOW).count() == 51
    s.batch_json("[" + ",".join(f'{{"op":"put","key":"k0","value":"{i}"}}' for i in range(200)) + "]", NOW)
    assert s.generation() == 3 and s.log().where(F.col("key") == F.lit(bytearray(b"k0"))).count() == 1
    assert s.vacuum_all(NOW)["keys_kept"] == 51


def test_key_epochs(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/a", 4)
    assert s.rotate("first") == 1
    s.put(b"a", b"1")
    assert s.rotate("second") == 2 and [tuple(r) for r in s.epochs().orderBy("since_lsn").collect()] == [(1, "first"), (2, "second")]
    with pytest.raises(ValueError):
        s.rotate("third")
    assert s.status(NOW).first().key_epochs == 2


def test_config():
    assert Config.of({"buckets": "7", "zstd": " Yes", "overflow_above": ""}) == Config(buckets=7, zstd=True)
    assert Config(page_size=4096).threshold == 512 and Config.from_json(Config(buckets=3).to_json()) == Config(buckets=3)
    for bad in ({"page_size": "5000"}, {"page_size": "2048"}, {"buckets": "0"}, {"zstd": "maybe"}, {"nothing": "1"}):
        with pytest.raises(ValueError):
            Config.of(bad)


def test_command_line(spark, tmp_path):
    from emberlog.__main__ import parser, run
    from emberlog.sources import pages

    def call(*words):
        said = []
        code = run(spark, parser().parse_args([f"file://{tmp_path}/s", "--now", "1000", *words]), said.append)
        return code, said

    assert call("init", "--buckets", "4", "--option", "overflow_above=100") == (0, []) and call("init") == (0, ["exists already"])
    assert call("put", "--key", "a", "--value", "hex:00ff")[0] == 0
    assert call("batch", "--ops", '[{"op":"put","key":"b","value":"2"}]') == (0, ['{"lsn": 2}'])
    assert call("get", "--key", "b") == (0, ["2"]) and call("get", "--key", "z") == (1, ["NOT FOUND"])
    assert call("get", "--key", "a", "--out", str(tmp_path / "out")) == (0, []) and (tmp_path / "out").read_bytes() == b"\x00\xff"
    assert call("scan", "--prefix", "a")[1] == ['{"key_hex":"61","value_hex":"00ff","key_len":1,"value_len":2}']
    assert call("scan", "--text")[1] in (["a = (binary 2 B)", "b = 2"], ["b = 2", "a = (binary 2 B)"])
    code, (snap,) = call("snapshot-create", "--message", "m")
    assert call("del", "--key", "b") == (0, ["DELETED"]) and call("exists", "--key", "b") == (1, ["NOT FOUND"])
    assert call("snapshot-restore", "--id", snap, "--to", f"file://{tmp_path}/r", "--verify")[0] == 0
    assert call("put", "--key", "c", "--value", "c" * 200)[0] == 0 and '"large_values":1' in call("status")[1][0]
    assert call("bloom") == (0, ["fresh"])
    assert '"generation": 2' in call("compact")[1][0] and len(call("report")[1]) == 3
    assert '"buckets_scanned": 3' in call("auto-maint", "--sweep")[1][0] and call("sweep")[1] == ['{"overflow_pages_freed": 0}']
    assert call("cdc-ship", "--to", f"file://{tmp_path}/c") == (0, ['{"rows": 3, "bytes": 202, "last_lsn": 4}'])
    assert call("checkpoint") == (0, ['{"removed": 0, "last_lsn": 4}']) and call("tde-rotate", "--kid", "k1") == (0, ['{"kid": "k1", "since_lsn": 5}'])
    other = Store.create(spark, f"file://{tmp_path}/t", 2)
    run(spark, parser().parse_args([f"file://{tmp_path}/t", "cdc-apply", "--from", f"file://{tmp_path}/c"]), print)
    assert content(other.scan(NOW)) == {b"a": b"\x00\xff", b"c": b"c" * 200}
    assert call("snapshot-delete", "--id", snap)[0] == 0 and call("vacuum")[1] == ['{"dropped": [1, 2]}']
    assert '"keys_kept": 2' in call("vacuum", "--all")[1][0]
    (tmp_path / "p.p2seg").write_bytes(pages.kv_page(0, [(b"k", b"v", 0, False)], 4096))
    assert '"kv_pages": 1' in call("doctor", "--pages", str(tmp_path / "p.p2seg"), "--page-size", "4096")[1][0]
