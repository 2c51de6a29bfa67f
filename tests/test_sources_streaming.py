import pytest
from pyspark.sql import functions as F

from emberlog.functions import scalars as S
from emberlog.operators import cdc, fold, integrity, overflow, stats
from emberlog.sources import pages, wal
from emberlog.streaming import apply


def test_wal_source(spark, tmp_path):
    wal.register(spark)
    body = wal.header(7) + wal.encode_frame(1, 1, 0, b"") + wal.encode_frame(5, 0, 0, b"") + wal.header(7) + wal.encode_frame(2, 2, 9, b"page")
    (tmp_path / "wal-000001.log").write_bytes(body + wal.encode_frame(2, 3, 9, b"cut")[:-2])
    rows = spark.read.format("kvwal").load(str(tmp_path)).orderBy("pos").collect()
    assert [(r.rec_type, r.lsn) for r in rows] == [(1, 1), (5, 0), (2, 2)]
    assert bytes(rows[-1].payload) == b"page" and rows[0].stream_id == "0000000000000007"
    with pytest.raises(ValueError):
        list(wal.decode(wal.header(7) + wal.encode_frame(1, 1, 0, b"") + wal.header(7) + wal.encode_frame(1, 2, 0, b"") * 9_000))
    broken = bytearray(wal.header(7) + wal.encode_frame(2, 1, 1, b"abc"))
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        list(wal.decode(bytes(broken)))


def test_wal_stream(spark, tmp_path):
    """Frames that are appended, files of earlier names, a frame cut short and then whole: each is delivered once."""
    wal.register(spark)
    folder, frame = tmp_path / "in", lambda lsn: wal.encode_frame(2, lsn, lsn, b"p" * lsn)
    folder.mkdir()
    (folder / "wal-5.log").write_bytes(wal.header(7) + frame(1) + frame(2)[:-1])
    q = spark.readStream.format("kvwal").load(str(folder)).select("lsn", "payload").writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).start()
    seen = lambda: (q.processAllAvailable(), sorted(r.lsn for r in spark.table("frames").collect()))[1]
    assert seen() == [1]
    (folder / "wal-5.log").write_bytes(wal.header(7) + frame(1) + frame(2) + frame(3))
    assert seen() == [1, 2, 3]
    (folder / "wal-1.log").write_bytes(wal.header(7) + frame(9))
    assert seen() == [1, 2, 3, 9]
    (folder / "wal-5.log").write_bytes(wal.header(7) + frame(4))  # begun anew
    assert seen() == [1, 2, 3, 4, 9]
    q.stop()


def test_a_log_file_streams_into_page_state(spark, tmp_path):
    """Frames of a growing file through the idempotent apply, with a restart between."""
    wal.register(spark)
    image = lambda lsn, page, text: wal.encode_frame(2, lsn, page, text)
    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(body):
        (tmp_path / "in" / "wal-1.log").write_bytes(wal.header(1) + body)
        frames = spark.readStream.format("kvwal").load(str(tmp_path / "in")).where("rec_type = 2")
        apply.apply_pages(frames.select("page_id", "lsn", F.col("pos").alias("ord"), F.decode("payload", "UTF-8").alias("payload")), out, check).awaitTermination()
        return {(r.page_id, r.payload) for r in apply.page_state(spark, out).collect()}

    first = image(3, 1, b"x") + image(2, 1, b"old") + wal.encode_frame(4, 3, 0, b"") + image(4, 2, b"y")
    assert run(first) == {(1, "x"), (2, "y")}
    assert run(first + image(3, 1, b"late") + image(5, 2, b"z")) == {(1, "x"), (2, "z")}


def test_wal_sink_and_authenticated_frames(spark, tmp_path):
    from emberlog.sources import frames

    wal.register(spark)
    frames.register(spark)
    rows = [(2, 3, 4, bytearray(b"one")), (6, 5, None, bytearray(b"two")), (5, 0, 0, None)]
    df = spark.createDataFrame(rows, "rec_type int, lsn long, page_id long, payload binary")
    df.repartition(2).write.format("kvwal").mode("append").option("stream_id", "7").save(str(tmp_path / "out"))
    back = spark.read.format("kvwal").load(str(tmp_path / "out")).collect()
    assert {(r.rec_type, r.lsn, r.page_id, bytes(r.payload)) for r in back} == {(2, 3, 4, b"one"), (6, 5, None, b"two"), (5, 0, 0, b"")}
    assert {r.stream_id for r in back} == {"0000000000000007"} and not list((tmp_path / "out").glob("*.part"))
    secret = b"s" * 16
    data = b"".join(frames.encode_framed(secret, n, b"x" * n) for n in range(4))
    (tmp_path / "f.log").write_bytes(data[:-1])
    read = lambda **o: spark.read.format("kvframes").options(**{"secret": "s" * 16} | o).load(str(tmp_path / "f.log"))
    assert sorted((r.seq, bytes(r.payload)) for r in read().collect()) == [(n, b"x" * n) for n in range(3)]
    for bad in ({"secret_hex": "00" * 16}, {"max_len": "1"}, {"secret": "short"}):
        with pytest.raises(Exception, match="MAC|above|16 bytes"):
            read(**bad).collect()


def test_corrupt_pages_give_no_records(spark, tmp_path):
    pages.register(spark)
    good, bad = pages.kv_page(0, [(b"a", b"1", 0, False)], 4096), bytearray(pages.kv_page(1, [(b"b", b"2", 0, False)], 4096))
    bad[bad.index(b"b2") + 1] ^= 1
    (tmp_path / "d.p2seg").write_bytes(good + bad + good[:100])
    read = lambda **o: spark.read.format("kvrecords").options(page_size=4096, **o).load(str(tmp_path / "d.p2seg"))
    with pytest.raises(Exception, match="checksum mismatch"):
        read().collect()
    assert [bytes(r.key) for r in read(corrupt="skip").collect()] == [b"a"]
    report = integrity.doctor(spark.read.format("kvpages").option("page_size", 4096).load(str(tmp_path / "d.p2seg"))).first()
    assert (report.pages_total, report.ok_pages, report.crc_fail, report.io_fail) == (3, 1, 1, 1)
    zero = bytearray(good)
    zero[-16:] = bytes(16)
    (tmp_path / "z.p2seg").write_bytes(zero)
    read = lambda **o: spark.read.format("kvrecords").options(page_size=4096, **o).load(str(tmp_path / "z.p2seg"))
    assert read().count() == 1 and read(strict="true", corrupt="skip").count() == 0


def slow_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums_and_tags_against_published_values(spark):
    assert S.crc32c_bytes(b"123456789") == 0xE3069283 and S.crc32c_bytes(bytes(32)) == 0x8A9136AA
    data = bytes(i * 7 & 255 for i in range(9000))
    for n in (0, 1, 3, 63, 64, 65, 4095, 4096, 4097, 4099, 4160, 8192, 8193, 8999):
        assert S.crc32c_bytes(data[:n]) == slow_crc32c(data[:n])
    zeros = F.lit(bytearray(16))
    row = spark.range(1).select(
        F.hex(S.gcm_tag(zeros, F.lit(bytearray(32)), F.lit(bytearray(12)), F.lit(bytearray()))).alias("tag"),
        F.hex(S.gcm_nonce(F.lit(0x0102030405060708), F.lit(9))).alias("nonce"),
        S.hmac_sha256(b"Jefe")(F.lit(bytearray(b"what do ya want for nothing?"))).alias("mac"),
        F.hex(S.framed(F.lit(258), F.lit(bytearray(b"xy")))).alias("framed"),
        S.xxh64_hex(F.lit(bytearray())).alias("h"),
    ).first()
    assert row.tag == "D0D1C8A799996BF0265B98B5D48AB919" and row.nonce == "080706050403090000000000"
    assert bytes(row.mac).hex() == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    assert row.framed == "503250534B303031" + "0201000000000000" + "02000000" + "7879" and row.h == "ef46db3751d8e999"


def test_secrets_and_key_order(spark):
    assert S.secret_of("00" * 16, "AAAA", "x") == bytes(16) and S.secret_of(None, "QUJDREVGR0hJSktMTU5PUA==") == b"ABCDEFGHIJKLMNOP" and S.secret_of(raw=" sixteen bytes ok ") == b"sixteen bytes ok"
    for bad in ({"hex_text": "00"}, {"base64_text": "!!"}, {"raw": "short"}, {}):
        with pytest.raises(ValueError):
            S.secret_of(**bad)
    journal = spark.createDataFrame([(1, "old"), (9, "new")], "since_lsn long, kid string")
    assert integrity.key_id("asked", journal, "env") == "asked" and integrity.key_id(None, journal, "env") == "new"
    assert integrity.key_id(None, journal.limit(0), "env") == "env" and integrity.key_id(None, None, None) == "default"
    kek, dek = b"e" * 32, b"d" * 32
    wrapped = spark.range(1).select(S.wrapped_key(F.lit(bytearray(dek)), F.lit(bytearray(kek)), F.lit(bytearray(12))).alias("w")).first().w
    ring = spark.createDataFrame([(0, "k", bytearray(b"older")), (1, "k", bytearray(wrapped))], "ord long, kid string, wrapped binary")
    assert integrity.data_key("k", ring, kek, None) == dek and integrity.data_key("z", ring, kek, b"s" * 32) == b"s" * 32
    with pytest.raises(KeyError):
        integrity.data_key("z", ring, kek, None)
    with pytest.raises(ValueError):
        integrity.data_key("k", ring, None, dek)


def test_filters_grow_and_never_hide(spark):
    from emberlog.operators import bloom

    keys = spark.createDataFrame([(i % 3, bytearray(f"k{i}".encode())) for i in range(60)], "bucket int, key binary")
    old, more = keys.where("bucket < 2").limit(30), spark.createDataFrame([(1, bytearray(b"late")), (2, bytearray(b"new")), (0, bytearray())], "bucket int, key binary")
    grown = bloom.updated(bloom.built(old, 64, 3), more, 64, 3)
    assert bloom.tested(grown, old.unionByName(more.where("octet_length(key) > 0")), 64, 3).where("not maybe").count() == 0
    both = bloom.built(old.unionByName(more.where("octet_length(key) > 0")), 64, 3)
    assert {(r.bucket, bytes(r.bits)) for r in grown.collect()} == {(r.bucket, bytes(r.bits)) for r in both.collect()}
    absent = spark.createDataFrame([(i % 3, bytearray(f"z{i}".encode())) for i in range(300)] + [(7, bytearray(b"k1"))], "bucket int, key binary")
    assert bloom.tested(both, absent, 64, 3).where("maybe").count() < 150 and not bloom.tested(both, absent.where("bucket = 7"), 64, 3).first().maybe
    assert [bloom.freshness(*x) for x in ((None, 4, 1, None, None), (1, 4, 1, 8, 1), (1, 4, 2, 4, 1), (1, 4, 1, 4, 1))] == ["absent", "buckets_mismatch", "stale_last_lsn", "fresh"]


def test_streamed_apply_survives_a_restart(spark, tmp_path):
    schema = "page_id long, lsn long, ord long, payload string"
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, 3, 0, "x"), (1, 2, 1, "y"), (2, 1, 2, "a")], schema).write.parquet(folder)
    apply.apply_pages(spark.readStream.schema(schema).parquet(folder), out, check).awaitTermination()
    spark.createDataFrame([(1, 3, 0, "z"), (2, 5, 3, "b")], schema).write.mode("append").parquet(folder)
    for _ in range(2):
        apply.apply_pages(spark.readStream.schema(schema).parquet(folder), out, check).awaitTermination()
    assert {(r.page_id, r.payload) for r in apply.page_state(spark, out).collect()} == {(1, "x"), (2, "b")}
    apply.compact_state(spark, out, str(tmp_path / "folded"))
    assert {(r.page_id, r.payload) for r in spark.read.parquet(str(tmp_path / "folded")).collect()} == {(1, "x"), (2, "b")}
    (tmp_path / "bytes").mkdir()
    for n in (3, 5):
        (tmp_path / "bytes" / f"{n}.seg").write_bytes(b"x" * n)
    assert tuple(stats.stored_bytes(spark, str(tmp_path / "bytes"), "*.seg").first()) == (2, 8)


def test_streamed_seq_gate(spark, tmp_path):
    schema = "stream_id string, ord long, seq long"
    folder = str(tmp_path / "in")
    spark.createDataFrame([("s", i, n) for i, n in enumerate([6, 4, 7, 7, 9])], schema).coalesce(1).write.parquet(folder)
    q = apply.seq_gate(spark.readStream.schema(schema).parquet(folder), 5).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    spark.createDataFrame([("s", 9, 8), ("s", 10, 10)], schema).coalesce(1).write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.seq for r in spark.table("gate").collect()) == [6, 7, 9, 10]


def test_page_sources(spark, tmp_path):
    pages.register(spark)
    size = 4096
    big = bytes(range(256)) * 20
    cap = size - 80
    placeholder = b"\x01\x10" + len(big).to_bytes(8, "little") + (1).to_bytes(8, "little")
    old = pages.kv_page(0, [(b"a", b"1", 0, False), (b"a", b"2", 0, False), (b"b", b"x", 0, False), (b"big", placeholder, 0, False)], size, 1)
    new = pages.kv_page(3, [(b"b", b"", 0, True), (b"c", b"3", 5, False)], size, 4, 0)
    broken = bytearray(pages.overflow_page(4, b"z", size))
    broken[70] ^= 1
    data = [old, pages.overflow_page(1, big[:cap], size, 2, 2), pages.overflow_page(2, big[cap:], size, 3), new, bytes(broken), bytes(size)]
    (tmp_path / "data-000001.p2seg").write_bytes(b"".join(data))
    read = lambda kind: spark.read.format(kind).option("page_size", size).load(str(tmp_path))
    report = integrity.doctor(read("kvpages")).first()
    read = lambda kind: spark.read.format(kind).options(page_size=size, corrupt="skip").load(str(tmp_path))
    assert (report.pages_total, report.ok_pages, report.crc_fail, report.zero_checksum) == (6, 4, 1, 1)
    assert (report.kv_pages, report.overflow_pages) == (2, 2)
    log = read("kvrecords").withColumn("seq", F.col("lsn") * 1000 + F.col("slot"))
    seen = {bytes(r.key): r for r in fold.visible(log, 10).collect()}
    assert set(seen) == {b"a", b"big"} and bytes(seen[b"a"].value) == b"2" and seen[b"big"].ovf.chain_id == 1
    parts = read("kvpages").where("page_type = 3 and ok").select(F.lit(1).alias("chain_id"), F.col("page_id").alias("chunk_no"), "codec_id", F.expr("substring(bytes, 65, chunk_len)").alias("payload"))
    assert bytes(overflow.reassembled(parts).first().value) == big
    (tmp_path / "dir-000").write_bytes(pages.directory_bytes([3, None]))
    heads = spark.read.format("kvdirectory").load(str(tmp_path / "dir-000")).collect()
    assert [(r.bucket, r.head_pid) for r in heads] == [(0, 3), (1, None)]
    with pytest.raises(ValueError):
        pages.kv_page(0, [(b"k", b"v" * 5000, 0, False)], size)


def test_stream_guards_and_keys(spark):
    frames = spark.createDataFrame([("a", 0, bytearray(wal.header(1))), ("a", 1, bytearray(b"x" * 90_000)), ("b", 0, bytearray(b"data"))], "stream_id string, ord long, payload binary")
    assert [r.stream_id for r in cdc.without_hello(frames).collect()] == ["b"]
    assert [r.ord for r in cdc.oversized(frames, 4096, 16).collect()] == [1]
    key, kek, nonce = bytearray(b"k" * 32), bytearray(b"e" * 32), bytearray(b"n" * 12)
    row = spark.range(1).select(S.unwrapped_key(S.wrapped_key(F.lit(key), F.lit(kek), F.lit(nonce)), F.lit(kek)).alias("k"), S.hex_lines(F.lit(bytearray(range(18)))).alias("h")).first()
    assert bytes(row.k) == bytes(key) and row.h == ["00 01 02 03 04 05 06 07 08 09 0a 0b 0c 0d 0e 0f", "10 11"]
