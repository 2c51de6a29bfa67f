"""Registry of the log engine's queries and of SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.config import Config
from emberlog.functions import scalars as S
from emberlog.functions.ordered import nearest_rank
from emberlog.operators import bloom, cdc, compaction, fold, integrity, overflow, paging, reads, snapshots, stats, writes
from emberlog.plans import testkit as K
from emberlog.sources import wal
from emberlog.store import Store

QUERIES, SQL = {}, {}
NOW = K.NOW

#: Tables that the SQL below shares.
LOG = f"""log AS (SELECT CAST(user_id AS VARCHAR) AS key, props AS value, event_type='error' AS tomb, event_id AS seq, event_id AS lsn,
  CASE WHEN event_type='view' THEN CAST(floor(epoch(ts)) AS BIGINT)+86400*(event_id%10) ELSE 0 END AS exp,
  CAST(('0x'||substr(md5(CAST(user_id AS VARCHAR)),1,8))::BIGINT % {K.BUCKETS} AS INTEGER) AS bucket FROM events),
live AS (SELECT * FROM log WHERE tomb OR exp=0 OR exp>{NOW}),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM live) WHERE rn=1),
visible AS (SELECT * FROM newest WHERE NOT tomb),
pages AS (SELECT *, CAST(floor((r-1)/{K.PAGE_RECORDS}) AS BIGINT) AS page_id, CAST((r-1)%{K.PAGE_RECORDS} AS BIGINT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) r FROM log)),
probes AS (SELECT c_custkey AS idx, CAST(c_custkey%400 AS VARCHAR) AS key FROM customer),
heads AS (SELECT CAST(b.range AS INTEGER) AS bucket, h.head_pid FROM range({K.BUCKETS}) b LEFT JOIN (SELECT bucket, max(page_id) head_pid FROM pages GROUP BY 1) h ON b.range=h.bucket)"""
FRAMES = """frames AS (SELECT CAST(user_id%8 AS VARCHAR) AS stream_id, event_id AS seq, event_id AS lsn,
  (event_id + ('0x'||substr(md5(CAST(event_id AS VARCHAR)),1,4))::BIGINT % 64)*1000000+event_id AS ord,
  CASE event_type WHEN 'signup' THEN 6 WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 ELSE 2 END AS rec_type, user_id AS page_id, length(props) AS len, props AS payload FROM events)"""
IMAGES = """images AS (SELECT p_partkey AS page_id, CASE WHEN p_partkey%5=0 THEN 3 WHEN p_partkey%7=0 THEN NULL WHEN p_partkey%19=0 THEN 9 ELSE 2 END AS page_type, p_partkey*3 AS lsn,
  p_name||'|'||p_brand||'|'||p_type AS content, CASE WHEN p_partkey%11=0 THEN 'bad checksum' WHEN p_partkey%13=0 THEN 'short read' WHEN p_partkey%17=0 THEN 'tag mismatch' END AS err, p_partkey%23=0 AS zero_crc FROM part)"""
OBJECTS = """objects AS (SELECT 's'||CAST(doc_id%5 AS VARCHAR) AS snapshot_id, doc_id AS page_id, sha256(text) AS hash_hex, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents)"""
CAP = overflow.capacity(K.PAGE_SIZE)
CHUNKS = f"""chunks AS (SELECT doc_id AS chain_id, CAST(i AS BIGINT) AS chunk_no, substring(hex(text), CAST(i*2*{CAP}+1 AS BIGINT), 2*{CAP}) AS h
  FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil(octet_length(encode(text))/{CAP}.0) AS BIGINT),1))) AS i FROM documents WHERE text IS NOT NULL AND octet_length(encode(text))>{K.THRESHOLD}))"""


def query(sql: str | None = None, *parts: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql
        return f

    return add


def long(*names):
    return [F.col(c).cast("long").alias(c) for c in names]


# ---- reads


@query("SELECT key, value, exp AS expires_at_sec FROM visible WHERE key='42'", LOG)
def kv_get(spark, sf):
    return reads.get(K.ev_log(spark, sf), F.lit("42"), NOW).select("key", "value", "expires_at_sec")


@query("SELECT count(*)>0 AS found FROM visible WHERE key='42'", LOG)
def kv_exists(spark, sf):
    return reads.exists(K.ev_log(spark, sf), F.lit("42"), NOW)


@query("SELECT p.idx, p.key, v.value FROM probes p LEFT JOIN visible v ON p.key=v.key", LOG)
def kv_get_many(spark, sf):
    return reads.get_many(K.ev_log(spark, sf), K.probes(spark, sf), NOW)


@query("SELECT p.idx, p.key, v.key IS NOT NULL AS found FROM probes p LEFT JOIN visible v ON p.key=v.key", LOG)
def kv_exists_many(spark, sf):
    return reads.exists_many(K.ev_log(spark, sf), K.probes(spark, sf), NOW)


@query("SELECT idx, key FROM probes WHERE key NOT IN (SELECT key FROM visible)", LOG)
def kv_missing_many(spark, sf):
    return reads.missing_many(K.ev_log(spark, sf), K.probes(spark, sf), NOW)


@query("SELECT key, value, exp AS expires_at_sec FROM visible", LOG)
def kv_scan_all(spark, sf):
    return reads.scan_all(K.ev_log(spark, sf), NOW)


@query("SELECT key, value, exp AS expires_at_sec FROM visible WHERE starts_with(key,'1')", LOG)
def kv_scan_prefix(spark, sf):
    return reads.scan_prefix(K.ev_log(spark, sf), "1", NOW)


@query("SELECT conv_id||'/'||turn AS key, text AS value, CAST(0 AS BIGINT) AS expires_at_sec FROM conversations WHERE role<>'system' AND starts_with(conv_id||'/','1')")
def kv_scan_prefix_binary(spark, sf):
    log = K.conv_log(spark, sf).withColumn("key", F.encode("key", "UTF-8"))
    return reads.scan_prefix(log, b"1", NOW).withColumn("key", F.decode("key", "UTF-8"))


@query("SELECT k.key, CASE WHEN n.key IS NULL THEN 'undecided' WHEN n.tomb THEN 'deleted' ELSE 'selected' END AS state FROM (SELECT DISTINCT key FROM log) k LEFT JOIN newest n ON k.key=n.key", LOG)
def kv_fold_states(spark, sf):
    return fold.states(K.ev_log(spark, sf), NOW)


@query(
    f"""SELECT k.key, k.page_id, CASE WHEN n.key IS NULL THEN 'continue' WHEN n.tomb THEN 'tombstone' ELSE 'valid' END AS decision
    FROM (SELECT DISTINCT key, page_id FROM pages) k LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, page_id ORDER BY seq DESC) rn FROM pages WHERE tomb OR exp=0 OR exp>{NOW}) WHERE rn=1) n ON k.key=n.key AND k.page_id=n.page_id""",
    LOG,
)
def kv_decide(spark, sf):
    return fold.decisions(K.ev_pages(spark, sf), NOW)


@query(
    f"""SELECT key, CASE WHEN NOT tomb THEN page_id END AS page_id, CASE WHEN NOT tomb THEN slot END AS slot, CASE WHEN tomb THEN 'deleted' ELSE 'located' END AS state
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM pages WHERE tomb OR exp=0 OR exp>{NOW}) WHERE rn=1""",
    LOG,
)
def keydir(spark, sf):
    return reads.keydir(K.ev_pages(spark, sf), NOW)


@query("""SELECT key, '{"key_hex":"'||lower(hex(key))||'","value_hex":"'||lower(hex(value))||'","key_len":'||octet_length(encode(key))||',"value_len":'||octet_length(encode(value))||'}' AS line FROM visible""", LOG)
def scan_json(spark, sf):
    return reads.scan_json(K.ev_log(spark, sf).transform(fold.visible, NOW))


@query(f"SELECT key, value, exp AS expires_at_sec FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM live WHERE lsn<=500) WHERE rn=1 AND NOT tomb", LOG)
def kv_as_of_lsn(spark, sf):
    return reads.as_of_lsn(K.ev_log(spark, sf), 500, NOW)


# ---- writes

PUT = ["key", "value", "expires_at_sec", "tombstone", "seq"]


@query("SELECT key, value, exp AS expires_at_sec FROM visible WHERE key<>'42' UNION ALL SELECT '42', 'new', 0", LOG)
def kv_put_append(spark, sf):
    log = K.ev_log(spark, sf).select(PUT)
    return reads.scan_all(writes.put(log, F.lit("42"), F.lit("new"), 1 << 40), NOW)


@query("SELECT key, value, exp AS expires_at_sec FROM visible WHERE key NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)", LOG)
def kv_del_append(spark, sf):
    keys = K.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_suppkey").alias("i"))
    return reads.scan_all(writes.delete(K.ev_log(spark, sf).select(PUT), keys, 1 << 40), NOW)


def _ops(spark, sf):
    """Operations of customers: deletes and puts, several a key."""
    c = K.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 300).cast("string").alias("key"), F.col("c_name").alias("value"), F.when(F.col("c_custkey") % 7 == 0, "del").otherwise("put").alias("op"), F.lit(0).cast("long").alias("expires_at_sec"))


OPS = "ops AS (SELECT c_custkey AS ord, CAST(c_custkey%300 AS VARCHAR) AS key, c_name AS value, c_custkey%7=0 AS tomb FROM customer), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC) rn2 FROM ops) WHERE rn2=1)"


@query("SELECT key, value, exp AS expires_at_sec FROM visible WHERE key NOT IN (SELECT key FROM last) UNION ALL SELECT key, value, 0 FROM last WHERE NOT tomb", LOG, OPS)
def kv_batch_apply(spark, sf):
    rows = writes.op_rows(_ops(spark, sf), 1 << 40, [F.col("ord")], F.floor(F.col("ord") / writes.BLOCK))
    return reads.scan_all(writes.appended(K.ev_log(spark, sf).select(PUT), rows), NOW)


@query("SELECT CAST(s_suppkey AS BIGINT) AS batch, CAST(i AS BIGINT) AS i, CASE WHEN i=0 THEN 'put' ELSE 'del' END AS op, 'k'||(s_suppkey+i) AS key, CASE WHEN i=0 THEN s_name END AS value FROM supplier, range(2) t(i)")
def batch_ops_json(spark, sf):
    s = K.table(spark, sf, "supplier")
    one = lambda op, key, value: F.struct(F.lit(op).alias("op"), key.alias("key"), value.alias("value"))
    ops = F.to_json(F.array(one("PUT", F.concat(F.lit("k"), F.col("s_suppkey").cast("string")), F.col("s_name")), one("del", F.concat(F.lit("k"), (F.col("s_suppkey") + 1).cast("string")), F.lit(None).cast("string"))))
    return writes.parsed_ops(s.select(F.col("s_suppkey").alias("batch"), ops.alias("json"))).select("batch", F.col("i").cast("long").alias("i"), "op", "key", "value")


@query("SELECT p_partkey, lower(hex(p_name)) AS value_hex FROM part")
def decode_value(spark, sf):
    p = K.table(spark, sf, "part")
    arg = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("hex:"), F.hex("p_name"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", F.lower(F.hex(S.decode_value(arg))).alias("value_hex"))


@query("SELECT CAST(h.bucket AS BIGINT) AS bucket, CASE WHEN u.bucket IS NULL THEN h.head_pid WHEN u.head_pid>=0 THEN u.head_pid END AS head_pid FROM heads h LEFT JOIN (SELECT bucket, max_by(head_pid, ord) head_pid FROM (SELECT s_suppkey ord, s_suppkey%20 AS bucket, CASE WHEN s_suppkey%3=0 THEN -1 ELSE s_suppkey*10 END AS head_pid FROM supplier) GROUP BY 1) u ON h.bucket=u.bucket", LOG)
def heads_apply(spark, sf):
    k = F.col("s_suppkey")
    updates = K.table(spark, sf, "supplier").select(k.alias("ord"), (k % 20).cast("int").alias("bucket"), F.when(k % 3 == 0, F.lit(-1).cast("long")).otherwise(k * 10).alias("head_pid"))
    return writes.set_heads(K.heads(spark, sf), updates).select(*long("bucket"), "head_pid")


@query("SELECT o_orderkey AS page_id, 1000+row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS lsn FROM orders")
def assign_lsn(spark, sf):
    rows = K.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), "o_orderdate")
    return writes.assign_lsn(rows, 1000, [F.col("o_orderdate"), F.col("page_id")], F.to_date("o_orderdate")).select("page_id", "lsn")


# ---- large values


@query(f"SELECT doc_id AS chain_id, CAST(octet_length(encode(text)) AS BIGINT) AS value_len, CASE WHEN octet_length(encode(text))>{K.THRESHOLD} THEN 'overflow' ELSE 'inline' END AS placement FROM documents")
def value_placement(spark, sf):
    return overflow.placed(K.doc_values(spark, sf), K.THRESHOLD).select("chain_id", "value_len", "placement")


def _large(spark, sf):
    return overflow.placed(K.doc_values(spark, sf), K.THRESHOLD).where("placement = 'overflow'")


def _chunks(spark, sf, codec=0):
    return overflow.chunks(_large(spark, sf), K.PAGE_SIZE, codec)


@query("SELECT chain_id, chunk_no, CAST(length(h)//2 AS BIGINT) AS chunk_len, md5(h) AS payload_md5 FROM chunks", CHUNKS)
def ovf_chunks(spark, sf):
    return _chunks(spark, sf).select("chain_id", *long("chunk_no", "chunk_len"), F.md5(F.hex("payload")).alias("payload_md5"))


@query(f"SELECT doc_id AS chain_id, CAST(octet_length(encode(text)) AS BIGINT) AS total_len, sha256(text) AS hash_hex FROM documents WHERE octet_length(encode(text))>{K.THRESHOLD}")
def ovf_reassemble(spark, sf):
    return overflow.reassembled(_chunks(spark, sf)).select("chain_id", "total_len", F.sha2("value", 256).alias("hash_hex"))


@query(f"SELECT doc_id AS chain_id, CAST(octet_length(encode(text)) AS BIGINT) AS total_len, sha256(text) AS hash_hex FROM documents WHERE octet_length(encode(text))>{K.THRESHOLD}")
def ovf_reassemble_zstd(spark, sf):
    return overflow.reassembled(_chunks(spark, sf, 1), True).select("chain_id", "total_len", F.sha2("value", 256).alias("hash_hex"))


@query("SELECT c.chain_id, c.total_len, coalesce(f.n,0)::BIGINT AS found_len FROM (SELECT chain_id, sum(length(h)//2)::BIGINT AS total_len FROM chunks GROUP BY 1) c LEFT JOIN (SELECT chain_id, sum(length(h)//2) n FROM chunks WHERE NOT (chain_id%10=3 AND chunk_no=0) GROUP BY 1) f ON c.chain_id=f.chain_id WHERE c.total_len<>coalesce(f.n,0)", CHUNKS)
def ovf_bad_length(spark, sf):
    stated = _large(spark, sf).select("chain_id", F.col("value_len").alias("total_len"))
    return overflow.bad_lengths(stated, _chunks(spark, sf).where("not (chain_id % 10 = 3 and chunk_no = 0)"))


@query("SELECT count(*) AS pages, CAST(sum(length(h)//2) AS BIGINT) AS bytes FROM chunks", CHUNKS)
def overflow_stats(spark, sf):
    return stats.overflow_stats(_chunks(spark, sf))


# ---- maintenance

REPORT = f"""report AS (SELECT b.bucket, b.n AS old_chain_len, coalesce(k.kept,0)::BIGINT AS keys_kept, coalesce(k.del,0)::BIGINT AS keys_deleted, CAST(ceil(coalesce(k.kept,0)/{K.PAGE_RECORDS}.0) AS BIGINT) AS pages_written
  FROM (SELECT bucket, count(DISTINCT page_id) n FROM pages GROUP BY 1) b LEFT JOIN (SELECT bucket, count(*) FILTER (NOT tomb) kept, count(*) FILTER (tomb) del FROM newest GROUP BY 1) k ON b.bucket=k.bucket),
named AS (SELECT DISTINCT l_orderkey AS chain_id FROM lineitem WHERE l_returnflag<>'R'),
orphans AS (SELECT o_orderkey AS page_id FROM orders WHERE o_orderkey NOT IN (SELECT chain_id FROM named))"""


def _reports(spark, sf):
    return compaction.bucket_reports(K.ev_pages(spark, sf), NOW, K.PAGE_RECORDS)


@query("SELECT CAST(bucket AS BIGINT) AS bucket, old_chain_len, keys_kept, keys_deleted, pages_written FROM report", LOG, REPORT)
def compact_bucket_report(spark, sf):
    return _reports(spark, sf).select(*long("bucket"), "old_chain_len", "keys_kept", "keys_deleted", "pages_written")


SUMMARY = "count(*) AS buckets_compacted, sum(old_chain_len)::BIGINT AS old_chain_len, sum(keys_kept)::BIGINT AS keys_kept, sum(keys_deleted)::BIGINT AS keys_deleted, sum(pages_written)::BIGINT AS pages_written"


@query(f"SELECT {SUMMARY} FROM report", LOG, REPORT)
def compact_all_summary(spark, sf):
    return compaction.summary(_reports(spark, sf))


@query("SELECT CAST(bucket AS BIGINT) AS bucket, key, value, exp AS expires_at_sec FROM visible", LOG)
def compact_output(spark, sf):
    return compaction.survivors(K.ev_log(spark, sf), NOW).select(*long("bucket"), "key", "value", "expires_at_sec")


def _orphans(spark, sf):
    """Orders as overflow pages, items as records that name them; returned items are tombstones."""
    pages = K.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").alias("chain_id"))
    log = K.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chain_id"), (F.col("l_returnflag") == "R").alias("tombstone"))
    return compaction.orphans(pages, log).select("page_id")


@query("SELECT page_id FROM orphans", LOG, REPORT)
def sweep_orphans(spark, sf):
    return _orphans(spark, sf)


@query(f"SELECT {SUMMARY}, (SELECT count(*) FROM orphans) AS overflow_pages_freed FROM report", LOG, REPORT)
def vacuum_summary(spark, sf):
    return compaction.vacuum(_reports(spark, sf), _orphans(spark, sf))


@query("SELECT CAST(bucket AS BIGINT) AS bucket, old_chain_len, keys_kept, keys_deleted, pages_written FROM report WHERE bucket IN (SELECT bucket FROM heads WHERE head_pid IS NOT NULL ORDER BY bucket LIMIT 5)", LOG, REPORT)
def auto_maint_buckets(spark, sf):
    return compaction.auto_maintenance(K.ev_pages(spark, sf), K.heads(spark, sf), 5, NOW, K.PAGE_RECORDS).select(*long("bucket"), "old_chain_len", "keys_kept", "keys_deleted", "pages_written")


@query("SELECT CAST(bucket AS BIGINT) AS bucket, old_chain_len AS chain_len FROM report WHERE old_chain_len>=20", LOG, REPORT)
def lazy_compact_candidates(spark, sf):
    return compaction.long_chains(K.ev_pages(spark, sf), 20).select(*long("bucket"), "chain_len")


@query(
    f"""SELECT bucket, CAST(page_no AS BIGINT) AS page_no, count(*) AS records, CAST(sum(size) AS BIGINT) AS data_bytes FROM filled GROUP BY 1, 2""",
    LOG,
    f"""sized AS (SELECT bucket, octet_length(encode(key))+coalesce(octet_length(encode(value)),0)+11 AS size, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS i FROM log),
    filled AS (SELECT bucket, i, size, 0 AS page_no, 1 AS n, size AS used FROM sized WHERE i=1
      UNION ALL SELECT s.bucket, s.i, s.size, CASE WHEN f.used+s.size+6*(f.n+1)+80>{K.PAGE_SIZE} THEN f.page_no+1 ELSE f.page_no END,
      CASE WHEN f.used+s.size+6*(f.n+1)+80>{K.PAGE_SIZE} THEN 1 ELSE f.n+1 END, CASE WHEN f.used+s.size+6*(f.n+1)+80>{K.PAGE_SIZE} THEN s.size ELSE f.used+s.size END
      FROM filled f JOIN sized s ON s.bucket=f.bucket AND s.i=f.i+1)""",
)
def pack_pages(spark, sf):
    return compaction.packed(K.ev_log(spark, sf), K.PAGE_SIZE, F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 11)


#: XXH64 of keys of up to 31 bytes in SQL, in 128-bit arithmetic: a lane of eight bytes each, then one of four, then single bytes.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
M64 = (1 << 64) - 1


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _times(a: str, b: int) -> str:
    return f"((({a}) * {_u(b)}) & {_u(M64)})"


def _turn(a: str, n: int) -> str:
    """Rotation to the left, as products and quotients of powers of two."""
    return f"(((({a}) * {_u(1 << n)}) & {_u(M64)}) + (({a}) // {_u(1 << (64 - n))}))"


def _xxh64(key: str, seed: int, out: str) -> str:
    """A table `out` (key, h) of the distinct keys of the table `key`."""
    value = lambda at, n: "(" + " + ".join(f"list_extract(b, CAST({at} + {k} AS INTEGER))::UHUGEINT * {_u(256**k)}" for k in range(n)) + ")"
    add = lambda a, b: f"((({a}) + ({b})) & {_u(M64)})"
    lane = f"xor(h, {_times(_turn(_times('v', P2), 31), P1)})"
    return f"""{out}_0 AS (SELECT key, len(b) AS n, b, {add(_u((seed + P5) & M64), 'len(b)::UHUGEINT')} AS h FROM (SELECT key, [CAST(('0x'||substr(hex(encode(key)), 2*i+1, 2)) AS INTEGER) FOR i IN range(octet_length(encode(key)))] AS b FROM (SELECT DISTINCT key FROM {key}))),
    {out}_8 AS (SELECT key, n, b, 0 AS i, h FROM {out}_0 UNION ALL SELECT key, n, b, i+8, {add(_times(_turn(lane, 27), P1), _u(P4))} FROM (SELECT *, {value('i+1', 8)} AS v FROM {out}_8 WHERE i+8<=n)),
    {out}_8e AS (SELECT key, n, b, max(i) AS i, max_by(h, i) AS h FROM {out}_8 GROUP BY 1, 2, 3),
    {out}_4 AS (SELECT key, n, b, i, h FROM {out}_8e WHERE i+4>n UNION ALL SELECT key, n, b, i+4, {add(_times(_turn(f"xor(h, {_times('v', P1)})", 23), P2), _u(P3))} FROM (SELECT *, {value('i+1', 4)} AS v FROM {out}_8e WHERE i+4<=n)),
    {out}_1 AS (SELECT key, n, b, i, h FROM {out}_4 UNION ALL SELECT key, n, b, i+1, {_times(_turn(f"xor(h, {_times('v', P5)})", 11), P1)} FROM (SELECT *, {value('i+1', 1)} AS v FROM {out}_1 WHERE i+1<=n)),
    {out}_e AS (SELECT key, h FROM {out}_1 WHERE i=n),
    {out} AS (SELECT key, xor(h, h // {_u(1 << 32)}) AS h FROM (SELECT key, {_times(f"xor(h, h // {_u(1 << 29)})", P3)} AS h FROM (SELECT key, {_times(f"xor(h, h // {_u(1 << 33)})", P2)} AS h FROM {out}_e)))"""


@query(
    f"SELECT DISTINCT CAST(v.bucket AS BIGINT) AS bucket, CAST(((a.h + ((i::UHUGEINT * b.h) & {_u(M64)})) & {_u(M64)}) % 32768 AS BIGINT) AS bit FROM visible v JOIN h1 a ON v.key=a.key JOIN h2 b ON v.key=b.key, range({bloom.HASHES}) t(i)",
    LOG, _xxh64("visible", bloom.SEEDS[0], "h1"), _xxh64("visible", bloom.SEEDS[1], "h2"),
)
def bloom_bits(spark, sf):
    """Set bits of each bucket's filter over the visible keys."""
    keys = reads.scan_all(K.ev_log(spark, sf), NOW).select("key")
    return bloom.set_bits(keys.select(S.bucket_of(F.col("key"), K.BUCKETS).alias("bucket"), F.encode("key", "UTF-8").alias("key"))).select(*long("bucket"), "bit")


@query("SELECT p.idx, p.key, v.key IS NOT NULL AS found FROM probes p LEFT JOIN visible v ON p.key=v.key WHERE v.key IS NOT NULL", LOG)
def bloom_probe(spark, sf):
    """Probes that the filters let through and that are there: a filter never hides a key."""
    log = K.ev_log(spark, sf)
    keys = reads.scan_all(log, NOW).select("key")
    dealt = lambda df: df.withColumn("bucket", S.bucket_of(F.col("key"), K.BUCKETS)).withColumn("text", F.col("key")).withColumn("key", F.encode("key", "UTF-8"))
    maybe = bloom.tested(bloom.built(dealt(keys).select("bucket", "key")), dealt(K.probes(spark, sf))).where("maybe").select("idx", F.col("text").alias("key"))
    return reads.exists_many(log, maybe, NOW).where("found")


# ---- statistics


@query("SELECT count(*) AS buckets, count(head_pid) AS used_buckets FROM heads", LOG)
def used_buckets(spark, sf):
    return stats.used_buckets(K.heads(spark, sf))


@query("SELECT count(*) AS buckets, min(n)::BIGINT AS min_len, avg(n)::DOUBLE AS avg_len, max(n)::BIGINT AS max_len FROM (SELECT bucket, count(DISTINCT page_id) n FROM pages GROUP BY 1)", LOG)
def chain_stats(spark, sf):
    return stats.chain_stats(K.ev_pages(spark, sf))


@query("SELECT count(*) AS pages, sum(n)::DOUBLE/count(*) AS avg_records, count(*) FILTER (n=1) AS single_record_pages FROM (SELECT bucket, page_id, count(*) n FROM pages GROUP BY 1,2)", LOG)
def pack_stats(spark, sf):
    return stats.pack_stats(K.ev_pages(spark, sf))


COUNTERS = "SELECT CAST(l_suppkey AS VARCHAR) AS name, count(*) FILTER (l_returnflag='A') AS hits, count(*) FILTER (l_returnflag='N' AND l_suppkey%3<>0) AS misses, count(*) AS pages, count(*) FILTER (l_linenumber=1 AND l_suppkey%5<>0) AS batches FROM lineitem GROUP BY 1"


@query(f"SELECT name, CASE WHEN hits+misses=0 THEN 0 ELSE hits::DOUBLE/(hits+misses) END AS hit_ratio, CASE WHEN batches=0 THEN 0 ELSE pages::DOUBLE/batches END AS avg_batch_pages FROM ({COUNTERS})")
def ratio_metrics(spark, sf):
    flag, k = F.col("l_returnflag"), F.col("l_suppkey")
    rows = K.table(spark, sf, "lineitem").groupBy(k.cast("string").alias("name")).agg(F.count_if(flag == "A").alias("hits"), F.count_if((flag == "N") & (k % 3 != 0)).alias("misses"), F.count("*").alias("pages"), F.count_if((F.col("l_linenumber") == 1) & (k % 5 != 0)).alias("batches"))
    return stats.ratios(rows)


@query("SELECT q, x[1+CAST(round((n-1)*q) AS INTEGER)] AS v FROM (SELECT list_sort(list(value)) x, count(value) n FROM events), (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) q)")
def latency_percentiles(spark, sf):
    return nearest_rank(K.table(spark, sf, "events"), "value", [0.5, 0.9, 0.99])


STATUS = """(SELECT count(DISTINCT key) FROM log) AS keys, (SELECT count(*) FROM log) AS versions, (SELECT count(*) FROM visible) AS visible_keys, (SELECT count(*) FROM newest WHERE tomb) AS deleted_keys, (SELECT max(lsn) FROM log) AS last_lsn,
  (SELECT count(head_pid) FROM heads) AS used_buckets, (SELECT count(*) FROM heads) AS buckets, (SELECT max(n) FROM chains) AS chain_max, (SELECT min(n) FROM chains) AS chain_min, (SELECT sum(n)::BIGINT FROM chains) AS pages,
  (SELECT count(*) FROM (SELECT 1 FROM pages GROUP BY bucket, page_id HAVING count(*)=1)) AS single_record_pages, (SELECT sum(octet_length(encode(value)))::BIGINT FROM log) AS value_bytes"""
CHAINS = "chains AS (SELECT bucket, count(DISTINCT page_id) n FROM pages GROUP BY 1)"
STATUS_NAMES = ["keys", "versions", "visible_keys", "deleted_keys", "last_lsn", "used_buckets", "buckets", "chain_max", "chain_min", "pages", "single_record_pages", "value_bytes"]


def _status(spark, sf):
    log, pages = K.ev_log(spark, sf), K.ev_pages(spark, sf)
    one = lambda df: df.withColumn("one__", F.lit(1))
    whole = log.agg(F.count_distinct("key").alias("keys"), F.count("*").alias("versions"), F.max("lsn").alias("last_lsn"), F.sum(F.octet_length("value")).alias("value_bytes"))
    seen = fold.newest(log.drop("value"), NOW).agg(F.count_if(~F.col("tombstone")).alias("visible_keys"), F.count_if("tombstone").alias("deleted_keys"))
    packs = stats.pack_stats(pages).select("pages", "single_record_pages")
    chains = stats.chain_stats(pages).select(F.col("min_len").alias("chain_min"), F.col("max_len").alias("chain_max"))
    out = one(whole)
    for part in (seen, packs, chains, stats.used_buckets(K.heads(spark, sf))):
        out = out.join(one(part), "one__")
    return out.select(STATUS_NAMES)


@query("SELECT '{" + ",".join(f'"{n}":\'||{n}||\'' for n in STATUS_NAMES) + f"}}' AS status FROM (SELECT {STATUS})", LOG, CHAINS)
def status_json(spark, sf):
    return stats.status_json(_status(spark, sf))


@query("SELECT unnest([" + ", ".join(f"'emberlog_{n} '||{n}" for n in sorted(STATUS_NAMES)) + f"]) AS line FROM (SELECT {STATUS})", LOG, CHAINS)
def prometheus_text(spark, sf):
    return stats.prometheus_text(_status(spark, sf))


# ---- change shipping

SHIP = ["stream_id", "lsn", "rec_type", "page_id"]
SHIP_SQL = "stream_id, lsn, rec_type::BIGINT AS rec_type, page_id"


def _ship(df):
    return df.select("stream_id", "lsn", *long("rec_type"), "page_id")


@query(f"SELECT {SHIP_SQL} FROM frames WHERE lsn>500", FRAMES)
def cdc_ship_since(spark, sf):
    return _ship(cdc.ship_since(K.frames(spark, sf), 500))


@query(f"SELECT {SHIP_SQL} FROM frames WHERE lsn>=500", FRAMES)
def cdc_ship_since_inclusive(spark, sf):
    return _ship(cdc.ship_since(K.frames(spark, sf), 500, True))


@query("SELECT count(*) AS frames, coalesce(sum(len),0)::BIGINT AS bytes, coalesce(max(lsn),0)::BIGINT AS last_lsn FROM frames WHERE lsn>500", FRAMES)
def cdc_ship_summary(spark, sf):
    return cdc.ship_summary(cdc.ship_since(K.frames(spark, sf), 500))


BLOCK = 1_000_000 * 4096


def _block():
    return F.floor(F.col("ord") / F.lit(BLOCK))


@query("SELECT ord, 77+row_number() OVER (ORDER BY ord) AS seq FROM frames", FRAMES)
def cdc_seq(spark, sf):
    return cdc.with_seq(K.frames(spark, sf).drop("seq"), 77, [F.col("ord")], _block()).select("ord", "seq")


GATED = "gated AS (SELECT *, greatest(coalesce(max(seq) OVER (PARTITION BY stream_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100), 100) AS top FROM frames)"


@query("SELECT stream_id, ord, seq FROM gated WHERE seq>top", FRAMES, GATED)
def cdc_seq_gate(spark, sf):
    return cdc.seq_gate(K.frames(spark, sf), 100, _block(), ["stream_id"]).select("stream_id", "ord", "seq")


@query("SELECT stream_id, ord, seq FROM gated WHERE seq<=top", FRAMES, GATED)
def cdc_seq_violations(spark, sf):
    return cdc.violations(K.frames(spark, sf), 100, _block(), ["stream_id"]).select("stream_id", "ord", "seq")


@query("SELECT page_id, lsn, payload FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY lsn//10 DESC, ord) rn FROM frames WHERE rec_type=2) WHERE rn=1", FRAMES)
def cdc_apply_pages(spark, sf):
    rows = K.frames(spark, sf).where("rec_type = 2").withColumn("own", F.col("lsn")).withColumn("lsn", F.expr("lsn div 10"))
    top = cdc.applied_pages(rows.withColumn("payload", F.struct("own", "payload")))
    return top.select("page_id", F.col("payload.own").alias("lsn"), F.col("payload.payload").alias("payload"))


def _heads_frames(spark, sf):
    """Heads payloads of 12-byte entries built from orders; every ninth has a wrong length."""
    o = K.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    le = lambda c, n: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(c), 2 * n, "0"), 2 * (n - 1 - i) + 1, 2) for i in range(n))))
    entry = lambda b, p: F.concat(le(b, 4), le(p, 8))
    two = F.concat(entry(k % 16, k), entry(k % 16 + 1, k + 1))
    payload = F.when(k % 9 == 0, F.substring(two, 1, 11)).otherwise(two)
    late = F.pmod(F.conv(F.substring(F.md5(k.cast("string")), 1, 4), 16, 10).cast("long"), F.lit(32))
    return o.select(k.alias("lsn"), ((k + late) * 1000000 + k).alias("ord"), payload.alias("payload"))


HEADS_SQL = "hf AS (SELECT o_orderkey AS lsn, (o_orderkey + ('0x'||substr(md5(CAST(o_orderkey AS VARCHAR)),1,4))::BIGINT % 32)*1000000+o_orderkey AS ord FROM orders), ok AS (SELECT *, greatest(coalesce(max(lsn) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),10),10) AS top FROM hf WHERE lsn%9<>0)"


@query("SELECT bucket, max_by(head_pid, o2) AS head_pid FROM (SELECT lsn%16+i AS bucket, lsn+i AS head_pid, ord*2+i AS o2 FROM ok, range(2) t(i) WHERE lsn>top) GROUP BY 1", HEADS_SQL)
def cdc_apply_heads(spark, sf):
    return cdc.applied_heads(_heads_frames(spark, sf), 10, _block()).select(*long("bucket"), "head_pid")


@query("SELECT lsn, 11::BIGINT AS n FROM hf WHERE lsn%9=0", HEADS_SQL)
def cdc_bad_heads(spark, sf):
    return cdc.bad_heads(_heads_frames(spark, sf)).select("lsn", F.octet_length("payload").cast("long").alias("n"))


@query("SELECT stream_id, ord FROM frames WHERE stream_id<>'3'", FRAMES)
def cdc_foreign_frames(spark, sf):
    return cdc.foreign(K.frames(spark, sf), "3").select("stream_id", "ord")


@query("SELECT stream_id, ord, (b IS NULL OR b=5) AS skipped FROM (SELECT *, lag(rec_type) OVER (PARTITION BY stream_id ORDER BY ord) b FROM (SELECT stream_id, ord, CASE rec_type WHEN 4 THEN 0 ELSE rec_type END AS rec_type FROM frames)) WHERE rec_type=0", FRAMES)
def wal_midheader(spark, sf):
    rows = K.frames(spark, sf).withColumn("rec_type", F.when(F.col("rec_type") == 4, 0).otherwise(F.col("rec_type")))
    return cdc.mid_headers(rows)


@query(
    """SELECT page_id, lsn, payload FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY lsn DESC, ord) rn FROM
    (SELECT page_id, lsn, ord, payload FROM frames WHERE rec_type=2 UNION ALL SELECT c_custkey, 300, -1, c_name FROM customer)) WHERE rn=1""",
    FRAMES,
)
def wal_replay_state(spark, sf):
    current = K.table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), F.lit(300).cast("long").alias("lsn"), F.col("c_name").alias("payload"))
    return cdc.replayed(K.frames(spark, sf), current).select("page_id", "lsn", "payload")


@query("SELECT stream_id, max(lsn) AS last_lsn, max(lsn) FILTER (rec_type=6) AS last_heads_lsn, count(*) AS frames FROM frames GROUP BY 1", FRAMES)
def cdc_progress(spark, sf):
    return cdc.progress(K.frames(spark, sf), ["stream_id"])


def _pad(secret: bytes, byte: int) -> str:
    return "from_hex('" + bytes(x ^ byte for x in secret.ljust(64, b"\0")).hex() + "')"


SECRET = b"a shared secret!"
_LE = lambda c, n: "from_hex(" + "||".join(f"lpad(hex(({c} // {256**k}) % 256), 2, '0')" for k in range(n)) + ")"
MAC_BODY = f"from_hex('{S.FRAME_MAGIC.hex()}')||{_LE('seq', 8)}||{_LE('octet_length(encode(payload))', 4)}||encode(payload)"


@query(f"SELECT stream_id, seq, sha256({_pad(SECRET, 0x5C)}||from_hex(sha256({_pad(SECRET, 0x36)}||{MAC_BODY}))) AS mac, seq%10<>0 AS mac_ok FROM frames", FRAMES)
def cdc_mac_ok(spark, sf):
    """Each frame's MAC under a shared secret, and whether the one that came with it holds; every tenth is forged."""
    rows = K.frames(spark, sf).select("stream_id", "seq", S.framed(F.col("seq"), F.encode("payload", "UTF-8")).alias("body"))
    rows = rows.withColumn("own", S.hmac_sha256(SECRET)("body"))
    sent = rows.withColumn("sent", F.when(F.col("seq") % 10 == 0, F.unhex(F.sha2("body", 256))).otherwise(F.col("own")))
    return sent.select("stream_id", "seq", F.lower(F.hex("own")).alias("mac"), (F.col("own") == F.col("sent")).alias("mac_ok"))


# ---- snapshots


@query("SELECT page_id, sha256(content) AS hash_hex FROM images", IMAGES)
def content_hash(spark, sf):
    return K.page_images(spark, sf).select("page_id", F.sha2("content", 256).alias("hash_hex"))


@query("SELECT page_id, sha256(content) AS hash_hex, CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM images WHERE err IS NULL", IMAGES)
def snap_manifest_objects(spark, sf):
    return snapshots.objects_of(K.page_images(spark, sf))


@query("SELECT ord, hash_hex, n>1 AS existed_before, n AS refcount FROM (SELECT ord, hash_hex, row_number() OVER (PARTITION BY hash_hex ORDER BY ord) n FROM (SELECT event_id AS ord, sha256(props) AS hash_hex FROM events))")
def snap_put_trace(spark, sf):
    return snapshots.put_trace(K.table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.col("props").alias("content")))


@query("SELECT DISTINCT sha256(props) AS hash_hex, CAST(octet_length(encode(props)) AS BIGINT) AS bytes FROM events")
def snap_dedup(spark, sf):
    return snapshots.deduplicated(K.table(spark, sf, "events").select(F.col("props").alias("content")))


@query("SELECT hash_hex, count(*) AS refcount FROM objects GROUP BY 1", OBJECTS)
def snap_refcounts(spark, sf):
    return snapshots.refcounts(K.manifest_objects(spark, sf))


@query("SELECT DISTINCT snapshot_id FROM objects", OBJECTS)
def snap_list(spark, sf):
    return snapshots.listed(K.manifest_objects(spark, sf))


@query("SELECT DISTINCT hash_hex FROM objects WHERE snapshot_id='s3' AND hash_hex NOT IN (SELECT hash_hex FROM objects WHERE snapshot_id<>'s3')", OBJECTS)
def snap_gc(spark, sf):
    return snapshots.collectable(K.manifest_objects(spark, sf), "s3")


@query("SELECT page_id, hash_hex, md5(text) AS content_md5 FROM objects JOIN documents ON page_id=doc_id WHERE snapshot_id='s2'", OBJECTS)
def snap_restore(spark, sf):
    d = K.table(spark, sf, "documents")
    store = d.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("hash_hex"), F.encode("text", "UTF-8").alias("content")).dropDuplicates(["hash_hex"])
    return snapshots.restored(K.manifest_objects(spark, sf), store, "s2").select("page_id", "hash_hex", F.md5("content").alias("content_md5"))


# ---- integrity


@query(
    """SELECT count(*) AS pages_total, count(*) FILTER (s='ok') AS ok_pages, count(*) FILTER (zero_crc) AS zero_checksum, count(*) FILTER (s='crc') AS crc_fail, count(*) FILTER (s='io') AS io_fail,
    count(*) FILTER (s='ok' AND page_type=2) AS kv_pages, count(*) FILTER (s='ok' AND page_type=3) AS overflow_pages, count(*) FILTER (s='ok' AND page_type=9) AS other_magic, count(*) FILTER (s='ok' AND page_type IS NULL) AS no_magic
    FROM (SELECT *, CASE WHEN zero_crc THEN 'zero' WHEN err IS NULL THEN 'ok' WHEN err='short read' THEN 'io' ELSE 'crc' END AS s FROM images)""",
    IMAGES,
)
def doctor_report(spark, sf):
    return integrity.doctor(K.page_images(spark, sf))


@query("SELECT coalesce(page_type,0)::BIGINT AS page_type, count(*) AS pages, max(lsn) AS last_lsn, sum(octet_length(encode(content)))::BIGINT AS bytes FROM images GROUP BY 1", IMAGES)
def page_inventory(spark, sf):
    return integrity.inventory(K.page_images(spark, sf)).select(*long("page_type"), "pages", "last_lsn", "bytes")


@query("SELECT page_id, CASE WHEN page_id%2=0 AND lsn>=900 THEN 'tag' WHEN err IS NULL AND lsn<900 THEN 'crc' ELSE 'none' END AS trust FROM images", IMAGES)
def page_trust(spark, sf):
    return K.page_images(spark, sf).select("page_id", integrity.trusted(F.col("page_id") % 2 == 0, F.col("ok"), F.col("lsn"), F.lit(900)).alias("trust"))


@query("SELECT i.page_id, (SELECT 'k'||max(s_suppkey) FROM supplier WHERE s_suppkey*40<=i.lsn) AS kid FROM images i", IMAGES)
def epoch_of_lsn(spark, sf):
    epochs = K.table(spark, sf, "supplier").select((F.col("s_suppkey") * 40).alias("since_lsn"), F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("kid"))
    return integrity.epoch_of(K.page_images(spark, sf).select("page_id", "lsn"), epochs).select("page_id", "kid")


@query("SELECT o_orderkey AS page_id, (o_orderkey*4096)//33554432 AS segment, (o_orderkey*4096)%33554432 AS \"offset\" FROM orders")
def page_location(spark, sf):
    return K.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), S.page_location(F.col("o_orderkey"), 4096).alias("at")).select("page_id", "at.segment", "at.offset")


@query("SELECT p_partkey, bit_count(p_partkey*64)=1 AND p_partkey*64 BETWEEN 4096 AND 1048576 AS valid FROM part")
def page_size_valid(spark, sf):
    return K.table(spark, sf, "part").select("p_partkey", S.page_size_valid(F.col("p_partkey") * 64).alias("valid"))


PAGE_BYTES = "encode(rpad(content, 240, ' '))||from_hex('" + "00" * 16 + "')"


@query(
    "SELECT page_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(('0x'||substr(hex(page), CAST(2*i+1 AS BIGINT), 2)) AS BIGINT) FOR i IN range(256)]), lambda c, b: xor(c//256, t[CAST(xor(c%256, b) AS INTEGER)+1])), 4294967295) AS crc32c FROM bare, (SELECT list(v ORDER BY k) AS t FROM crc_table)",
    IMAGES,
    "steps AS (SELECT k, k AS v, 0 AS i FROM (SELECT unnest(range(256))::BIGINT AS k) UNION ALL SELECT k, CASE WHEN v%2=1 THEN xor(v//2, 2197175160) ELSE v//2 END, i+1 FROM steps WHERE i<8)",
    "crc_table AS (SELECT k, v FROM steps WHERE i=8)",
    f"bare AS (SELECT page_id, {PAGE_BYTES} AS page FROM images)",
)
def page_crc(spark, sf):
    """CRC32C of pages with their trailer zeroed."""
    return _whole_pages(spark, sf).select("page_id", S.crc32c(S.bare_page(F.col("page"))).alias("crc32c"))


def _whole_pages(spark, sf):
    """Pages of 256 bytes whose trailers hold something."""
    page = F.concat(F.encode(F.rpad("content", 240, " "), "UTF-8"), F.lit(bytearray(b"\x07" * 16)))
    return K.page_images(spark, sf).withColumn("page", page)


@query(f"SELECT key, lpad(lower(format('{{:x}}', h)), 16, '0') AS xxh64, CAST(h % 256 AS INTEGER) AS fingerprint, CAST(h % {K.BUCKETS} AS INTEGER) AS bucket FROM kh", LOG, _xxh64("log", 0, "kh"))
def key_hash(spark, sf):
    """XXH64 (seed 0) of keys, the eight-bit fingerprint in it, and the bucket as the binary files have it."""
    keys = K.ev_log(spark, sf).select("key").distinct().withColumn("xxh64", S.xxh64_hex(F.encode("key", "UTF-8")))
    return keys.select("key", "xxh64", F.conv(F.substring("xxh64", 15, 2), 16, 10).cast("int").alias("fingerprint"), S.bucket_of_xxh64(F.encode("key", "UTF-8"), K.BUCKETS).alias("bucket"))


@query()
def aead_tag(spark, sf):
    """Tags of pages under a fixed key, and whether the page that holds its tag is found sound (every seventh is changed)."""
    key = F.unhex(F.lit("11" * 32))
    rows = _whole_pages(spark, sf).withColumn("tag", S.page_tag(F.col("page"), key, F.col("page_id"), F.col("lsn")))
    body = F.when(F.col("page_id") % 7 == 0, F.overlay("page", F.lit(bytearray(b"?")), 100)).otherwise(F.col("page"))
    rows = rows.withColumn("sealed", F.concat(F.substring(body, 1, 240), F.col("tag")))
    return rows.select("page_id", F.lower(F.hex("tag")).alias("tag"), S.page_tag_ok(F.col("sealed"), key, F.col("page_id"), F.col("lsn")).alias("sound"))


@query(f"SELECT page_id, lower(hex({_LE('page_id', 6)}||{_LE('lsn', 6)})) AS nonce FROM images", IMAGES)
def gcm_nonce(spark, sf):
    return K.page_images(spark, sf).select("page_id", F.lower(F.hex(S.gcm_nonce(F.col("page_id"), F.col("lsn")))).alias("nonce"))


# ---- more of the same data


@query("SELECT p_partkey AS page_id FROM part WHERE p_partkey>=50 AND (p_partkey*4096)%33554432+4096>300000")
def unallocated_pages(spark, sf):
    """Pages beyond the last given out that their segment does not hold whole."""
    pages = K.page_images(spark, sf).select("page_id")
    held = pages.select(S.page_location(F.col("page_id"), 4096)["segment"].alias("segment")).distinct().withColumn("bytes", F.lit(300000))
    return integrity.unallocated(pages, 50, held, 4096)


@query("SELECT key, page_id, CASE WHEN n IS NULL THEN 'continue' WHEN n THEN 'tombstone' ELSE 'present' END AS decision FROM (SELECT key, page_id, max_by(tomb, seq) FILTER (tomb OR exp=0 OR exp>" + str(NOW) + ") AS n FROM pages GROUP BY 1, 2)", LOG)
def kv_decide_exists(spark, sf):
    return fold.exists_decisions(K.ev_pages(spark, sf), NOW)


@query("SELECT key, key||' = '||value AS line FROM visible", LOG)
def scan_text(spark, sf):
    return reads.scan_text(fold.visible(K.ev_log(spark, sf), NOW).select("key", F.encode("key", "UTF-8").alias("k"), F.encode("value", "UTF-8").alias("v")).select(F.col("k").alias("key"), F.col("v").alias("value"))).withColumn("key", F.decode("key", "UTF-8"))


@query("SELECT s_suppkey AS ord, CAST(s_suppkey*13%50 AS BIGINT) AS since_lsn FROM (SELECT *, max(s_suppkey*13%50) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM supplier) WHERE top>=s_suppkey*13%50")
def epochs_out_of_order(spark, sf):
    k = F.col("s_suppkey")
    rows = K.table(spark, sf, "supplier").select(k.alias("ord"), (k * 13 % 50).alias("since_lsn"))
    return integrity.valid_epochs(rows).select("ord", "since_lsn")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS kid, max_by(s_name, s_suppkey) AS wrapped FROM supplier GROUP BY 1")
def keyring_last(spark, sf):
    rows = K.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_nationkey").cast("string").alias("kid"), F.col("s_name").alias("wrapped"))
    return integrity.last_keys(rows)


@query("SELECT p_partkey, octet_length(encode(p_name)) AS n, lower(hex(p_name)) AS back, true AS same FROM part")
def base64_decode(spark, sf):
    p = K.table(spark, sf, "part")
    back = S.base64_bytes(F.concat(F.lit(" "), F.base64(F.encode("p_name", "UTF-8")), F.lit(" ")))
    return p.select("p_partkey", F.octet_length(back).cast("long").alias("n"), F.lower(F.hex(back)).alias("back"), (F.decode(back, "UTF-8") == F.col("p_name")).alias("same"))


@query("SELECT p_partkey, left(regexp_replace(lower(hex(p_name)), '(..)', '\\1 ', 'g'), least(47, 3*octet_length(encode(p_name))::INTEGER-1)) AS line FROM part WHERE p_name<>''")
def hex_dump(spark, sf):
    """The first line of each value's dump."""
    return K.table(spark, sf, "part").where("p_name <> ''").select("p_partkey", F.get(S.hex_lines(F.encode("p_name", "UTF-8")), 0).alias("line"))


@query("SELECT p_partkey, lower(trim(t)) IN ('1','true','yes','on') AS v FROM (SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN ' TRUE' WHEN 1 THEN '0' WHEN 2 THEN 'On ' WHEN 3 THEN 'yes' ELSE p_name END AS t FROM part)")
def env_bool(spark, sf):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, " TRUE").when(k == 1, "0").when(k == 2, "On ").when(k == 3, "yes").otherwise(F.col("p_name"))
    return K.table(spark, sf, "part").select("p_partkey", S.env_bool(text).alias("v"))


@query("SELECT hash_hex, any_value(bytes) AS bytes FROM objects GROUP BY 1", OBJECTS)
def object_sizes(spark, sf):
    d = K.table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("content"))
    store = d.select(F.sha2("content", 256).alias("hash_hex"), "content").dropDuplicates(["hash_hex"])
    return snapshots.sizes(store, K.manifest_objects(spark, sf).select("hash_hex").distinct())


@query("SELECT count(*) AS buckets_scanned, count(*) FILTER (pages_written>0) AS buckets_compacted, sum(pages_written)::BIGINT AS pages_written_sum, (SELECT count(*) FROM orphans) AS overflow_pages_freed FROM report WHERE bucket IN (SELECT bucket FROM heads WHERE head_pid IS NOT NULL ORDER BY bucket LIMIT 5)", LOG, REPORT)
def auto_maint_summary(spark, sf):
    told = compaction.auto_maintenance(K.ev_pages(spark, sf), K.heads(spark, sf), 5, NOW, K.PAGE_RECORDS)
    return compaction.auto_summary(told, _orphans(spark, sf))


@query("SELECT count(DISTINCT page_id) AS chain_len FROM pages WHERE bucket=5", LOG)
def chain_length(spark, sf):
    return stats.chain_length(K.ev_pages(spark, sf), 5)


@query("SELECT event_type, count(*) AS ops, (max(s)-min(s))::DOUBLE AS seconds, CASE WHEN max(s)=min(s) THEN 0 ELSE count(*)/(max(s)-min(s))::DOUBLE END AS per_second FROM (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) GROUP BY 1")
def throughput(spark, sf):
    return stats.throughput(K.table(spark, sf, "events").select("event_type", S.seconds_of(F.col("ts")).alias("s")), "event_type", "s")


def _content(spark, sf):
    d = K.table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("content"), "doc_id")
    return d.select("doc_id", F.sha2("content", 256).alias("hash_hex"), "content")


@query("SELECT o.hash_hex, k.hash_hex IS NOT NULL AS found FROM (SELECT DISTINCT hash_hex FROM objects) o LEFT JOIN (SELECT DISTINCT hash_hex FROM objects WHERE page_id%3=0) k ON o.hash_hex=k.hash_hex", OBJECTS)
def object_has(spark, sf):
    return snapshots.present(_content(spark, sf).where("doc_id % 3 = 0"), K.manifest_objects(spark, sf).select("hash_hex").distinct())


@query("SELECT DISTINCT sha256(text) AS hash_hex, md5(text) AS content_md5 FROM documents")
def object_get(spark, sf):
    store = _content(spark, sf).dropDuplicates(["hash_hex"])
    return snapshots.fetched(store, K.manifest_objects(spark, sf).select("hash_hex").distinct()).select("hash_hex", F.md5("content").alias("content_md5"))


@query("SELECT DISTINCT page_id, sha256(text) AS hash_hex, octet_length(encode(text)) AS n FROM objects JOIN documents ON page_id=doc_id WHERE snapshot_id='s1'", OBJECTS)
def snap_restore_verified(spark, sf):
    """Every object is hashed again."""
    store = _content(spark, sf).dropDuplicates(["hash_hex"])
    return snapshots.restored(K.manifest_objects(spark, sf), store, "s1", verify=True).select("page_id", "hash_hex", F.octet_length("content").cast("long").alias("n"))


# ---- binary pages, files and a store on disk


def _log_pages(spark, sf):
    return paging.to_pages(K.ev_log(spark, sf), K.PAGE_SIZE)


@query("SELECT CAST(bucket AS BIGINT) AS bucket, key, CASE WHEN NOT tomb THEN value END AS value, exp AS expires_at_sec, tomb AS tombstone, seq//1000 AS block FROM log", LOG)
def page_records(spark, sf):
    """Every record of the log, packed into binary pages and read back from them in order of bucket, page and slot."""
    rows = paging.records(_log_pages(spark, sf)).withColumn("bucket", F.floor(F.col("page_id") / paging.OF_BUCKET))
    log = K.ev_log(spark, sf).select("bucket", "seq")
    place = Window.partitionBy("bucket").orderBy("page_id", "slot")
    order = Window.partitionBy("bucket").orderBy("seq")
    numbered = rows.withColumn("i", F.row_number().over(place)).join(log.withColumn("i", F.row_number().over(order)), ["bucket", "i"])
    return numbered.select(*long("bucket"), F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), "expires_at_sec", "tombstone", F.expr("seq div 1000").alias("block"))


PACKED = SQL["pack_pages"].split("SELECT bucket, CAST(page_no")[0]


@query()
def page_verify(spark, sf):
    """Pages of the log, every third with a byte changed: whether their checksums hold, and what the header says."""
    changed = F.when(F.col("page_id") % 3 == 1, F.overlay("bytes", F.lit(bytearray(b"?")), 70)).otherwise(F.col("bytes"))
    return paging.checked(_log_pages(spark, sf).withColumn("bytes", changed)).select("page_id", *long("page_type", "used_slots"), F.col("next_pid"), "lsn", "ok", F.coalesce("err", F.lit("")).alias("err"))


SQL["page_verify"] = PACKED + f"""SELECT bucket*{paging.OF_BUCKET}::BIGINT+page_no AS page_id, 2::BIGINT AS page_type, count(*) AS used_slots, CASE WHEN page_no>0 THEN bucket*{paging.OF_BUCKET}::BIGINT+page_no-1 END AS next_pid,
  max(lsn) AS lsn, (bucket*{paging.OF_BUCKET}::BIGINT+page_no)%3<>1 AS ok, CASE WHEN (bucket*{paging.OF_BUCKET}::BIGINT+page_no)%3=1 THEN 'checksum mismatch' ELSE '' END AS err
  FROM filled JOIN (SELECT bucket AS b, lsn, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS j FROM log) ON bucket=b AND i=j GROUP BY bucket, page_no"""


@query()
def page_find(spark, sf):
    """The newest record of one key on each page."""
    rows = paging.found(_log_pages(spark, sf), b"3")
    return rows.select("page_id", F.decode("value", "UTF-8").alias("value"), "expires_at_sec", "tombstone")


SQL["page_find"] = PACKED + f"""SELECT bucket*{paging.OF_BUCKET}::BIGINT+page_no AS page_id, CASE WHEN NOT max_by(tomb, i) THEN max_by(value, i) END AS value, max_by(exp, i) AS expires_at_sec, max_by(tomb, i) AS tombstone
  FROM filled JOIN (SELECT bucket AS b, key, value, exp, tomb, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS j FROM log) ON bucket=b AND i=j WHERE key='3' GROUP BY bucket, page_no"""


@query(f"SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN octet_length(encode(text))<={K.THRESHOLD} THEN sha256(text) END AS value_sha256, CASE WHEN octet_length(encode(text))>{K.THRESHOLD} THEN octet_length(encode(text)) END AS total_len, CASE WHEN octet_length(encode(text))>{K.THRESHOLD} THEN doc_id END AS chain_id FROM documents")
def page_placeholders(spark, sf):
    """Documents as records of binary pages, the larger ones as placeholders, read back."""
    rows = overflow.placed(K.doc_values(spark, sf), K.THRESHOLD).withColumn("big", F.col("placement") == "overflow")
    key = F.col("chain_id").cast("string")
    log = rows.select(S.bucket_of(key, K.BUCKETS).alias("bucket"), key.alias("key"), F.when(~F.col("big"), F.col("value")).alias("value"), F.lit(0).cast("long").alias("expires_at_sec"), F.lit(False).alias("tombstone"), F.col("chain_id").alias("seq"), F.col("chain_id").alias("lsn"), F.when(F.col("big"), F.col("chain_id")).alias("chain_id"), F.col("value_len").alias("total_len"))
    back = paging.records(paging.to_pages(log, K.PAGE_SIZE))
    return back.select(F.decode("key", "UTF-8").alias("key"), F.sha2("value", 256).alias("value_sha256"), F.col("ovf.total_len").alias("total_len"), F.col("ovf.chain_id").alias("chain_id"))


@query("SELECT stream_id, rec_type::BIGINT AS rec_type, lsn, page_id, payload FROM (SELECT '0000000000000007' AS stream_id, rec_type, lsn, page_id, payload FROM frames)", FRAMES)
def wal_files(spark, sf):
    """Frames written as change-log files, one a task, and read back."""
    wal.register(spark)
    folder = K.scratch(spark, "wal")
    K.frames(spark, sf).select("rec_type", "lsn", "page_id", F.encode("payload", "UTF-8").alias("payload")).write.format("kvwal").mode("append").option("stream_id", "7").save(folder)
    return spark.read.format("kvwal").load(folder).select("stream_id", *long("rec_type"), "lsn", "page_id", F.decode("payload", "UTF-8").alias("payload"))


def _store(spark, sf, name, **options):
    """A store with the customers' operations as one batch."""
    s = Store.create(spark, K.scratch(spark, name), config=Config(buckets=K.BUCKETS, **options))
    s.batch(_ops(spark, sf).withColumn("key", F.encode("key", "UTF-8")).withColumn("value", F.encode("value", "UTF-8")))
    return s


def _pairs(rows):
    return rows.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("SELECT key, value FROM last WHERE NOT tomb", OPS)
def store_scan(spark, sf):
    """A batch, compacted twice, the second time with its tombstones forgotten."""
    s = _store(spark, sf, "store")
    s.compact(NOW)
    s.compact(NOW, forget=s.last()[1])
    return _pairs(s.scan(NOW))


@query("SELECT key, value FROM last WHERE NOT tomb AND key<>'1' UNION ALL SELECT 'late', 'row'", OPS)
def store_replica(spark, sf):
    """A replica that hears of a delete and a put across compactions of its source."""
    s, other = _store(spark, sf, "source"), Store.create(spark, K.scratch(spark, "replica"), 8)
    other.apply(s.ship(0))
    s.delete(b"1", NOW)
    s.compact(NOW)
    other.apply(s.ship(other.last()[1]))
    s.put(b"late", b"row")
    s.compact(NOW)
    other.apply(s.ship(other.last()[1]))
    return _pairs(other.scan(NOW))


@query("SELECT key, value FROM last WHERE NOT tomb", OPS)
def store_restored(spark, sf):
    """What a snapshot pinned, restored elsewhere with all counts checked, after the store has gone on."""
    s = _store(spark, sf, "store", zstd=True, overflow_above=10)
    snap = s.snapshot("before")
    s.delete(b"1", NOW)
    s.compact(NOW)
    return _pairs(s.restore(snap, K.scratch(spark, "restored"), verify=True).scan(NOW))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, octet_length(encode(text)) AS n, sha256(text) AS hash_hex FROM documents")
def store_large_values(spark, sf):
    """Documents as values, the larger ones in compressed chunks beside the log, read after a sweep."""
    s = Store.create(spark, K.scratch(spark, "large"), config=Config(buckets=K.BUCKETS, page_size=K.PAGE_SIZE, overflow_above=K.THRESHOLD, zstd=True))
    d = K.table(spark, sf, "documents")
    s.batch(d.select(F.col("doc_id").alias("ord"), F.lit("put").alias("op"), F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("key"), F.encode("text", "UTF-8").alias("value"), F.lit(0).cast("long").alias("expires_at_sec")))
    s.sweep()
    return s.scan(NOW).select(F.decode("key", "UTF-8").alias("key"), F.octet_length("value").cast("long").alias("n"), F.sha2("value", 256).alias("hash_hex"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
