"""Explicit schemas of the tables, as DDL; nothing is inferred."""

from __future__ import annotations

KV_LOG = "key BINARY NOT NULL, value BINARY, expires_at_sec BIGINT NOT NULL, tombstone BOOLEAN NOT NULL, seq BIGINT NOT NULL, lsn BIGINT, page_id BIGINT, slot INT, bucket INT"
OVF_CHUNK = "chain_id BIGINT, chunk_no INT, codec_id INT, chunk_len INT, payload BINARY"
HEADS = "bucket INT, head_pid BIGINT"
WAL_FRAME = "pos BIGINT, rec_type INT, flags INT, lsn BIGINT, page_id BIGINT, len INT, crc32c BIGINT, payload BINARY"
CDC_FRAME = "stream_id STRING, seq BIGINT, ord BIGINT, mac BINARY, payload BINARY"
PAGE_IMAGE = "page_id BIGINT, page_type INT, lsn BIGINT, next_pid BIGINT, bytes BINARY, ok BOOLEAN, err STRING"
MANIFEST = (
    "meta STRUCT<version: INT, id: STRING, parent: STRING, created_unix_ms: BIGINT, message: STRING, labels: ARRAY<STRING>, lsn: BIGINT, page_size: INT, next_page_id: BIGINT, buckets: INT>, "
    "heads ARRAY<STRUCT<bucket: INT, head_pid: BIGINT>>, objects ARRAY<STRUCT<page_id: BIGINT, hash_hex: STRING, bytes: BIGINT>>"
)
KEY_EPOCH = "since_lsn BIGINT, kid STRING"
OPS = "array<struct<op:string,key:string,value:string,expires_at_sec:bigint>>"
