"""Python data sources for binary page files and the bucket directory.

`kvpages` gives one row a page (its header, whether its checksum holds, its bytes); `kvrecords` one row a record of the
key-value pages, in slot order, with large values as (total_len, chain_id) instead of a placeholder; `kvdirectory` the
head page of each bucket. Options: `path` (a file, or a folder of *.p2seg segments; dir-000 for the directory), `page_size`;
for records also `corrupt` (`fail`, or `skip` pages whose checksum does not hold) and `strict` (a checksum of zero fails,
too). A segment that ends within a page gives a row with the error `short read` in `kvpages` and counts as corrupt. Segments are read in ranges of whole pages, one input partition each, so one file does not bound the parallelism.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from emberlog.functions.scalars import PAGE_HEADER as HEADER
from emberlog.functions.scalars import PAGE_TRAILER as TRAILER
from emberlog.functions.scalars import crc32c_bytes

# Fixed values of the format.
PAGE_MAGIC, PAGE_VERSION, KV, OVERFLOW = b"P2PG", 3, 2, 3
DIRECTORY_MAGIC, DIRECTORY_VERSION = b"P2DIR02\0", 2
SLOT, NONE = 6, 2**64 - 1
CHAIN_TAG = b"\x01\x10"

PREFIX = struct.Struct("<4sHHQ")
KV_HEADER = struct.Struct("<IIIIQQH")
OVERFLOW_HEADER = struct.Struct("<IIQQH")
RECORD = struct.Struct("<HIIB")

PAGES = "page_id long, page_type int, lsn long, next_pid long, codec_id int, used_slots int, chunk_len int, ok boolean, err string, zero_crc boolean, bytes_len long, bytes binary"
RECORDS = "page_id long, slot int, lsn long, key binary, value binary, expires_at_sec long, tombstone boolean, ovf struct<total_len: bigint, chain_id: bigint>"
RANGE_BYTES = 8 << 20


def signed(n: int) -> int | None:
    """Null for the mark of no page and what a signed 64-bit integer cannot hold."""
    return n if n < 2**63 else None


def checksum(page: bytes) -> int:
    return crc32c_bytes(page[:-TRAILER] + bytes(TRAILER))


def sealed(page: bytearray) -> bytes:
    """The page with its checksum in the trailer."""
    page[-TRAILER:] = bytes(TRAILER)
    page[-TRAILER : -TRAILER + 4] = struct.pack("<I", checksum(bytes(page)))
    return bytes(page)


def kv_page(page_id: int, records: list[tuple[bytes, bytes, int, bool]], page_size: int, lsn: int = 0, next_pid: int = NONE) -> bytes:
    """A key-value page of records (key, value, expires_at_sec, tombstone); too many are an error."""
    page, at, slots = bytearray(page_size), HEADER, []
    for key, value, expires, tombstone in records:
        slots.append(at)
        data = RECORD.pack(len(key), len(value), expires, int(tombstone)) + key + value
        page[at : at + len(data)] = data
        at += len(data)
    table = page_size - TRAILER - SLOT * len(slots)
    if at > table or len(page) != page_size:
        raise ValueError("records do not fit the page")
    for i, off in enumerate(slots):
        page[table + SLOT * i : table + SLOT * (i + 1)] = struct.pack("<IBB", off, fingerprint(records[i][0]), 0)
    PREFIX.pack_into(page, 0, PAGE_MAGIC, PAGE_VERSION, KV, page_id)
    KV_HEADER.pack_into(page, 16, at, len(slots), len(slots), 0, next_pid, lsn, 0)
    return sealed(page)


def overflow_page(page_id: int, chunk: bytes, page_size: int, lsn: int = 0, next_pid: int = NONE, codec: int = 0) -> bytes:
    if len(chunk) > page_size - HEADER - TRAILER:
        raise ValueError("chunk does not fit the page")
    page = bytearray(page_size)
    PREFIX.pack_into(page, 0, PAGE_MAGIC, PAGE_VERSION, OVERFLOW, page_id)
    OVERFLOW_HEADER.pack_into(page, 16, len(chunk), 0, next_pid, lsn, codec)
    page[HEADER : HEADER + len(chunk)] = chunk
    return sealed(page)


def page_row(page: bytes, at: int) -> tuple:
    """One page's row; at is its number by place, for pages without a readable header."""
    magic, version, kind, page_id = PREFIX.unpack_from(page)
    stored = struct.unpack_from("<I", page, len(page) - TRAILER)[0]
    zero = stored == 0
    err = None if zero or stored == checksum(page) else "checksum mismatch"
    if magic != PAGE_MAGIC or version != PAGE_VERSION:
        return at, None, None, None, None, None, None, err is None, err, zero, len(page), page
    lsn = nxt = codec = used = chunk = None
    if kind == KV:
        _, _, used, _, nxt, lsn, codec = KV_HEADER.unpack_from(page, 16)
    elif kind == OVERFLOW:
        chunk, _, nxt, lsn, codec = OVERFLOW_HEADER.unpack_from(page, 16)
    return page_id, kind, lsn, signed(nxt) if nxt is not None else None, codec, used, chunk, err is None, err, zero, len(page), page


def short_row(page: bytes, at: int) -> tuple:
    """The row of a page that the segment ends in."""
    return at, None, None, None, None, None, None, False, "short read", False, len(page), page


def record_rows(page: bytes) -> Iterator[tuple]:
    """Records of a key-value page, older first (the order of slots)."""
    magic, _, kind, page_id = PREFIX.unpack_from(page)
    if magic != PAGE_MAGIC or kind != KV:
        return
    start, capacity, used, _, _, lsn, _ = KV_HEADER.unpack_from(page, 16)
    table = len(page) - TRAILER - SLOT * capacity
    for slot in range(used):
        off = struct.unpack_from("<I", page, table + SLOT * slot)[0]
        if off < HEADER or off + RECORD.size > min(start, table):
            continue
        klen, vlen, expires, flags = RECORD.unpack_from(page, off)
        key_at = off + RECORD.size
        end = key_at + klen + vlen
        if end > min(start, table):
            raise ValueError(f"record beyond the data of page {page_id}")
        key, value = page[key_at : key_at + klen], page[key_at + klen : end]
        chain = struct.unpack("<QQ", value[2:18]) if len(value) == 18 and value[:2] == CHAIN_TAG else None
        yield page_id, slot, lsn, key, None if chain or flags & 1 else value, expires, bool(flags & 1), chain


def placeholder(total_len: int, chain_id: int) -> bytes:
    """What stands in a record for a large value."""
    return CHAIN_TAG + struct.pack("<QQ", total_len, chain_id)


def fingerprint(key: bytes) -> int:
    """The byte that a slot holds of its key: the low one of XXH64 with seed 0."""
    import xxhash

    return xxhash.xxh64_intdigest(key) & 255


def find(page: bytes, key: bytes) -> tuple | None:
    """The newest record of a key on a page, as record_rows() gives it: slots are gone through from the last, by fingerprint first."""
    magic, _, kind, page_id = PREFIX.unpack_from(page)
    if magic != PAGE_MAGIC or kind != KV:
        return None
    start, capacity, used, _, _, lsn, _ = KV_HEADER.unpack_from(page, 16)
    table, want = len(page) - TRAILER - SLOT * capacity, fingerprint(key)
    for slot in range(used - 1, -1, -1):
        off, own = struct.unpack_from("<IB", page, table + SLOT * slot)
        if own != want or off < HEADER or off + RECORD.size > min(start, table):
            continue
        klen, vlen, expires, flags = RECORD.unpack_from(page, off)
        at = off + RECORD.size
        if at + klen + vlen <= min(start, table) and page[at : at + klen] == key:
            value = page[at + klen : at + klen + vlen]
            chain = struct.unpack("<QQ", value[2:18]) if len(value) == 18 and value[:2] == CHAIN_TAG else None
            return page_id, slot, lsn, key, None if chain or flags & 1 else value, expires, bool(flags & 1), chain
    return None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def ranges(path: str, page_size: int) -> list[Range]:
    from pyarrow import fs

    store, base = opened(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        files = [(path, info.size)]
    else:
        files = sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in store.get_file_info(fs.FileSelector(base)) if x.extension == "p2seg")
    step = max(1, RANGE_BYTES // page_size) * page_size
    return [Range(f, a, min(size, a + step)) for f, size in files for a in range(0, size, step)]


class PagesReader(DataSourceReader):
    def __init__(self, options: dict, records: bool):
        self.path, self.size, self.records = options["path"], int(options.get("page_size", 65536)), records
        self.skip, self.strict = options.get("corrupt", "fail") == "skip", options.get("strict", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        store, base = opened(partition.path)
        with store.open_input_file(base) as f:
            for at in range(partition.start, partition.stop, self.size):
                page = f.read_at(min(self.size, partition.stop - at), at)
                row = page_row(page, at // self.size) if len(page) == self.size else short_row(page, at // self.size)
                if not self.records:
                    yield row
                elif row[7] and not (self.strict and row[9]):
                    yield from record_rows(page)
                elif not self.skip:
                    raise ValueError(f"page {row[0]} at {at} of {partition.path}: {row[8] or 'checksum of zero'}")


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvpages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options, False)


class RecordsSource(PagesSource):
    @classmethod
    def name(cls) -> str:
        return "kvrecords"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options, True)


class DirectoryReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        store, base = opened(self.path)
        with store.open_input_stream(base) as f:
            data = f.read()
        version, buckets, crc = struct.unpack_from("<III", data, 8)
        heads = data[20 : 20 + 8 * buckets]
        if data[:8] != DIRECTORY_MAGIC or version != DIRECTORY_VERSION or len(heads) != 8 * buckets:
            raise ValueError("not a bucket directory")
        if crc and crc != crc32c_bytes(data[8:16] + heads):
            raise ValueError("checksum of the directory")
        yield from ((i, signed(h)) for i, (h,) in enumerate(struct.iter_unpack("<Q", heads)))


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvdirectory"

    def schema(self) -> str:
        return "bucket int, head_pid long"

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options["path"])


def directory_bytes(heads: list[int | None]) -> bytes:
    body = b"".join(struct.pack("<Q", NONE if h is None else h) for h in heads)
    head = struct.pack("<II", DIRECTORY_VERSION, len(heads))
    return DIRECTORY_MAGIC + head + struct.pack("<I", crc32c_bytes(head + body)) + body


def register(spark) -> None:
    for source in (PagesSource, RecordsSource, DirectorySource):
        spark.dataSource.register(source)
