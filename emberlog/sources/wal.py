"""Python data source for the binary change log: `spark.read.format("kvwal").load(folder_or_file)`, batch and streaming.

A file begins with a 16-byte header (`P2WAL001` and the stream id as a little-endian 64-bit integer). Frames follow:
type u8, flags u8, reserved u16, lsn u64, page id u64, payload length u32, CRC32C u32 over all of the frame but the
field itself. All integers are little-endian. A frame cut short at the end of a file ends it cleanly; a wrong checksum
is an error. A repeated header is skipped right after a truncation frame and an error elsewhere.

One input partition a file. A stream's offset holds, for each file, how many of its bytes were there; a batch is the frames
that end within the bytes that came since, read on executors. So frames that are appended to a file and files whatever
their names are delivered once, and a frame cut short comes with the batch that completes it. A file that has become
shorter was begun anew and is read from its start. To find where frames begin, a batch walks a file from its start, without
working earlier checksums out again; files of a rotated log have some megabytes. Written (`df.write.format("kvwal").mode("append").save(folder)`, option
`stream_id`), every task makes one file. Files are opened through pyarrow.fs, so any path it knows works.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from emberlog.functions.scalars import crc32c_bytes

# Fixed values of the format.
MAGIC, HEADER = b"P2WAL001", 16
FRAME = struct.Struct("<BBHQQII")
BEGIN, IMAGE, DELTA, COMMIT, TRUNCATE, HEADS = 1, 2, 3, 4, 5, 6
SCHEMA = "stream_id string, pos long, rec_type int, flags int, lsn long, page_id long, len int, crc32c long, payload binary"


def header(stream_id: int) -> bytes:
    return MAGIC + struct.pack("<Q", stream_id)


def encode_frame(rec_type: int, lsn: int, page_id: int, payload: bytes, flags: int = 0) -> bytes:
    bare = struct.pack("<BBHQQI", rec_type, flags, 0, lsn, page_id, len(payload))
    return bare + struct.pack("<I", crc32c_bytes(bare + payload)) + payload


def decode(data: bytes, after: int = 0) -> Iterator[tuple]:
    """Frames of one file's bytes that end beyond `after`; the checksums of earlier ones are not worked out again."""
    if len(data) < HEADER:
        return
    if data[:8] != MAGIC:
        raise ValueError("not a change log")
    stream_id = format(struct.unpack_from("<Q", data, 8)[0], "016x")
    at, after_truncate = HEADER, False
    while at < len(data):
        if data[at : at + 8] == MAGIC and after_truncate and at + HEADER <= len(data):
            at, after_truncate = at + HEADER, False
            continue
        if at + FRAME.size > len(data):
            return
        rec_type, flags, _, lsn, page_id, n, crc = FRAME.unpack_from(data, at)
        end = at + FRAME.size + n
        if end > len(data):
            if data[at : at + 8] == MAGIC:
                raise ValueError(f"checksum of the frame at {at}")
            return
        payload = data[at + FRAME.size : end]
        if end > after and crc32c_bytes(data[at : at + FRAME.size - 4] + payload) != crc:
            raise ValueError(f"checksum of the frame at {at}")
        if end > after:
            yield stream_id, at, rec_type, flags, lsn, page_id if page_id < 2**63 else None, n, crc, payload
        after_truncate = rec_type == TRUNCATE
        at = end


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """Files and their sizes."""
    from pyarrow import fs

    store, base = opened(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return {path: info.size}
    root = path.rstrip("/")
    return {f"{root}/{x.base_name}": x.size for x in store.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File and x.extension in ("log", "wal")}


def read_file(path: str, size: int) -> bytes:
    store, base = opened(path)
    with store.open_input_file(base) as f:
        return f.read_at(size, 0)


@dataclass
class Span(InputPartition):
    """Frames of a file that end after `start` and not after `stop`."""

    path: str
    start: int
    stop: int


class WalReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Span]:
        return [Span(p, 0, n) for p, n in sorted(listed(self.path).items())]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from decode(read_file(partition.path, partition.stop), partition.start)


class WalStreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return listed(self.path)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = [(p, start.get(p, 0), n) for p, n in sorted(end.items())]
        return [Span(p, a if a <= n else 0, n) for p, a, n in spans if a != n] or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.path:
            yield from decode(read_file(partition.path, partition.stop), partition.start)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WalWriter(DataSourceWriter):
    """Rows (rec_type, lsn, page_id, payload, and perhaps flags) as change-log files, one a task, in the order they come.

    Files get their names when the job commits; a task that runs twice leaves nothing but a file that no reader lists.
    """

    def __init__(self, path: str, stream_id: int):
        self.path, self.stream_id = path.rstrip("/"), stream_id

    def write(self, rows: Iterator) -> Written:
        import uuid

        name = f"{self.path}/wal-{uuid.uuid4().hex}"
        store, base = opened(name)
        store.create_dir(base.rsplit("/", 1)[0], recursive=True)
        n = 0
        with store.open_output_stream(f"{base}.part") as out:
            out.write(header(self.stream_id))
            for r in rows:
                flags = r.flags if "flags" in r else 0
                out.write(encode_frame(r.rec_type, r.lsn, r.page_id if r.page_id is not None else 2**64 - 1, bytes(r.payload or b""), flags or 0))
                n += 1
        if not n:
            store.delete_file(f"{base}.part")
        return Written([name] if n else [])

    def commit(self, messages: list) -> None:
        for m in messages:
            for name in m.names if m else ():
                store, base = opened(name)
                store.move(f"{base}.part", f"{base}.log")

    def abort(self, messages: list) -> None:
        for m in messages:
            for name in m.names if m else ():
                store, base = opened(name)
                store.delete_file(f"{base}.part")


class WalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalReader:
        return WalReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WalWriter:
        return WalWriter(self.options["path"], int(self.options.get("stream_id", "1")))

    def streamReader(self, schema) -> WalStreamReader:
        return WalStreamReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(WalSource)
