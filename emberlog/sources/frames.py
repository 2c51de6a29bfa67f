"""Python data source for authenticated frames: `spark.read.format("kvframes").load(file_or_folder)`, batch and streaming.

A frame is the payload's length (4 bytes), a sequence number (8), an HMAC-SHA256 (32) over a magic, the sequence number, the
length and the payload, and the payload. Integers are little-endian. A frame cut short ends the file cleanly; a wrong MAC or
a length above the option `max_len` is an error. Options: `secret_hex`, `secret_base64` or `secret` (16 bytes or more).
Streams keep offsets in bytes, as the change log's do.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource

from emberlog.functions.scalars import FRAME_MAGIC, secret_of
from emberlog.sources.wal import WalReader, WalStreamReader, read_file

# Fixed values of the format.
HEAD = struct.Struct("<IQ32s")
SCHEMA = "pos long, seq long, payload binary"
MOST = 32 << 20


def mac_of(secret: bytes, seq: int, payload: bytes) -> bytes:
    return hmac.new(secret, FRAME_MAGIC + struct.pack("<QI", seq, len(payload)) + payload, hashlib.sha256).digest()


def encode_framed(secret: bytes, seq: int, payload: bytes) -> bytes:
    return HEAD.pack(len(payload), seq, mac_of(secret, seq, payload)) + payload


def decode_framed(data: bytes, secret: bytes, after: int = 0, max_len: int = MOST) -> Iterator[tuple]:
    """(pos, seq, payload) of the frames that end beyond `after`."""
    at = 0
    while at + HEAD.size <= len(data):
        n, seq, mac = HEAD.unpack_from(data, at)
        if n > max_len:
            raise ValueError(f"frame of {n} bytes at {at}, above {max_len}")
        end = at + HEAD.size + n
        if end > len(data):
            return
        if end > after:
            payload = data[at + HEAD.size : end]
            if not hmac.compare_digest(mac, mac_of(secret, seq, payload)):
                raise ValueError(f"MAC of the frame at {at} (seq {seq})")
            yield at, seq, payload
        at = end


class _Frames:
    def __init__(self, options: dict):
        self.path, self.max_len = options["path"], int(options.get("max_len", MOST))
        self.secret = secret_of(options.get("secret_hex"), options.get("secret_base64"), options.get("secret"))

    def read(self, partition) -> Iterator[tuple]:
        if partition.path:
            yield from decode_framed(read_file(partition.path, partition.stop), self.secret, partition.start, self.max_len)


class FramesReader(_Frames, WalReader):
    pass


class FramesStreamReader(_Frames, WalStreamReader):
    pass


class FramesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options)

    def streamReader(self, schema) -> FramesStreamReader:
        return FramesStreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(FramesSource)
