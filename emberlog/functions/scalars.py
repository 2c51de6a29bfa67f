"""Scalar functions of the data model; hashes that Spark lacks are Arrow-batched."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_HEADER, PAGE_TRAILER, SEGMENT_BYTES = 64, 16, 32 << 20


def expired(expires: Column, now: int) -> Column:
    """Zero never expires; a record is expired at its very second."""
    return (expires != 0) & (F.lit(now) >= expires)


def bucket_of(key: Column, buckets: int) -> Column:
    """Logical bucket of a key, the same in any engine with MD5. Physical layout uses Spark's own hash partitioning."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def seconds_of(ts: Column) -> Column:
    """Unix seconds of a timestamp without zone, whatever the session's zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def decode_value(arg: Column) -> Column:
    """`hex:` arguments as bytes (an odd number of digits or a non-digit is an error), others as UTF-8."""
    digits = F.substring(arg, 5, 1 << 30)
    good = digits.rlike("^([0-9a-fA-F]{2})*$")
    bad = F.raise_error(F.concat(F.lit("not an even number of hex digits: "), arg)).cast("binary")
    return F.when(arg.startswith("hex:"), F.when(good, F.unhex(digits)).otherwise(bad)).otherwise(F.encode(arg, "UTF-8"))


def env_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "on")


def page_size_valid(size: Column) -> Column:
    return (F.bit_count(size) == 1) & size.between(4096, 1 << 20)


def page_location(page_id: Column, page_size: int) -> Column:
    """Segment number and byte offset of a page."""
    at = page_id * F.lit(page_size)
    return F.struct(F.floor(at / F.lit(SEGMENT_BYTES)).cast("long").alias("segment"), F.pmod(at, F.lit(SEGMENT_BYTES)).cast("long").alias("offset"))


def ratio(a: Column, b: Column) -> Column:
    """Zero where the denominator is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def display_text(value: Column) -> Column:
    return F.when(F.is_valid_utf8(value), F.decode(value, "UTF-8")).otherwise(F.concat(F.lit("(binary "), F.octet_length(value).cast("string"), F.lit(" B)")))


#: Bytes that one look-up of the checksum takes together: a table of a row for each place, 4 MB, built when first needed.
CRC_BLOCK = 4096


@functools.cache
def _crc32c_tables() -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of a byte at the end; of every byte at every distance from the end, flat; and where each place's row begins."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = one >> 1 ^ np.where(one & 1, np.uint32(0x82F63B78), np.uint32(0))
    rows = np.empty((CRC_BLOCK, 256), np.uint32)
    rows[-1] = one
    for k in range(CRC_BLOCK - 2, -1, -1):
        rows[k] = rows[k + 1] >> 8 ^ one[rows[k + 1] & 255]
    return one.tolist(), rows.ravel(), np.arange(CRC_BLOCK, dtype=np.int32) * 256


def crc32c_bytes(data: bytes) -> int:
    """Castagnoli CRC of one value. It is linear, so a block's is the exclusive or of what each byte adds at its place."""
    table, flat, rows = _crc32c_tables()
    c, n = 0xFFFFFFFF, len(data)
    at = n % CRC_BLOCK if n >= 64 else n
    if at < 64:  # the odd bytes in front, one by one
        for b in data[:at]:
            c = table[(c ^ b) & 255] ^ c >> 8
        ends = [at]
    else:
        ends = [0, at]
    ends += range(ends[-1] + CRC_BLOCK, n + 1, CRC_BLOCK)
    bytes_ = np.frombuffer(data, np.uint8)
    for start, stop in itertools.pairwise(ends):
        block = bytes_[start:stop].copy()
        block[:4] ^= np.frombuffer(c.to_bytes(4, "little"), np.uint8)  # the state goes into the first four bytes
        c = int(np.bitwise_xor.reduce(flat[rows[CRC_BLOCK - len(block) :] + block]))
    return c ^ 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else crc32c_bytes(bytes(b)) for b in data], dtype="Int64")


@F.pandas_udf(T.StringType())
def xxh64_hex(data: pd.Series) -> pd.Series:
    """XXH64 with seed 0, which Spark's xxhash64 (seed 42) is not."""
    import xxhash

    return data.map(lambda b: xxhash.xxh64_hexdigest(b), na_action="ignore")


def bucket_of_xxh64(key: Column, buckets: int) -> Column:
    """Bucket of a binary key as the binary page files have it: XXH64 with seed 0, unsigned, modulo the number of buckets."""
    return F.pmod(F.conv(xxh64_hex(key), 16, 10).cast("decimal(20,0)"), F.lit(buckets)).cast("int")


def hmac_sha256(secret: bytes):
    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series) -> pd.Series:
        import hashlib
        import hmac

        return data.map(lambda b: hmac.new(secret, b, hashlib.sha256).digest(), na_action="ignore")

    return run


@F.pandas_udf(T.BinaryType())
def zstd_compress(data: pd.Series) -> pd.Series:
    import zstandard

    c = zstandard.ZstdCompressor()
    return data.map(c.compress, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def zstd_decompress(data: pd.Series) -> pd.Series:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return data.map(lambda b: d.decompress(b, max_output_size=1 << 30), na_action="ignore")


def gcm_tag(page: Column, key: Column, nonce: Column, aad: Column) -> Column:
    """The 16-byte AES-GCM tag of a page; its ciphertext is dropped."""
    sealed = F.aes_encrypt(page, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)
    return F.substring(sealed, F.octet_length(sealed) - 15, 16)


def prefix_end(prefix: bytes) -> bytes | None:
    """Smallest byte string above all that begin with prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def prefix_predicate(key: Column, prefix: bytes) -> Column:
    """Keys that begin with prefix, as a range that Parquet statistics can prune by."""
    end = prefix_end(prefix)
    at_least = key >= F.lit(bytearray(prefix))
    return at_least if end is None else at_least & (key < F.lit(bytearray(end)))


def wrapped_key(key: Column, kek: Column, nonce: Column) -> Column:
    """A data key sealed under a key-encryption key (AES-GCM; nonce, ciphertext and tag in one value)."""
    return F.aes_encrypt(key, kek, F.lit("GCM"), F.lit("DEFAULT"), nonce)


def unwrapped_key(sealed: Column, kek: Column) -> Column:
    """The data key; a wrong key or a changed value is an error."""
    return F.aes_decrypt(sealed, kek, F.lit("GCM"), F.lit("DEFAULT"))


def hex_lines(value: Column, width: int = 16) -> Column:
    """A hex dump: an array of lines of `width` bytes, each byte followed by a space but the last."""
    n = F.ceil(F.octet_length(value) / F.lit(width)).cast("int")
    line = lambda i: F.trim(F.regexp_replace(F.lower(F.hex(F.substring(value, i * width + 1, F.lit(width)))), "(..)", "$1 "))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), line)).otherwise(F.array().cast("array<string>"))


def base64_bytes(text: Column) -> Column:
    """Standard base64, white space around it ignored; anything else is an error."""
    return F.unbase64(F.trim(text))


def secret_of(hex_text: str | None = None, base64_text: str | None = None, raw: str | None = None) -> bytes:
    """A shared secret: hex before base64 before plain text; under 16 bytes is an error."""
    import base64

    if hex_text is not None:
        found = bytes.fromhex(hex_text.strip())
    elif base64_text is not None:
        found = base64.b64decode(base64_text.strip(), validate=True)
    elif raw is not None:
        found = raw.strip().encode()
    else:
        raise ValueError("no secret given")
    if len(found) < 16:
        raise ValueError("a secret needs 16 bytes or more")
    return found


def little_endian_bytes(value: Column, n: int) -> Column:
    """The low n bytes of an integer, the least first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(n))))


# Fixed values of the framing and of page tags.
FRAME_MAGIC, TAG_MAGIC = b"P2PSK001", b"P2AEAD01"


def framed(seq: Column, payload: Column) -> Column:
    """The bytes that a frame's MAC covers: magic, seq (8 bytes), length (4 bytes), payload."""
    return F.concat(F.lit(bytearray(FRAME_MAGIC)), little_endian_bytes(seq, 8), little_endian_bytes(F.octet_length(payload), 4), payload)


def gcm_nonce(page_id: Column, lsn: Column) -> Column:
    """Twelve bytes: the low six of the page id and of the LSN, the least first."""
    return F.concat(little_endian_bytes(page_id, 6), little_endian_bytes(lsn, 6))


def bare_page(page: Column) -> Column:
    """The page with its trailer zeroed, which checksums and tags cover."""
    return F.concat(F.substring(page, F.lit(1), F.octet_length(page) - PAGE_TRAILER), F.lit(bytearray(PAGE_TRAILER)))


def page_tag(page: Column, key: Column, page_id: Column, lsn: Column) -> Column:
    """The tag of a page: over the page with a zeroed trailer, bound to its first 16 bytes."""
    bare = bare_page(page)
    return gcm_tag(bare, key, gcm_nonce(page_id, lsn), F.concat(F.lit(bytearray(TAG_MAGIC)), F.substring(bare, 1, 16)))


def page_tag_ok(page: Column, key: Column, page_id: Column, lsn: Column) -> Column:
    """Whether the trailer holds the tag; a trailer of zeros never does."""
    trailer = F.substring(page, F.octet_length(page) - PAGE_TRAILER + 1, F.lit(PAGE_TRAILER))
    return (trailer != F.lit(bytearray(PAGE_TRAILER))) & (trailer == page_tag(page, key, page_id, lsn))
