"""Token ids of whole documents in Arrow files of equal-length sequences.

Documents are dealt by ranges of doc_id; each range becomes one shard: an Arrow IPC file of record batches with the
columns `ids` (fixed-size list of `length` unsigned integers) and `mask` (fixed-size list of booleans, false on the
padding of the shard's last sequence). Lists of a fixed size have no offsets, so sequence k of a memory-mapped shard
is found by arithmetic and read without a copy. Beside it lies an index file (doc_id, start in the shard, n_tokens)
and in the file's schema metadata the shard's number and count of ids. A document's place in the whole output is the
ids of the shards before (summed over the index's metadata) and its start.

Files are written under a temporary name and renamed, so a task that runs again after a lost executor replaces its own
file. Where the tokenizer's file says that it drops white space and joins nothing across it, words between ASCII white
space are encoded once and kept, which gives the library's ids for the whole text; any other tokenizer gets whole texts.
Ids have two bytes, or four where the vocabulary needs them. The number of shards follows from the counted bytes of texts.

Null or empty text: only the end id. A very long text goes whole, over as many sequences as it fills. Rows of one doc_id, and
repeated ones, follow text order and have an index entry each; rows without doc_id come first. Extra columns are ignored,
whatever their names. An empty table gives no shard. Paths are those pyarrow.fs can open (file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import common as C

LENGTH, END = 2048, 1
#: Sequences of one record batch, and words that are kept with their ids.
BATCH_SEQUENCES, KEPT_WORDS = 256, 400_000
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256.
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SAME} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _SAME)}
#: Bytes of the texts of one shard, about; and of the smallest, where there are fewer shards than cores.
SHARD_BYTES, LEAST_BYTES = 64_000_000, 4_000_000
# How a tokenizer file says that it composes, lower-cases and drops white space, so that words stand alone.
ALONE = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def words_stand_alone(tokenizer: dict) -> bool:
    """Whether a tokenizer (its file's JSON) is of the kind whose words can be encoded one by one; others get whole texts."""
    parts = {"normalizer": "normalizers", "pre_tokenizer": "pretokenizers"}
    spaced = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokenizer["added_tokens"])
    return not spaced and all((tokenizer[k] or {}).get(v) == ALONE[k] for k, v in parts.items())


class WordEncoder(dict):
    """Little-endian ids of texts, of two bytes or, for vocabularies above 65,536, of four.

    Where words stand alone, each is encoded when it is first met, and ids() joins them. A plain word (Latin letters, perhaps a closing mark) is one piece to the pre-tokenizer, or a piece and its mark, in
    composed form already; so the library's model is asked for it directly. All else goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str, kept: int = KEPT_WORDS):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.alone = words_stand_alone(json.loads(self.tokenizer.to_str()))
        self.dtype = "<u2" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "<u4"
        self.code, self.kept = "H" if self.dtype == "<u2" else "I", kept
        self.stems: dict[str, bytes] = {}

    def stem(self, stem: str) -> bytes:
        found = self.stems.get(stem)
        if found is None:
            own = stem if stem.isascii() else "".join(map(BYTE_CHARS.__getitem__, stem.encode()))
            found = self.stems[stem] = array(self.code, [t.id for t in self.model.tokenize(own)]).tobytes()
        return found

    def __missing__(self, word: str) -> bytes:
        m = PLAIN.fullmatch(word)
        if m is None:
            found = array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            found = self.stem(m[1].lower()) + self.stem(m[2]) if m[2] else self.stem(m[1].lower())
        self[word] = found
        return found

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if not self.alone:
            return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if len(self) > self.kept:
            self.clear()
        if len(self.stems) > 2 * self.kept:
            self.stems = {}
        get = self.__getitem__
        return [b"".join(map(get, (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


@functools.lru_cache(maxsize=1)
def encoder_of(tokenizer_file: str) -> WordEncoder:
    """One encoder a Python worker, so that its words outlast a task."""
    return WordEncoder(tokenizer_file)


def write_tokens(docs: DataFrame, tokenizer_file: str, folder: str, length: int = LENGTH, end: int = END, shards: int | None = None) -> DataFrame:
    """Writes the shards and returns (shard, path, n_tokens, n_docs), one row each."""
    docs = C.first_with_text(docs)
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES))

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        encoder = encoder_of(tokenizer_file)
        dtype = encoder.dtype
        last = np.array([end], dtype).tobytes()
        name, part = f"{base}/shard-{shard:06d}", f".{uuid.uuid4().hex}"
        width = np.dtype(dtype).itemsize * length
        kind = pa.uint16() if dtype == "<u2" else pa.uint32()
        schema = pa.schema([pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        total = n_docs = 0
        rest = b""
        with store.open_output_stream(f"{name}.arrow{part}") as out, store.open_output_stream(f"{name}.index{part}") as at, pa.ipc.new_file(out, schema) as data, pa.ipc.new_file(at, index_schema) as index:

            def put(chunk: bytes, real: int) -> None:
                ids = np.frombuffer(chunk, dtype)
                mask = np.arange(len(ids)) < real
                data.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids, kind), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))

            for b in batches:
                ids = [x + last for x in encoder.ids(b.column(1).to_pylist())]
                counts = np.array([len(x) for x in ids], np.int64) // np.dtype(dtype).itemsize
                starts = total + np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(ids) else counts
                index.write_batch(pa.record_batch([b.column(0), pa.array(starts), pa.array(counts)], schema=index_schema))
                total, n_docs = total + int(counts.sum()), n_docs + len(ids)
                rest += b"".join(ids)
                full = len(rest) // (width * BATCH_SEQUENCES) * width * BATCH_SEQUENCES
                for k in range(0, full, width * BATCH_SEQUENCES):
                    put(rest[k : k + width * BATCH_SEQUENCES], length * BATCH_SEQUENCES)
                rest = rest[full:]
            if rest:
                real = len(rest) // np.dtype(dtype).itemsize
                put(rest + bytes(-len(rest) % width), real)
        if n_docs:
            store.move(f"{name}.arrow{part}", f"{name}.arrow")
            store.move(f"{name}.index{part}", f"{name}.index")
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([f"{folder}/shard-{shard:06d}"]), pa.array([total], pa.int64()), pa.array([n_docs], pa.int64())], names=["shard", "path", "n_tokens", "n_docs"])
        else:
            store.delete_file(f"{name}.arrow{part}")
            store.delete_file(f"{name}.index{part}")

    C.small_batches(docs.sparkSession)
    dealt = docs.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "shard long, path string, n_tokens long, n_docs long")


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, from the files.

    `shards` is what write_tokens returned, materialised: a row each, whose counts are summed up in order.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                opened = pa.memory_map if isinstance(store, fs.LocalFileSystem) else store.open_input_file
                with opened(f"{name}.arrow") as data, opened(f"{name}.index") as at:
                    file, index = pa.ipc.open_file(data), pa.ipc.open_file(at)
                    length = file.schema.field("ids").type.list_size
                    per = length * file.get_batch(0).num_rows
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        ids = []
                        for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                            pieces = []
                            while n:
                                j, o = divmod(start, per)
                                values = file.get_batch(j).column(0).flatten()
                                got = values.slice(o, min(n, per - o)).to_numpy(zero_copy_only=False)
                                pieces.append(got)
                                start, n = start + len(got), n - len(got)
                            ids.append(np.concatenate(pieces).astype("<u4").tobytes())
                        yield pa.record_batch([part.column(0), pa.array(np.asarray(part.column(1)) + base), part.column(2), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.repartition(max(1, shards.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
