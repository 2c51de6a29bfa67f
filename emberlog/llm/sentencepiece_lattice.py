"""SentencePiece encoding and decoding over a relational lattice.

Text with its dummy space in front is cut into units at places that no piece of the vocabulary spans, so units are encoded
alone: before a run of spaces, around newlines, and between any two characters that no piece holds side by side.

1. Documents become lists of numbers of units (of one to four bytes, frequent units mostly fewer), in chunks of about CHUNK
   characters with a table of their units each, written to the shared folder once. So only units are dealt, each once a
   chunk, and never their occurrences. A table is in buckets by the hash of a unit, a row each, and a unit's number is its
   place in the bucket times the number of buckets, and the bucket.
2. The distinct units of the whole corpus go through the lattice as relations: all substrings of at most the longest
   piece's length are exploded, equi-joined to the piece table (as many rows as the vocabulary, so it is broadcast), the
   edges found are grouped by unit, and a fold with Spark's aggregate() reads the best path:
   * `viterbi` for unigram models: the path of the highest sum of scores, position by position;
   * `bpe` for BPE models, whose ids are not those of the highest sum: the state is the set of boundaries between symbols
     as bits of a long, and edges over two neighbouring symbols take the boundary between them out, best score first,
     leftmost of equals. One walk over the sorted edges is enough unless a merge lets a better edge in that it has passed;
     the fold notes that, and such units are folded step by step.
   Characters without a piece become their byte pieces (bpe), or an unknown edge (viterbi).
3. Ids are joined back to the chunks' tables within each bucket, dealt by chunk and written as one small file a chunk, and
   documents are put together from them by array arithmetic.

Units of more than LONGEST characters (a bit each in a long) are folded in Python with a queue, once for each distinct one,
by the same rule. Decoding joins ids to pieces, byte pieces to UTF-8, and takes the dummy space off.

Null or empty text: no ids, decoded as the empty text. The character U+2581 is read as a space, as the library does, so a
text with it does not come back (`round_trip` is false). A very long text is a chunk of its own; its units are dealt like
others. Repeated rows and rows of one doc_id, or without one: a row each. Equal texts have equal ids. Extra columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import common as C

SPACE = "▁"
#: Characters of a unit whose boundaries fit the bits of a long.
LONGEST = 62
#: Characters of a chunk of documents with one table of units, and the least number of buckets of such a table; units of more
#: than LONGEST characters have buckets of their own after them.
CHUNK, BUCKETS, LONG_BUCKETS = 64_000_000, 256, 16
#: Bytes of numbers that are turned into ids at once.
TOGETHER = 1_000_000
#: Units of one task whose edges are grouped in memory; more of them are grouped by sorting.
IN_MEMORY = "10000"
NO_EDGE = float("-inf")
WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")


@dataclass
class Pieces:
    """A model's pieces; ids of the 256 byte pieces follow from `first_byte`."""

    ids: dict[str, int]
    scores: dict[str, float]
    names: list[str]
    first_byte: int | None
    longest: int

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        first = next((i for i in range(len(names)) if sp.is_byte(i)), None)
        return cls({names[i]: i for i in plain}, {names[i]: sp.get_score(i) for i in plain}, names, first, max(len(names[i]) for i in plain))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i, self.scores[p]) for p, i in self.ids.items()], "piece string, id int, score double")

    def pairs(self) -> set[str]:
        """Two characters that some piece holds side by side."""
        return {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    def spelled(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.first_byte is not None:
                out.extend(self.first_byte + b for b in s.encode("utf-8", "surrogatepass"))
            else:
                out.append(0)
        return out

    def fold(self, unit: str) -> list[int]:
        """Ids of one unit by a queue of edges and linked symbols: the best edge over two neighbours, leftmost of equals."""
        scores, n = self.scores, len(unit)
        nexts, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-scores[unit[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if unit[i : i + 2] in scores]
        heapq.heapify(queue)
        while queue:
            _, a, m, e = heapq.heappop(queue)
            if nexts[a] != m or m >= n or nexts[m] != e:
                continue
            nexts[a], nexts[m] = e, -1
            if e < n:
                before[e] = a
                f = nexts[e]
                s = scores.get(unit[a:f])
                if s is not None:
                    heapq.heappush(queue, (-s, a, e, f))
            p = before[a]
            if p >= 0:
                s = scores.get(unit[p:e])
                if s is not None:
                    heapq.heappush(queue, (-s, p, a, e))
        symbols, i = [], 0
        while i < n:
            symbols.append(unit[i : nexts[i]])
            i = nexts[i]
        return self.spelled(symbols)


def words_of(text: str | None) -> list[str]:
    """Words, with empty strings between some; texts without runs of spaces are split without a pattern."""
    if not text:
        return []
    text = " " + text
    if "  " in text or SPACE in text or "\0" in text:
        return WORD.findall(text.replace(" ", SPACE))
    return text.replace("\n", "\0\n\0").replace(" ", "\0" + SPACE).split("\0")


def units_of(word: str, pairs: set[str]) -> list[str]:
    """A word cut wherever no piece holds the characters on both sides."""
    cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def separator_of(pieces: Pieces) -> str:
    """A character that no piece holds beside another, so units with it are that character alone."""
    joined = "".join(p for p in pieces.ids if len(p) > 1)
    return next(c for c in "\n\t\r\v" if c not in joined)


def varint(n: int) -> bytes:
    """Seven bits a byte, the lowest first; the last byte is below 128."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def numbers_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in bytes of varint(), and where each ends."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first) if len(first) else np.empty(0, np.int64), last + 1


class Units(dict):
    """Numbers of each word's units, as bytes; units get the next place of their bucket as they are met."""

    def __init__(self, pairs: set[str], buckets: int):
        super().__init__()
        self.pairs, self.numbers, self.buckets, self.table = pairs, {}, buckets, [[] for _ in range(buckets + LONG_BUCKETS)]

    def __missing__(self, word: str) -> bytes:
        found = self[word] = b"".join(map(self.number, units_of(word, self.pairs)))
        return found

    def number(self, unit: str) -> bytes:
        found = self.numbers.get(unit)
        if found is None:
            h = zlib.crc32(unit.encode("utf-8", "surrogatepass"))
            bucket = h % self.buckets if len(unit) <= LONGEST else self.buckets + h % LONG_BUCKETS
            found = self.numbers[unit] = varint(len(self.table[bucket]) * len(self.table) + bucket)
            self.table[bucket].append(unit)
        return found


CODED = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("text_crc32", pa.int64()), ("bucket", pa.int32()), ("units", pa.string())])


def coded(docs: DataFrame, pieces: Pieces, buckets: int, chunk: int = CHUNK) -> DataFrame:
    """Rows of documents (chunk, doc_id, codes, text_crc32), and of their chunks' tables (chunk, bucket, units in order)."""
    pairs, separator = pieces.pairs(), separator_of(pieces)

    def table(number: int, units: Units) -> pa.RecordBatch:
        rows = [(k, separator.join("" if u == separator else u for u in x)) for k, x in enumerate(units.table) if x]
        n = len(rows)
        return pa.record_batch([pa.array([number] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.string())], schema=CODED)

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, units, size = TaskContext.get().partitionId() << 24, Units(pairs, buckets), 0
        for b in batches:
            texts = b.column(1).to_pylist()
            codes = [b"".join(map(units.__getitem__, words_of(t))) for t in texts]
            crc = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            n = len(texts)
            yield pa.record_batch([pa.array([number] * n, pa.int64()), b.column(0), pa.array(codes, pa.binary()), pa.array(crc, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=CODED)
            size += sum(len(t) for t in texts if t)
            if size >= chunk:
                yield table(number, units)
                number, units, size = number + 1, Units(pairs, buckets), 0
        yield table(number, units)

    C.small_batches(docs.sparkSession)
    return C.first_with_text(docs).mapInArrow(run, "chunk long, doc_id long, codes binary, text_crc32 long, bucket int, units string")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser inlines."""
    return F.get(F.transform(F.array(value), body), 0)


def lattice(words: DataFrame, pieces: DataFrame, longest: int, by: list[str]) -> DataFrame:
    """(by, word, edges): pieces found in each distinct word, as structs of start, end, score, id; best score first, then leftmost.

    The words are dealt by `by`, and so are the edges that come of them: grouping them needs no exchange.
    """
    n = F.length("word")
    starts = words.select(*by, "word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select(*by, "word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + F.lit(longest)))).alias("e"))
    found = spans.withColumn("piece", F.expr("substring(word, s + 1, e - s)")).join(F.broadcast(pieces), "piece", "left")
    # a word of no piece at all keeps the row of its first character
    edge = F.when(F.col("id").isNotNull(), F.struct((-F.col("score")).alias("cost"), "s", "e", "id"))
    return found.where("id is not null or (s = 0 and e = 1)").groupBy(*by, "word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def bpe_bounds(edges: Column, n: Column) -> Column:
    """Boundaries after all merges, as bits of a long (of words of at most LONGEST characters)."""
    one = F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, i)
    ends = lambda e: bit(e["s"]).bitwiseOR(bit(e["e"]))
    between = lambda e: bit(e["e"]) - bit(e["s"] + 1)
    merges = F.transform(F.filter(edges, lambda e: e["e"] - e["s"] > 1), lambda e: F.struct(e["cost"].alias("cost"), ends(e).alias("ends"), between(e).alias("between")))
    fits = lambda e, bounds: (bounds.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(bounds.bitwiseAND(e["between"])) == 1)
    without = lambda e, bounds: bounds.bitwiseAND(F.bitwise_not(e["between"]))
    every = bit(n + 1) - one
    state = lambda bounds, missed: F.struct(bounds.alias("bounds"), missed.alias("missed"))

    def walk(found: Column) -> Column:
        def step(s: Column, e: Column) -> Column:
            now = without(e, s["bounds"])
            better = F.exists(found, lambda f: (f["cost"] < e["cost"]) & fits(f, now))
            return F.when(~s["missed"] & fits(e, s["bounds"]), state(now, better)).otherwise(s)

        return F.aggregate(found, state(every, F.lit(False)), step)

    def by_steps(found: Column) -> Column:
        """A step per character is enough, as each takes one boundary out."""

        def step(bounds: Column, _: Column) -> Column:
            best = F.get(F.filter(found, lambda e: fits(e, bounds)), 0)
            return F.coalesce(without(best, bounds), bounds)

        return F.aggregate(F.sequence(F.lit(1), n), every, step)

    return let(merges, lambda found: let(walk(found), lambda s: F.when(s["missed"], by_steps(found)).otherwise(s["bounds"])))


def viterbi_bounds(edges: Column, n: Column, unknown: float = -1e4):
    """The best path to each position as (score, start), and the step that walks it back from the end."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("s")))

    def step(best: Column, e: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.struct((F.get(best, x["s"])["score"] + (-x["cost"])).alias("score"), x["s"].alias("s")))
        alone = F.struct((F.get(best, e - 1)["score"] + F.lit(unknown)).alias("score"), (e - 1).alias("s"))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(alone)))))

    best = F.aggregate(F.sequence(F.lit(1), n), first, step)
    back = lambda path, _: F.when(path[0] == 0, path).otherwise(F.concat(F.array(F.get("best", path[0])["s"]), path))
    return best, back


def encode_words(words: DataFrame, pieces: DataFrame, longest: int, first_byte: int | None, fold: str = "bpe", by: list[str] | None = None) -> DataFrame:
    """(by, word, ids) of distinct words through the lattice; `by` are columns that they are dealt by."""
    n, by = F.length("word"), by or []
    rows = lattice(words.select(*by, "word").where(n > 0), pieces, longest, by)
    if fold == "bpe":
        bounds = let(bpe_bounds(F.col("edges"), n), lambda bits: F.filter(F.sequence(F.lit(0), n), lambda i: F.getbit(bits, i) == 1))
    else:
        best, back = viterbi_bounds(F.col("edges"), n)
        rows = rows.withColumn("best", best)
        bounds = F.aggregate(F.sequence(F.lit(1), n), F.array(n), back)

    def spelled(c: Column) -> Column:
        """Byte pieces of a character without a piece, or the unknown id."""
        if first_byte is None:
            return F.array(F.lit(0))
        digit = lambda k: F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), 2 * k + 1, F.lit(2)), 16, 10).cast("int")
        return F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda k: F.lit(first_byte) + digit(k))

    def symbol(start: Column, end: Column) -> Column:
        hit = F.filter("edges", lambda x: (x["s"] == start) & (x["e"] == end))
        return let(hit, lambda h: F.when(F.size(h) > 0, F.array(h[0]["id"])).otherwise(spelled(F.substring("word", start + 1, end - start))))

    ids = let(bounds, lambda b: F.flatten(F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda s, i: symbol(s, F.get(b, i + 1)))))
    return rows.select(*by, "word", ids.alias("ids"))


def folded_long(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(bucket, word, ids) of distinct words of more than LONGEST characters."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([pieces.fold(w) for w in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["bucket", "word", "ids"])

    return words.mapInArrow(run, "bucket int, word string, ids array<int>")


def dictionaries(rows: DataFrame, pieces: Pieces, buckets: int) -> str:
    """Writes the ids of each chunk's units (counts and ids of each bucket, in order) to a folder of its own; the folder they are in."""
    spark, separator = rows.sparkSession, separator_of(pieces)
    # the chunk goes before its units in one text, so that both sides of the join need the same columns and share an exchange
    packed = rows.where("units is not null").select("bucket", F.concat_ws(separator, "chunk", "units").alias("packed"))

    def found(dealt: DataFrame, encode) -> DataFrame:
        parts = dealt.select("bucket", F.split("packed", separator, -1).alias("p"))
        units = parts.select("bucket", F.col("p")[0].cast("long").alias("chunk"), F.posexplode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("at", "word"))
        units = units.withColumn("word", F.when(F.col("word") == "", separator).otherwise(F.col("word")))
        # joined by merging, as the size of what comes of a packed row is not known beforehand
        return units.join(encode(units.select("bucket", "word").distinct()).hint("merge"), ["bucket", "word"])

    # a number of partitions of its own, as Spark would merge these small ones, whose words become many more rows each
    short = found(packed.where(F.col("bucket") < buckets).repartition(buckets, "bucket"), lambda words: encode_words(words, pieces.frame(spark), pieces.longest, pieces.first_byte, by=["bucket"]))
    long = found(packed.where(F.col("bucket") >= buckets).repartition(LONG_BUCKETS, "bucket"), lambda words: folded_long(words, pieces))
    parts = [x.groupBy("chunk", "bucket").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("x")) for x in (short, long)]
    kind = "array<smallint>" if len(pieces.names) <= 1 << 15 else "array<int>"
    ids = parts[0].unionByName(parts[1]).select("chunk", "bucket", F.transform("x", lambda u: F.size(u["ids"])).alias("counts"), F.flatten(F.transform("x", lambda u: u["ids"])).cast(kind).alias("ids"))
    # the tables are dealt by bucket, which is enough to join them by bucket and word
    with C.settings(spark, spark_sql_requireAllClusterKeysForCoPartition="false", spark_sql_objectHashAggregate_sortBased_fallbackThreshold=IN_MEMORY):
        return C.cut_by(ids, "chunk", "bucket", "dictionary")


def buckets_of(spark: SparkSession) -> int:
    return max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


class Dictionary:
    """Ids of one chunk's units: all in one array, with the place of each unit's."""

    def __init__(self, folder: str, chunk: int, buckets: int):
        self.buckets = buckets + LONG_BUCKETS
        self.first, ids, counts, n = np.zeros(self.buckets, np.int64), [], [], 0
        for table in C.read_folder(f"{folder}/chunk={chunk}", ["bucket", "counts", "ids"]):
            for bucket, c, i in zip(*(table.column(k).combine_chunks() for k in ("bucket", "counts", "ids")), strict=True):
                self.first[bucket.as_py()] = n
                counts.append(c.values.to_numpy(zero_copy_only=False))
                ids.append(i.values.to_numpy(zero_copy_only=False))
                n += len(counts[-1])
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
        self.counts = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in order, and how many come of each."""
        unit = self.first[numbers % self.buckets] + numbers // self.buckets
        n = self.counts[unit]
        at = np.repeat(self.starts[unit] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.ids[at].astype(np.int32), n


def encoded(batches: Iterator[pa.RecordBatch], folder: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """(chunk, doc_id, codes, text_crc32) batches to (doc_id, ids, text_crc32), some documents of one chunk at a time."""
    chunk, known = None, None
    for b in batches:
        chunks, codes = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
        x = 0
        while x < len(codes):
            y, size = x, 0
            while y < len(codes) and chunks[y] == chunks[x] and (y == x or size + len(codes[y]) <= TOGETHER):
                size += len(codes[y])
                y += 1
            ends = np.cumsum([0, *map(len, codes[x:y])])
            numbers, stops = numbers_of(np.frombuffer(b"".join(codes[x:y]), np.uint8))
            if len(numbers):
                if chunk != chunks[x]:
                    chunk, known = chunks[x], Dictionary(folder, int(chunks[x]), buckets)
                ids, n = known.of(numbers)
            else:
                ids, n = np.empty(0, np.int32), np.empty(0, np.int64)
            # how many units end before each document's end, and so how many ids
            ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(stops, ends, "right")].astype(np.int32)
            yield pa.record_batch([b.column(1).slice(x, y - x), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())), b.column(3).slice(x, y - x)], names=["doc_id", "ids", "text_crc32"])
            x = y


def decoded(batches: Iterator[pa.RecordBatch], table: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Batches with ids to the same with the text they stand for instead."""
    get = table.__getitem__
    for b in batches:
        lists = b.column("ids")
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        texts = [b"".join(map(get, flat[s:e].tolist())).decode("utf-8", "replace")[1:] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        more = [c for c in b.schema.names if c != "ids"]
        yield pa.record_batch([*(b.column(c) for c in more), pa.array(texts, pa.string())], names=[*more, "text"])


def spellings(pieces: Pieces) -> list[bytes]:
    """What each id stands for."""
    table = [p.replace(SPACE, " ").encode() for p in pieces.names]
    for b in range(256) if pieces.first_byte is not None else ():
        table[pieces.first_byte + b] = bytes([b])
    return table


def prepared(docs: DataFrame, pieces: Pieces, chunk: int = CHUNK) -> tuple[DataFrame, str, int]:
    """Rows of documents as numbers of units, the folder of their chunks' dictionaries, and the number of buckets."""
    buckets = buckets_of(docs.sparkSession)
    rows = C.cut(coded(docs, pieces, buckets, chunk), "coded", "zstd")
    return rows.where("units is null").select("chunk", "doc_id", "codes", "text_crc32"), dictionaries(rows, pieces, buckets), buckets


def encode(docs: DataFrame, pieces: Pieces, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, text_crc32 of every row."""
    rows, folder, buckets = prepared(docs, pieces, chunk)
    return rows.mapInArrow(lambda batches: encoded(batches, folder, buckets), "doc_id long, ids array<int>, text_crc32 long")


def decode(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """The rows' other columns and the text of ids."""
    table = spellings(pieces)
    more = [c for c in rows.columns if c != "ids"]
    return rows.select(*more, "ids").mapInArrow(lambda batches: decoded(batches, table), rows.select(*more).schema.add("text", "string"))


def round_trip(docs: DataFrame, model_file: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip: whether the ids decode to the text."""
    pieces = Pieces.load(model_file)
    table = spellings(pieces)
    rows, folder, buckets = prepared(docs, pieces, chunk)

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in encoded(batches, folder, buckets):
            lists = b.column("ids")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4")
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            (back,) = decoded(iter([b]), table)
            same = [zlib.crc32(t.encode()) == c for t, c in zip(back.column("text").to_pylist(), b.column("text_crc32").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
