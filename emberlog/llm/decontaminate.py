"""Benchmark decontamination by winnowing.

Words are maximal runs of 0-9, a-z (after A-Z are lower-cased) and characters beyond ASCII. A window is `window`
consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Every word of a
document inside any occurrence of a window counts as hit.

Winnowing: with k-grams of `gram` words, the smallest hash of each run of window-gram+1 grams is kept (the right one
of equals). Equal windows keep the same gram at the same place, so every shared window shares a kept fingerprint.

1. Fingerprints of the benchmark become a table (print, item, ...); an item shorter than a window has one, of its whole
   sequence. A Bloom filter over them of at most MOST_BITS bits is broadcast, however large the benchmark is.
2. One pass over the documents keeps the fingerprints that the filter lets through, with their places; other documents
   are done. Texts go by their SHA-256, so copies of a text are searched once.
3. Fingerprints of both sides are joined, and each hit is extended to both sides: all windows around it are compared
   with the item's windows, and neighbouring ones merge into spans. Nothing but the words around hits is dealt.
Windows are compared by 64-bit hashes. The joins are salted by text, so a print that many texts share is not one task.

Null or empty texts have no words and no hits; very long ones go whole. Repeated rows, rows of one doc_id or without one: a
result row each. Repeated item_ids: each row is an item of its own text, counted once; a null item_id counts as one item
and has no place in the digest. An empty benchmark hits nothing, an empty table of documents gives no rows. Extra columns
are ignored by `contamination` and pass through `cleaned`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import common as C

WINDOW, GRAM = 10, 5
#: Bits of the Bloom filter for each fingerprint, and at least and most of them (16 MB); probes of one fingerprint.
BITS_EACH, LEAST_BITS, MOST_BITS, PROBES = 32, 1 << 16, 1 << 27, 4
#: Texts with hits whose digests (64 characters each) are broadcast to take them out; more are joined otherwise.
FEW_TEXTS = 50_000
#: Bytes that are not part of a word become spaces, and A-Z becomes a-z.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def winnow(h: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest hash of every run of `span` hashes, the right one of equals."""
    if len(h) < span:
        return np.empty(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(h[::-1], span)
    return np.unique(len(h) - 1 - (np.arange(len(runs)) + runs.argmin(axis=1)))


def prints_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints; those of short items, of `words` words, are none of the k-grams' (0)."""
    return C.mix64(hashes + np.uint64(words * 0x9E3779B97F4A7C15 & (2**64 - 1)))


class Filter:
    """A Bloom filter as an array of 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, prints: np.ndarray) -> np.ndarray:
        found = np.ones(len(prints), bool)
        step = prints >> np.uint64(32) | np.uint64(1)
        for i in range(PROBES):
            at = prints + np.uint64(i) * step & self.mask
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def filter_of(prints: DataFrame, n: int) -> Filter:
    """Built by Spark; a row for each 64 bits that are not all zero is fetched."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length()))
    step = F.shiftrightunsigned("print", 32).bitwiseOR(F.lit(1).cast("long"))
    low = F.col("print").bitwiseAND(F.lit(bits - 1).cast("long"))
    at = F.explode(F.array(*((low + F.lit(i).cast("long") * step).bitwiseAND(F.lit(bits - 1).cast("long")) for i in range(PROBES))))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    rows = prints.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filter(words)


def items_of(benchmark: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, windows) of every item row with words, written out, and its fingerprints (print, item, item_id, words)."""

    @C.frugal
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [C.word_hashes(words_of(t)) for t in b.column(2).to_pylist()]
            grams = [np.unique(C.gram_hashes(w, min(window, len(w)))) if len(w) else np.empty(0, np.uint64) for w in words]
            prints = []
            for w in words:
                if len(w) >= window:
                    g = C.gram_hashes(w, gram)
                    prints.append(np.unique(prints_of(g[winnow(g, window - gram + 1)], 0)).view(np.int64))
                else:
                    prints.append(prints_of(C.gram_hashes(w, len(w)), len(w)).view(np.int64) if len(w) else np.empty(0, np.int64))
            short = [len(w) if len(w) < window else 0 for w in words]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(prints, pa.list_(pa.int64())), pa.array(short, pa.int32())], names=["item", "item_id", "windows", "prints", "short"])

    C.small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = C.cut(rows.mapInArrow(windows, "item long, item_id long, windows binary, prints array<bigint>, short int").where("size(prints) > 0"), "items")
    return items.select("item", "item_id", "windows"), items.select(F.explode("prints").alias("print"), "item", "item_id", "short")


FOUND = pa.list_(pa.struct([("print", pa.int64()), ("at", pa.list_(pa.int32()))]))


def scanned(docs: DataFrame, known: Filter, shorts: list[int], window: int, gram: int) -> DataFrame:
    """doc_id, n_words of every row; for those with fingerprints that the filter knows also key (SHA-256 of the text), them, and the words."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            n_words, keys, found, words = [], [], [], []
            for t in b.column(1).to_pylist():
                w = C.word_hashes(words_of(t))
                g = C.gram_hashes(w, gram)
                kept = winnow(g, window - gram + 1)
                at, prints = [kept], [prints_of(g[kept], 0)]
                for n in shorts:
                    h = prints_of(C.gram_hashes(w, n), n)
                    at.append(np.arange(len(h)))
                    prints.append(h)
                at, prints = np.concatenate(at), np.concatenate(prints)
                hit = known.has(prints)
                n_words.append(len(w))
                if not hit.any():
                    keys.append(None)
                    found.append(None)
                    words.append(None)
                    continue
                at, prints = at[hit], prints[hit].view(np.int64)
                order = np.argsort(prints, kind="stable")
                each, first = np.unique(prints[order], return_index=True)
                keys.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest())
                found.append([{"print": p, "at": x.tolist()} for p, x in zip(each.tolist(), np.split(at[order], first[1:]), strict=True)])
                words.append(w.tobytes())
            yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(keys, pa.string()), pa.array(found, FOUND), pa.array(words, pa.binary())], names=["doc_id", "n_words", "key", "found", "words"])

    C.small_batches(docs.sparkSession)
    return C.first_with_text(docs).mapInArrow(run, "doc_id long, n_words long, key string, found array<struct<print:bigint,at:array<int>>>, words binary")


def surroundings(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, item, starts, counts, words): the words of all windows around each item's hits, from (key, words, hits)."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, words, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = np.frombuffer(words, np.uint64)
                by: dict[int, list[int]] = {}
                for h in hits:
                    by.setdefault(h["item"], []).extend(h["at"])
                rows = []
                for item, at in by.items():
                    p = np.unique(np.array(at))
                    lo, hi = np.maximum(p - (window - gram), 0), np.minimum(p + window, len(w))
                    new = np.concatenate([[True], lo[1:] > hi[:-1]])  # ranges that touch are one
                    starts, ends = lo[new], np.concatenate([hi[:-1][new[1:]], hi[-1:]])
                    rows.append((key, item, starts.tolist(), (ends - starts).tolist(), b"".join(w[x:y].tobytes() for x, y in zip(starts, ends, strict=True))))
                for k in range(0, len(rows), C.BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[k : k + C.BATCH_ROWS], strict=True), (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["key", "item", "starts", "counts", "words"])

    return texts.select("key", "words", "hits").mapInArrow(run, "key string, item long, starts array<int>, counts array<int>, words binary")


def extended(rows: DataFrame, window: int) -> DataFrame:
    """(key, item_id, spans) from (key, item_id, starts, counts, words, windows); spans are pairs of positions, flattened."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for starts, counts, words, windows in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                w, known, spans, at = np.frombuffer(words, np.uint64), np.frombuffer(windows, np.uint64), [], 0
                for start, n in zip(starts, counts, strict=True):
                    h = C.gram_hashes(w[at : at + n], window)
                    at += n
                    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    for s in (np.flatnonzero(known[place] == h) + start).tolist():
                        if spans and s <= spans[-1]:
                            spans[-1] = s + window
                        else:
                            spans += [s, s + window]
                out.append(spans)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["key", "item_id", "spans"])

    return rows.select("key", "item_id", "starts", "counts", "words", "windows").mapInArrow(run, "key string, item_id long, spans array<bigint>").where("size(spans) > 0")


def searched(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, key) of every row and (key, n_hit, spans, items) of the texts with hits; both are written out."""
    items, prints = items_of(benchmark, window, gram)
    n, lengths = prints.agg(F.count("*"), F.collect_set("short")).first()
    scan = C.cut(scanned(docs, filter_of(prints, n), sorted(x for x in lengths if x), window, gram), "scan")
    texts = C.cut(scan.where("key is not null").select("key", "found", "words").dropDuplicates(["key"]), "texts")
    met = C.salted(texts.select("key", F.explode("found").alias("f")).select("key", "f.print", "f.at"), prints, "print", F.col("key"))
    met = C.cut(met.select("key", "at", "item", "item_id", "short"), "met")
    whole = met.where("short > 0").select("key", "item_id", F.flatten(F.transform("at", lambda x: F.array(x.cast("long"), (x + F.col("short")).cast("long")))).alias("spans"))
    hits = met.where("short = 0").groupBy("key").agg(F.collect_list(F.struct("item", "at")).alias("hits"))
    near = surroundings(texts.select("key", "words").join(hits, "key"), window, gram)
    long = extended(C.salted(near, items, "item", F.col("key")), window)
    # an item without an id is one item, too: structs are collected where bare nulls would be left out
    each = long.unionByName(whole).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.collect_set(F.struct("item_id"))).alias("items"))
    # the fold's state is (words so far, end so far) over the sorted spans
    pairs = F.sort_array(F.expr("transform(sequence(0, size(spans) div 2 - 1), i -> struct(spans[cast(2 * i as int)] as a, spans[cast(2 * i + 1 as int)] as b))"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), p["b"] - F.greatest(p["a"], s["end"]))).alias("n"), F.greatest(s["end"], p["b"]).alias("end"))
    found = each.select("key", F.aggregate(pairs, start, step)["n"].alias("n_hit"), "spans", F.transform("items", lambda x: x["item_id"]).alias("items"))
    found = C.cut(found, "hits")
    C.drop_cut(items, texts, met)
    return scan.select("doc_id", "n_words", "key"), found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, spans (pairs of word positions, flattened), items."""
    scan, found = searched(docs, benchmark, window, gram)
    some = C.salted(scan.where("key is not null"), found, "key", F.struct("doc_id", "n_words"), "left")
    clean = scan.where("key is null").select("doc_id", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<bigint>").alias("items"))
    rows = clean.unionByName(some.drop("key"))
    none = F.array().cast("array<bigint>")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", none).alias("items"))


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, few: int = FEW_TEXTS) -> DataFrame:
    """The rows of docs without a hit.

    Many texts with hits are not joined to all documents: a bitmap of their digests takes out nearly all others before.
    """
    _, found = searched(docs, benchmark, window, gram)
    gone = found.select(F.col("key").alias("key__"))
    rows = docs.withColumn("key__", F.sha2(F.col("text").cast("string").cast("binary"), 256))
    if gone.count() <= few:
        return rows.join(F.broadcast(gone), "key__", "left_anti").drop("key__")
    bits, held = C.bitmap(gone, "key__"), C.in_bitmap("key__")
    rows = rows.withColumn("word__", C.bitmap_word("key__")).join(F.broadcast(bits), "word__", "left").withColumn("maybe__", F.coalesce(held, F.lit(False)))
    maybe = rows.where("maybe__")
    left = maybe.withColumn("salt__", F.pmod(F.xxhash64("doc_id"), F.lit(C.SALTS)))
    right = gone.withColumn("salt__", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(C.SALTS - 1).cast("long"))))
    return rows.where("not maybe__").select(docs.columns).unionByName(left.join(right, ["key__", "salt__"], "left_anti").select(docs.columns))


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns."""
    by_text = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(by_text, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[int, str]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """n_words, n_hit, n_items, digest by comparing every window; for tests."""
    w = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        v = words_of(t)
        n = min(window, len(v))
        known = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in known:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest()
