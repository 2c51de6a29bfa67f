"""Toxicity by a factorisation machine over hashed terms.

Terms of a text are its distinct words (lower case, runs of letters) and their beginnings of four to six letters, hashed
into 2**BITS buckets. On a bounded sample of labelled rows the machine learns a weight and a vector for every bucket that
occurs, none left out, so a pair such as an insult and the mention of a group has a weight of its own even where each
is neutral alone. A bucket's input is not 1 but between FLOOR and 1: large where its own toxic share differs from that of
all rows, either way, or where it is frequent; it only says how fast a bucket is learned. A score is the logistic of bias,
weights and pair products over the known buckets of the whole text.

Only text is an input of a score. Null or empty texts have no terms and get the bias's score; a very long one enters
whole, by its distinct terms. Repeated rows and rows of one doc_id: a row each, and equal texts have equal scores. A null
doc_id is not held out, and labels without one teach nothing. A score of exactly 0.5 is predicted toxic. Extra columns,
also of the names used here, pass through `cleaned` unchanged; an empty table gives no rows. Without labelled rows of both
classes the machine has no terms and every score is a smoothed share of toxic labels, a quarter if there are none.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm import common as C

BITS, BEGINNINGS = 22, (4, 5, 6)
#: The most labelled rows that the machine is fitted on (those with the smallest hash of doc_id).
SAMPLE = 16_000
#: The least input of a bucket, the squared z of its toxic share from which it is 1, and the input of one in every row.
FLOOR, SURE, FREQUENT = 0.05, 50.0, 0.5
FACTORS, EPOCHS, RATE_WEIGHTS, RATE_VECTORS, RATE_BIAS = 8, 20, 0.2, 0.1, 0.1
WARM, SETTLED = 4, 0.02
KEPT_WORDS = 150_000
#: Places that are gathered at once for scores (64 bytes each).
TOGETHER = 200_000
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def buckets_of(word: str) -> list[int]:
    import xxhash

    terms = [word, *(f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> (64 - BITS) for t in terms]


class Terms:
    """Distinct buckets of texts, or places of the machine's ones among them; words are hashed once and kept."""

    def __init__(self, buckets: np.ndarray | None = None):
        self.known: dict[str, tuple[int, ...]] = {}
        self.places = None
        if buckets is not None:
            self.places = np.full(1 << BITS, -1, np.int32)
            self.places[buckets] = np.arange(len(buckets))

    def of(self, text: str | None) -> set[int]:
        words = set(WORD.findall((text or "").lower()))
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        for w in words.difference(self.known):
            b = buckets_of(w)
            self.known[w] = tuple(b) if self.places is None else tuple(x for x in self.places[b].tolist() if x >= 0)
        return set().union(*map(self.known.__getitem__, words))


@dataclass
class Machine:
    buckets: np.ndarray  # in order; a bucket's place is its number here
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, rows: list[set[int]] | list[np.ndarray]) -> np.ndarray:
        """Probabilities of rows of places, a bounded number of places at a time."""
        out, at = [], 0
        while at < len(rows):
            end, n = at, 0
            while end < len(rows) and (end == at or n + len(rows[end]) <= TOGETHER):
                n += len(rows[end])
                end += 1
            out.append(self.sums(rows[at:end], n))
            at = end
        x = np.concatenate(out) + self.bias if out else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    def sums(self, rows: list[set[int]] | list[np.ndarray], n: int) -> np.ndarray:
        """Weights and pair products; the places of a row are taken in order, so a score does not depend on its batch."""
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        if n and isinstance(rows[0], np.ndarray):  # in order already
            place = np.concatenate(rows)
        else:
            key = np.repeat(np.arange(len(rows), dtype=np.int64) << 32, counts) | np.fromiter(itertools.chain.from_iterable(rows), np.int64, n)
            key.sort()
            place = key & 0xFFFFFFFF
        full = np.flatnonzero(counts)
        x = np.zeros(len(rows))
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            v = self.vectors[place].astype(np.float64)
            s = np.add.reduceat(v, starts, axis=0)
            x[full] = np.add.reduceat(self.weights[place].astype(np.float64), starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts))
        return x


def inputs(rows: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """The input of each bucket, from how far its toxic share is from that of all rows, and how frequent it is."""
    seen, toxic = np.zeros(n), np.zeros(n)
    for r, label in zip(rows, y, strict=True):
        seen[r] += 1
        toxic[r] += label
    share = y.mean()
    square = (toxic - seen * share) ** 2 / np.maximum(seen * share * (1 - share), 1e-9)
    return np.maximum(FLOOR + (1 - FLOOR) * np.minimum(square / SURE, 1), FREQUENT * np.sqrt(seen / len(rows))).astype(np.float32)


def train(rows: list[np.ndarray] | list[list[int]], labels: np.ndarray, n: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by AdaGrad on the logistic loss; a row's gradient touches its own places only.

    After the first WARM epochs only rows take part whose prediction at the epoch's begin is off by more than SETTLED.
    """
    rng = np.random.default_rng(seed)
    y = labels.astype(float)
    bias, gb = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 1.0
    w, v = np.zeros(n, np.float32), rng.normal(0, 0.05, (n, FACTORS)).astype(np.float32)
    gw, gv = np.ones(n, np.float32), np.ones((n, FACTORS), np.float32)
    rows = [np.asarray(r, np.int32) for r in rows]
    if not any(map(len, rows)):
        return bias, w, np.zeros_like(v)
    x = inputs(rows, y, n)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        if epoch >= WARM:
            off = np.abs(Machine(np.empty(0), bias, w * x, v * x[:, None]).scores(rows) - y)
            order = order[off[order] > SETTLED]
        for i in order:
            r = rows[i]
            a = x[r]
            own = v[r] * a[:, None]
            s = own.sum(axis=0)
            z = bias + float(a @ w[r]) + 0.5 * float(s @ s - (own * own).sum())
            d = float(1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[i])
            gb += d * d
            bias -= RATE_BIAS * d / gb**0.5
            if abs(d) < 1e-3:
                continue
            dw, dv = d * a, d * a[:, None] * (s - own)
            gw[r] += dw * dw
            gv[r] += dv * dv
            w[r] -= RATE_WEIGHTS * dw / np.sqrt(gw[r])
            v[r] -= RATE_VECTORS * dv / np.sqrt(gv[r])
    return bias, w * x, v * x[:, None]


MACHINE = pa.schema([("bias", pa.float64()), ("buckets", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary())])


@C.frugal
def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the machine, from all rows (doc_id, label, buckets) of the sample; their order does not matter."""
    data = sorted(x for b in batches for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True))
    labelled = np.array([label for _, _, label in data], float)
    toxic, total = labelled.sum(), len(labelled)
    if not toxic or toxic == total:
        bias, none = float(np.log((toxic + 1) / (total - toxic + 3))), np.zeros(0, np.int32).tobytes()
        yield pa.record_batch([pa.array([bias]), *(pa.array([none], pa.binary()) for _ in range(3))], schema=MACHINE)
        return
    # one array of all rows' places, and rows as views of it; what came in is let go before the machine is trained
    ends = np.cumsum([len(b) // 4 for _, b, _ in data])
    flat = np.concatenate([np.frombuffer(b, "<i4") for _, b, _ in data])
    del data
    met = np.zeros(1 << BITS, bool)
    met[flat] = True
    buckets = np.flatnonzero(met).astype(np.int32)
    place = np.cumsum(met, dtype=np.int32) - 1
    flat = place[flat]
    del met, place
    C.release_memory()
    bias, weights, vectors = train(np.split(flat, ends[:-1]), labelled, len(buckets))
    yield pa.record_batch([pa.array([bias]), *(pa.array([x.tobytes()], pa.binary()) for x in (buckets, weights.astype(np.float32), vectors.astype(np.float32)))], schema=MACHINE)


def fit_to_folder(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> str:
    """Learns from labelled rows that are not held out, in one task over the bounded sample; the folder that the machine is in.

    Of labels of one doc_id that differ, the toxic one counts.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @C.frugal
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            found = [np.array(sorted(terms.of(t)), "<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "buckets"])

    C.small_batches(docs.sparkSession)
    texts = C.first_with_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = C.cut(texts.mapInArrow(hashed, "doc_id long, label int, buckets binary"), "terms")
    made = C.cut(rows.coalesce(1).mapInArrow(fitted, "bias double, buckets binary, weights binary, vectors binary"), "machine")
    C.drop_cut(rows)
    return C.folder_of(made)


@functools.lru_cache(maxsize=1)
def load(folder: str) -> Machine:
    """The machine of a folder, once a process: some 40 bytes for each bucket of the sample, so the driver need not see it."""
    rows = [r for t in C.read_folder(folder, MACHINE.names) for r in t.to_pylist()]
    one = rows[0] if rows else next(fitted(iter(()))).to_pylist()[0]  # no labelled row at all
    vectors = np.frombuffer(one["vectors"], np.float32).reshape(-1, FACTORS)
    return Machine(np.frombuffer(one["buckets"], np.int32), one["bias"], np.frombuffer(one["weights"], np.float32), vectors)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    return load(fit_to_folder(docs, labels, sample))


def score(docs: DataFrame, folder: str, name: str = "score") -> DataFrame:
    """The columns of docs and each row's score under `name`, by the machine in a folder that all executors see."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(folder)
        terms = Terms(machine.buckets)
        for b in batches:
            s = machine.scores([terms.of(t) for t in b.column("text").to_pylist()])
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    C.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def cleaned(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the machine does not call toxic."""
    rows = score(docs, fit_to_folder(docs, labels), "toxicity_score__")
    return rows.where(F.col("toxicity_score__") < threshold).drop("toxicity_score__")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = score(C.first_with_text(docs), fit_to_folder(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
