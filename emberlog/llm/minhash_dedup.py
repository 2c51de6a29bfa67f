"""Near-duplicate groups by SetSketch registers, verified on full shingle sets.

A document's set is its distinct shingles of `size` consecutive words; one shorter than that has its whole
sequence of words as its only shingle, and one without words has an empty set and no links. Words are runs of
anything but ASCII white space after A-Z are lower-cased. Documents are linked if the Jaccard similarity of their
sets is at least `threshold`; a group is a connected component.

1. Documents of equal sets form a class with a number of its own; copies never meet in pairs, and which text a doc_id has
   plays no part, so rows of one doc_id with different texts are in the classes of their texts.
2. SetSketch: every shingle emits the points of a Poisson process on the registers; a register keeps the smallest,
   stored as a truncated exponent of base b. Sketches of parts merge by taking maxima.
3. Bands of registers are hashed; classes with an equal band are candidates. Instead of all pairs of a bucket, each
   member meets the bucket's centre. Members of buckets that still span several components then meet across
   components only: buckets of one largest component are merged and compared in blocks.
4. A candidate is dropped if the joint likelihood of both sketches puts its similarity far below the threshold, and
   otherwise confirmed on the full sets.

Chance of no common band at similarity 0.75: (1 - 0.75**4)**64 < 3e-11 a pair. Shingles are 64-bit hashes.
Null or empty text: n_shingles 0, its own group. Very long texts go whole. Repeated rows, and rows of one doc_id with
different texts, give a result each; a doc_id reaches what any of its rows is linked with only through that row's text. A row
without doc_id is linked like others; its component_id is that of its group, null if the group has no doc_id, and it is never
`kept`. `deduplicated` keeps one whole row of every group (the smallest doc_id, rows without one last, ties by the digest of the
text) and every row without words. Extra columns pass through, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import common as C

REGISTERS, BANDS_OF = 256, 4
BASE, RATE, LIMIT = 1.001, 20.0, 65534
LOG_BASE = math.log(BASE)
#: Candidates are dropped only where the likelihood falls by this many nats (about five standard deviations).
NATS = 12.0
#: Rows of one block of a hub's neighbourhood; a task compares two blocks.
BLOCK = 512
#: Centre rounds go on while the comparisons left exceed so many per class and the last round still found links.
WORK_PER_CLASS, CENTRE_ROUNDS = 2000, 8


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(C.gram_hashes(C.word_hashes(words), min(size, len(words))))


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each."""
    counts = np.array([len(s) for s in sets])
    least = np.full((len(sets), m), np.inf)
    todo, reach = np.arange(len(sets)), (math.log(m) + 4.0) / counts
    while len(todo):
        h = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, counts[todo])
        far = np.repeat(reach[todo], counts[todo])
        t = np.zeros(len(h))
        flat = np.full(len(sets) * m, np.inf)
        step = 0
        while len(h):
            step += 1
            r = C.mix64(h + np.uint64((step * 0xD1342543DE82EF95) & (2**64 - 1)))
            t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
            near = t <= far
            if not near.all():
                h, owner, far, t, r = h[near], owner[near], far[near], t[near], r[near]
            np.minimum.at(flat, owner * m + (r & np.uint64(m - 1)).astype(np.int64), t)
        flat = flat.reshape(len(sets), m)
        least[todo] = flat[todo]
        todo = todo[~np.isfinite(least[todo]).all(axis=1)]
        reach[todo] *= 2
    return np.clip(np.floor(1 - np.log(least / RATE) / LOG_BASE), 0, LIMIT).astype(np.uint16)


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """(rows, bands) signed 64-bit hashes of consecutive registers."""
    parts = regs.astype(np.uint64).reshape(len(regs), -1, BANDS_OF)
    h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(BANDS_OF):
        h = C.mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h.view(np.int64)


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """False where the joint likelihood of two rows of registers leaves no room for the threshold."""
    above, below = (ra > rb).sum(axis=1)[:, None], (ra < rb).sum(axis=1)[:, None]
    same = ra.shape[1] - above - below
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    top = np.minimum(u / v, v / u)
    j = np.minimum(np.linspace(0, 1, 101)[None, :], top)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / LOG_BASE
    more, less = p(u - v * j), p(v - u * j)
    ll = above * np.log(np.maximum(more, 1e-9)) + below * np.log(np.maximum(less, 1e-9)) + same * np.log(np.maximum(1 - more - less, 1e-9))
    at = np.where(j >= threshold - 1e-9, ll, -np.inf).max(axis=1)
    return at >= ll.max(axis=1) - NATS


SKETCH = pa.schema([("doc_id", pa.int64()), ("place", pa.string()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("regs", pa.binary())])


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): place names a row by its doc_id and the digest of its text, so only true repeats share it."""
    text = F.sha2(F.col("text").cast("binary"), 256)
    return C.first_with_text(docs).withColumn("place", F.concat_ws("/", F.col("doc_id").cast("string"), text))


def sketch(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, place, n_shingles, set_key (128-bit digest of the set), regs of rows of placed()."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingles(t, size) for t in b.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            regs = iter(registers(full)) if full else iter(())
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary())],
                schema=SKETCH,
            )

    C.small_batches(docs.sparkSession)
    return docs.select("doc_id", "place", "text").mapInArrow(run, "doc_id long, place string, n_shingles long, set_key binary, regs binary")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """(bucket, id): the band hashes of each class."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = band_hashes(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, -1))
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), h.shape[1])
                yield pa.record_batch([pa.array(h.ravel()), pa.array(ids)], names=["bucket", "id"])

    return reps.select("id", "regs").mapInArrow(run, "bucket long, id long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Only buckets with several members, and their number; both sides of the join share one exchange."""
    rows = rows.repartition("bucket")
    crowded = rows.groupBy("bucket").agg(F.count("id").alias("n")).where("n > 1")
    return rows.join(crowded.hint("shuffle_merge"), "bucket").select("bucket", "id", "n")


def centre_pairs(rows: DataFrame, comp: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (a, b) of each member with its bucket's centre, if not of one component yet."""
    if comp is None:
        rows = rows.withColumn("comp", F.col("id"))
        weight = rows.groupBy("id").agg(F.sum("n").alias("weight"))
        rows = rows.join(weight, "id")
        centre = rows.groupBy("bucket").agg(F.max(F.struct("weight", "id", "comp")).alias("c"))
    else:
        order = F.xxhash64("id", "bucket", F.lit(turn))
        centre = rows.groupBy("bucket").agg(F.max(F.struct(order.alias("weight"), "id", "comp")).alias("c"))
    pairs = rows.join(centre, "bucket").where(F.col("comp") != F.col("c.comp"))
    return pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()


def hubs(rows: DataFrame) -> DataFrame:
    """(hub, id, comp) of open buckets: a bucket's hub is its largest component.

    Buckets with one hub merge, so a group that meets again in every band is compared once.
    """
    size = rows.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    hub = size.groupBy("bucket").agg(F.max(F.struct("k", "comp"))["comp"].alias("hub"))
    return C.salted(rows, hub, "bucket", F.col("id")).select("hub", "id", "comp").distinct()


def hub_work(near: DataFrame) -> float:
    """Comparisons within all hubs' neighbourhoods."""
    per = near.groupBy("hub").agg(F.count_if(F.col("comp") != F.col("hub")).cast("double").alias("o"), F.count_if(F.col("comp") == F.col("hub")).cast("double").alias("l"))
    return per.agg(F.coalesce(F.sum(F.col("o") * (F.col("o") + F.col("l"))), F.lit(0.0))).first()[0]


def hub_links(near: DataFrame, reps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different components within each hub's neighbourhood.

    Blocks of outer members meet blocks of the hub's own and of outer members. What the sketches leave is confirmed
    on the full sets in the same task; components that a task has linked are not linked again.
    """
    percent = round(threshold * 100)

    def run(t: pa.Table) -> pa.Table:
        ids, comp, n = (t.column(c).to_numpy() for c in ("id", "comp", "n_shingles"))
        left, right = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("is_left", "is_right"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(len(ids), -1)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        top = {int(c): int(c) for c in np.unique(comp)}

        def root(c: int) -> int:
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        links = []
        for i in left:
            j = right[(comp[right] != comp[i]) & (np.minimum(n[right], n[i]) >= threshold * np.maximum(n[right], n[i]))]
            if not len(j):
                continue
            j = j[likely(np.broadcast_to(regs[i], (len(j), regs.shape[1])), regs[j], np.full(len(j), float(n[i])), n[j].astype(float), threshold)]
            for k in j:
                a, b = root(int(comp[i])), root(int(comp[k]))
                if a != b and alike(sets[i], sets[k], percent):
                    top[max(a, b)] = min(a, b)
                    links.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    size = near.groupBy("hub").agg(F.count_if(F.col("comp") != F.col("hub")).alias("o"), F.count_if(F.col("comp") == F.col("hub")).alias("l"))
    blocks = lambda c: F.ceil(F.greatest(F.col(c), F.lit(1)) / F.lit(BLOCK)).cast("int")
    rows = C.salted(near, size, "hub", F.col("id")).withColumn("outer", F.col("comp") != F.col("hub")).withColumn("no", blocks("o")).withColumn("nl", blocks("l"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("outer"), F.col("no")).otherwise(F.col("nl"))).cast("int")
    rows = rows.withColumn("own", own)
    steps = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a cell (x, y): outer block x against block y, the hub's own blocks first and then the outer ones
    cell = lambda x, y, left, right: F.struct(x.alias("x"), y.alias("y"), F.lit(left).alias("is_left"), F.lit(right).alias("is_right"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("nl") + F.col("no") - 1), lambda y: cell(F.col("own"), y, True, False))
    as_right = F.transform(steps("no"), lambda x: cell(x, F.when(F.col("outer"), F.col("nl") + F.col("own")).otherwise(F.col("own")), False, True))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("outer"), F.concat(as_left, as_right)).otherwise(as_right))).select("hub", "id", "comp", "cell.*")
    rows = rows.groupBy("hub", "x", "y", "id", "comp").agg(F.max("is_left").alias("is_left"), F.max("is_right").alias("is_right"))
    rows = rows.join(reps.select("id", "n_shingles", "regs").join(sets, "id"), "id")
    return rows.groupBy("hub", "x", "y").applyInArrow(run, "a long, b long").distinct()


def sized_pairs(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes and sketches leave the threshold possible."""

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            ra, rb = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (4, 5))
            ok = pa.array(likely(ra, rb, na, nb, threshold))
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    one = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"))
    two = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold))
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def full_sets(texts: DataFrame, ids: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of some classes, from the texts of the rows that stand for them, written to the shared folder.

    Texts are not shuffled for it: a bitmap of the hashed places, of a bounded number of rows whatever the input,
    is broadcast and takes out nearly all others (fewer, the more millions of classes are asked for); the exact join follows
    on what is left.
    """

    @C.frugal
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingles(t, size).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    wanted = ids.join(reps.select("id", "place"), "id")
    near = texts.withColumn("word__", C.bitmap_word("place")).join(F.broadcast(C.bitmap(wanted, "place")), "word__").where(C.in_bitmap("place")).select("place", "text")
    return C.cut(near.join(wanted, "place").dropDuplicates(["id"]).select("id", "text").mapInArrow(make, "id long, shingles binary"), "sets")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    percent = round(threshold * 100)

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    one, two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp) for the ends of edges (a, b): alternating large-star and small-star, each round written to the shared folder.

    No group is gathered: every step is a grouped minimum and a join on the vertex.
    """
    edges = C.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc")
    spark, before = edges.sparkSession, None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b"), F.col("m").alias("a")).where("a != b").distinct()
        # small-star: the smaller neighbours of a vertex and itself point at the smallest
        small_min = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_min, "b").select(F.col("a"), F.col("m"))
        links = small.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small_min.select(F.col("m").alias("a"), F.col("b"))).where("a < b").distinct()
        links = C.cut(links, "cc")
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        C.drop_cut(edges)
        edges = links
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    comp = edges.groupBy("b").agg(F.min("a").alias("comp")).withColumnRenamed("b", "id")
    roots = edges.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id"))
    return comp.unionByName(roots.join(comp.select("id"), "id", "left_anti")) if edges.head(1) else spark.createDataFrame([], "id long, comp long")


def grouped(docs: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, place, n_shingles, set_key) of every row and (set_key, least, n_rows, comp) of every class; comp is the number of its component."""
    texts = placed(docs)
    sketches = C.cut(sketch(texts, size), "sketches")
    least = sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))
    # numbers are written down once, so they stay what they are
    classes = C.cut(least.withColumn("id", F.monotonically_increasing_id()), "classes")
    stands = (F.col("s.set_key") == F.col("c.set_key")) & F.col("s.doc_id").eqNullSafe(F.col("c.least"))
    reps = C.cut(sketches.alias("s").join(classes.alias("c"), stands).select("id", "place", "n_shingles", "regs").dropDuplicates(["id"]), "reps")
    rows = C.cut(shared_buckets(bucket_rows(reps)), "buckets")
    work = WORK_PER_CLASS * max(reps.count(), 1000)

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def tested(pairs: DataFrame) -> DataFrame:
        found = C.cut(sized_pairs(pairs, reps, threshold), "likely")
        sets = full_sets(texts, ends(found), reps, size)
        links = C.cut(confirmed(found, sets, threshold), "links")
        C.drop_cut(found, sets)
        return links

    links = tested(centre_pairs(rows, None, 0))
    comp = components(links)
    for turn in range(1, CENTRE_ROUNDS + 1):
        now = rows.select("bucket", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
        now = C.cut(C.salted(now, mixed, "bucket", F.col("id")), "open")
        near = C.cut(hubs(now), "hubs")
        last = turn == CENTRE_ROUNDS or hub_work(near) <= work
        if last:
            sets = full_sets(texts, near.select("id").distinct(), reps, size)
            found = C.cut(hub_links(near, reps, sets, threshold), "links")
            C.drop_cut(sets)
        else:
            found = tested(centre_pairs(now, comp, turn))
        if found.head(1):
            links = links.unionByName(found)
            comp = components(links)
        C.drop_cut(now, near)
        if last:
            break
    C.drop_cut(rows, reps)
    by_set = classes.join(comp, "id", "left").select("set_key", "least", "n_rows", F.coalesce("comp", "id").alias("comp"))
    return sketches.select("doc_id", "place", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")), by_set


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows, by_set = grouped(docs, size, threshold)
    smallest = by_set.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = by_set.join(smallest, "comp").select("set_key", "n_rows", "component_id")
    alone = rows.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = alone.unionByName(C.joined_by_hot(rows.where("set_key is not null"), named, "set_key", "n_rows", rows.count()).select("doc_id", "n_shingles", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """One row of docs for each group, and every row without words."""
    rows, by_set = grouped(docs, size, threshold)
    members = C.joined_by_hot(rows.where("set_key is not null"), by_set.select("set_key", "n_rows", "comp"), "set_key", "n_rows", rows.count())
    best = members.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "place"))["place"].alias("place__"))
    text = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    own = docs.withColumn("place__", F.concat_ws("/", F.col("doc_id").cast("long").cast("string"), text))
    empty = F.coalesce(F.length(F.regexp_replace(F.col("text").cast("string"), r"[ \t\n\x0B\f\r]+", "")), F.lit(0)) == 0
    kept = own.where(~empty).join(best.select("place__"), "place__").dropDuplicates(["place__"]).select(docs.columns)
    return docs.where(empty).unionByName(kept)
