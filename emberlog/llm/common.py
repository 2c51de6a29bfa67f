"""What the text operators share: tables, the shared folder, and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python; texts can be long, so far fewer than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker: a batch holds BATCH_ROWS rows at most, and no more than BATCH_BYTES unless one row has.

    The settings stay with the session, as frames are run after the operators that made them have returned; smaller ones are left.
    """
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def frugal(run):
    """A function over batches whose Python worker gives its memory back at the end of a task, as workers outlive tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped


def release_memory() -> None:
    """To the operating system what this process has freed; nothing where its C library cannot."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release_heaps(spark: SparkSession) -> None:
    """To the operating system the heap that earlier work has left in the executors, which they would keep for good.

    A collection in as many tasks as there are cores, which idle executors share evenly; one that gets none keeps its heap.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).collect()


@contextlib.contextmanager
def settings(spark: SparkSession, **changed: str) -> Iterator[None]:
    """Session settings for the jobs that run inside, put back afterwards; `_` in a name stands for `.`."""
    names = {k.replace("_", "."): v for k, v in changed.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir); one of the machine's own only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that this process has written and not removed yet.
WRITTEN: set[str] = set()


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.add(path)
    return path


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    WRITTEN.discard(folder)


def clean(spark: SparkSession, before: Iterable[str] = (), keep: Iterable[DataFrame] = ()) -> None:
    """Remove what operators have written to the shared folder; for when their results have been read or stored.

    Folders of `before` (a copy of WRITTEN) stay, and those that the frames of `keep` read.
    """
    names = {f.split("://")[-1].replace("file:", "").lstrip("/") for df in keep for f in df.inputFiles()}
    for folder in WRITTEN.difference(before):
        own = folder.split("://")[-1].replace("file:", "").lstrip("/")
        if not any(n.startswith(own) for n in names):
            remove(spark, folder)


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again: later stages survive lost executors without recomputing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, order: str, name: str) -> str:
    """Write a folder for each value of key, sorted by order, below the shared folder; the folder they are in."""
    path = new_folder(df.sparkSession, name)
    df.repartition(key).sortWithinPartitions(key, order).write.partitionBy(key).parquet(path, compression="zstd")
    return path


def read_folder(folder: str, columns: list[str]) -> list[pa.Table]:
    """The Parquet files of a folder that cut() wrote, read without Spark: for what workers load by themselves."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    files = sorted(x.path for x in store.get_file_info(fs.FileSelector(base)) if x.path.endswith(".parquet"))
    return [pq.ParquetFile(f, filesystem=store).read(columns) for f in files]


def folder_of(df: DataFrame) -> str:
    """The folder behind a frame made by cut()."""
    name = df.inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[-1]
    return f"{shared_folder(df.sparkSession)}/{name}"


def drop_cut(*frames: DataFrame) -> None:
    """Remove the files behind frames made by cut(), once nothing reads them any more."""
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            remove(df.sparkSession, f)
            WRITTEN.difference_update([w for w in WRITTEN if w.rsplit("/", 1)[-1] == f.rsplit("/", 1)[-1]])


#: Rows of a bitmap of hashed keys (64 bits each), broadcast: at most about 10 MB, whatever the number of keys.
BITMAP_WORDS = 1 << 17


def bitmap_word(key: str) -> Column:
    return F.shiftright(F.pmod(F.xxhash64(key), F.lit(BITMAP_WORDS * 64)), 6).cast("int")


def _bit(key: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(word__, bits__) of the hashed keys; join it by bitmap_word() and test with in_bitmap(), which lets few others through."""
    return keys.select(bitmap_word(key).alias("word__"), _bit(key).alias("bit__")).groupBy("word__").agg(F.bit_or("bit__").alias("bits__"))


def in_bitmap(key: str) -> Column:
    return F.col("bits__").bitwiseAND(_bit(key)) != 0


#: Parts that a key's rows are dealt to where a large part of all rows may share it.
SALTS = 16


def salted(many: DataFrame, few: DataFrame, on: str, by: Column, how: str = "inner") -> DataFrame:
    """A join on a key that a large part of `many` may share: its rows are dealt to SALTS parts by another column, and `few` goes to each."""
    left = many.withColumn("salt__", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = few.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [on, "salt__"], how).drop("salt__")


def joined_by_hot(many: DataFrame, few: DataFrame, on: str, count: str, total: int) -> DataFrame:
    """An inner join with a table that knows how many rows of `many` each key has.

    Keys that have more than a thousandth of all rows, so fewer than a thousand of them, are broadcast; the others are dealt.
    """
    hot = few.where(F.col(count) * 1000 > total)
    rest = many.join(F.broadcast(hot.select(on)), on, "left_anti").join(few, on)
    return many.join(F.broadcast(hot), on).unionByName(rest).drop(count)


def first_with_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 on arrays of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k consecutive words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return mix64(h)
