"""The change gates as Structured Streaming.

Page images are applied by foreachBatch: each micro-batch is appended, idempotently by its id, as Parquet under
`<folder>/batch=<id>`, and the state is the fold of what lies there; so a batch that runs again after a failure
replaces its own files. The seq gate keeps one number a stream with applyInPandasWithState.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.operators.cdc import applied_pages

APPLIED = "page_id long, lsn long, ord long, payload string"


def apply_pages(frames: DataFrame, folder: str, checkpoint: str, **trigger):
    """Starts the query that applies streamed page images (page_id, lsn, ord, payload)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        applied_pages(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def page_state(spark: SparkSession, folder: str) -> DataFrame:
    """The image that stays for each page, over all applied batches; earlier batches win ties."""
    rows = spark.read.schema(APPLIED + ", batch long").parquet(folder)
    rows = rows.withColumn("payload", F.struct("payload", F.col("ord").alias("o"))).withColumn("ord", F.struct("batch", "ord"))
    top = applied_pages(rows)
    return top.select("page_id", "lsn", F.col("payload.o").alias("ord"), F.col("payload.payload").alias("payload"))


def compact_state(spark: SparkSession, folder: str, path: str) -> None:
    """Writes the folded state elsewhere, so old batches can be dropped."""
    page_state(spark, folder).write.mode("overwrite").parquet(path)


def seq_gate(frames: DataFrame, floor: int = 0) -> DataFrame:
    """(stream_id, ord, seq) of accepted frames of a stream; each stream_id keeps its largest seq."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else floor
        rows = pd.concat(list(parts)).sort_values("ord", kind="stable")
        before = rows["seq"].cummax().shift(fill_value=top).clip(lower=top)
        out = rows[rows["seq"] > before]
        state.update((int(max(top, rows["seq"].max())),))
        yield out[["stream_id", "ord", "seq"]]

    return frames.select("stream_id", "ord", "seq").groupBy("stream_id").applyInPandasWithState(run, "stream_id string, ord long, seq long", "top long", "append", GroupStateTimeout.NoTimeout)


def progress(frames: DataFrame) -> DataFrame:
    """Running high-water marks by stream, for an update or complete sink."""
    return frames.groupBy("stream_id").agg(F.max("lsn").alias("last_lsn"), F.count("*").alias("frames"))
