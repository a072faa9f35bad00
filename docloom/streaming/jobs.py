"""Structured Streaming jobs: event history, progress lines, windows, snapshots.

Semantics are ours where the batch operators have none: event time with a watermark,
late rows dropped beyond it, state kept per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.sources.shared import shared_folder

_PROVIDER, _ROCKS_DB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY = 20
TERMINAL = ("complete", "error")
PREFIX = "PIPELINE_EVENT "


def read(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def in_batches(rows: DataFrame, order: str, name: str, batches: int = 4) -> DataFrame:
    """``rows`` as a stream of several batches, each a range of ``order``; the ranges are written one after another."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{name}_in"
    cut = rows.select(F.col(order).cast("timestamp").cast("double").alias("t")).selectExpr(f"percentile_approx(t, array({', '.join(str(k / batches) for k in range(1, batches))})) AS p").first()["p"] or []
    at = F.col(order).cast("timestamp").cast("double")
    for k, (low, high) in enumerate(zip([None, *cut], [*cut, None], strict=True)):
        part = rows.where((F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high))
        part.repartition(1).write.mode("overwrite").parquet(f"{folder}/batch={k}")
    return read(spark, f"{folder}/batch=*", rows.schema)


def _ordered(batches: Iterator[pd.DataFrame], order: str, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The arrays of a key's rows in order. Most keys have few rows, so no frame is joined or sorted for each."""
    parts = list(batches)
    column = lambda c: parts[0][c].to_numpy() if len(parts) == 1 else np.concatenate([p[c].to_numpy() for p in parts])
    place = column(order).argsort(kind="stable")
    return column(order)[place], [column(c)[place] for c in names]


def _history(size: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The newest events of a key after each batch; nothing passes a terminal event."""
        kept, done = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        if not done:
            seq, (event,) = _ordered(batches, "seq", "event")
            end = next((k for k, e in enumerate(event) if e in TERMINAL), None)
            done = end is not None
            upto = len(seq) if end is None else end + 1
            kept = (kept + list(zip(seq[max(0, upto - size) : upto].tolist(), event[max(0, upto - size) : upto], strict=True)))[-size:]
        state.update((kept, done))
        yield pd.DataFrame({"key": [key[0]], "events": [[e for _, e in kept]], "last_seq": [kept[-1][0] if kept else None], "finished": [done]})

    return run


def event_history(events: DataFrame, key: str, seq: str, event: str, size: int = HISTORY) -> DataFrame:
    """Per key its last ``size`` events and whether it is finished, updated by batch."""
    rows = events.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(event).alias("event"))
    return rows.groupBy("key").applyInPandasWithState(
        _history(size), "key long, events array<string>, last_seq long, finished boolean", "kept array<struct<seq: long, event: string>>, done boolean", "update", GroupStateTimeout.NoTimeout
    )


def _snapshot(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts and the negative streak of an answer, from its state and the batch's events in order."""
    n, up, down, streak = state.get if state.exists else (0, 0, 0, 0)
    _, (sentiment,) = _ordered(batches, "id", "sentiment")
    negative = sentiment == "down"
    others = (~negative).nonzero()[0]
    n, up, down = n + len(sentiment), up + int((sentiment == "up").sum()), down + int(negative.sum())
    streak = len(sentiment) - 1 - int(others[-1]) if len(others) else streak + len(sentiment)
    state.update((n, up, down, streak))
    yield pd.DataFrame({"answer_id": [key[0]], "feedback_count": [n], "positive_count": [up], "negative_count": [down], "negative_streak": [streak]})


def feedback_snapshots(events: DataFrame) -> DataFrame:
    """Snapshots of answers (answer_id, id, sentiment) kept in four counters each; batches come in order of id."""
    return events.groupBy("answer_id").applyInPandasWithState(
        _snapshot, "answer_id long, feedback_count long, positive_count long, negative_count long, negative_streak long", "n long, up long, down long, streak long", "update", GroupStateTimeout.NoTimeout
    )


def subscription(past: DataFrame, live: DataFrame, finished: DataFrame, key: str, seq: str, size: int = HISTORY) -> DataFrame:
    """A subscriber's rows: each key's last ``size`` past rows, then its live rows after them unless the key is finished."""
    newest = W.partitionBy(key).orderBy(F.desc(seq))
    shown = past.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= size).drop("_n").withColumn("origin", F.lit("snapshot"))
    seen = past.groupBy(key).agg(F.max(seq).alias("_seen"))
    after = live.join(finished, key, "left_anti").join(seen, key, "left").where(F.col("_seen").isNull() | (F.col(seq) > F.col("_seen"))).drop("_seen")
    return shown.unionByName(after.withColumn("origin", F.lit("live")))


def progress_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed progress events of prefixed JSON lines; percent is clamped, bad JSON and other lines go."""
    body = F.expr(f"substring({column}, {len(PREFIX) + 1})")
    parsed = F.from_json(body, "document_id string, stage string, progress double, message string")
    rows = lines.where(F.col(column).startswith(PREFIX)).withColumn("e", parsed).where("e.document_id is not null")
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("e.progress", F.lit(0.0)))).cast("int")
    return rows.select("e.document_id", "e.stage", percent.alias("progress"), "e.message")


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "40 days") -> DataFrame:
    """Counts by window of event time; rows later than the watermark are dropped."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", width), kind).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Drive a stream over what is there now into Parquet files in the shared folder, and read them.

    A batch is one partition, so a repeated batch replaces itself. Of a complete stream the
    last batch is the result; of an update stream the caller takes the newest row of each key.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}"
    before = spark.conf.get(_PROVIDER)

    def body(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    spark.conf.set(_PROVIDER, _ROCKS_DB)  # timers and initial state need it
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(body).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last) if last is not None else rows
    return rows.drop("batch")
