"""Stateful stream operators with timers and initial state: silent jobs time out, subscribers replay before they go live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom.streaming.jobs import HISTORY

_OUTCOME = "job_id long, outcome string, message string, at_us long"


class JobWatch(StatefulProcessor):
    """One job's end: its exit, a monitor error, or silence for longer than the grace.

    Kept are the time of the last sign of life and whether the job has ended. A timer of
    event time stands at the end of the grace; each event moves it. A gap that shows between
    two events is a timeout too, whether they come in one batch or in two, so the outcome does not depend on
    how events fall into batches. After its end a job's events are ignored.
    """

    def __init__(self, grace_seconds: float):
        self.grace = int(grace_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "last_us long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, done = self.state.get() if self.state.exists() else (None, False)
        if done:
            return
        end, batch = None, pd.concat(list(rows)).sort_values(["us", "seq"])
        for us, event, code, message in batch[["us", "event", "exit_code", "message"]].itertuples(index=False):
            if last is not None and us > last + self.grace:
                end = ("timeout", None, last + self.grace)
            elif event == "error":
                end = ("monitor_error", message, us)
            elif event == "exit":
                end = ("complete" if code == 0 else "failed", message, us)
            if end:
                break
            last = int(us)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.state.update((last, end is not None))
        if end:
            yield self._row(key, *end)
        else:
            self.handle.registerTimer((last + self.grace) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, done = self.state.get()
        if not done:
            self.state.update((last, True))
            yield self._row(key, "timeout", None, last + self.grace)

    def _row(self, key, outcome: str, message: str | None, us: int) -> pd.DataFrame:
        text = message if isinstance(message, str) else None
        return pd.DataFrame({"job_id": [key[0]], "outcome": [outcome], "message": pd.Series([text], dtype="object"), "at_us": [int(us)]})

    def close(self) -> None:
        pass


def job_ends(events: DataFrame, grace_seconds: float, late: str = "1 hour") -> DataFrame:
    """(job_id, outcome, message, at) of each job that ended, a stream in append mode.

    ``events`` has job_id, seq, ts, event (``exit``, ``error`` or anything else), exit_code and
    message. Events later than the watermark are dropped; a job is silent when the watermark has passed its grace.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.withColumn("us", F.unix_micros("ts")).where("job_id is not null and us is not null")
    out = rows.groupBy("job_id").transformWithStateInPandas(JobWatch(grace_seconds), _OUTCOME, "Append", "EventTime")
    return out.select("job_id", "outcome", "message", F.timestamp_micros("at_us").alias("at"))


class Replayed(StatefulProcessor):
    """A key's live events after those that its snapshot shows, in order, up to a terminal one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "last long, done boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.state.update((int(initialState["seq"].iloc[0]), bool(initialState["done"].iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, done = self.state.get() if self.state.exists() else (None, False)
        if done:
            return
        out = []
        for seq, event, terminal in pd.concat(list(rows)).sort_values("seq")[["seq", "event", "terminal"]].itertuples(index=False):
            if last is not None and seq <= last:
                continue
            out.append((key[0], int(seq), event))
            last, done = int(seq), bool(terminal)
            if done:
                break
        if out:
            self.state.update((last, done))
            yield pd.DataFrame(out, columns=["key", "seq", "event"])

    def close(self) -> None:
        pass


def snapshot(past: DataFrame, size: int = HISTORY) -> DataFrame:
    """The events that a new subscriber is shown first: each key's last ``size`` up to its first terminal one.

    ``past`` has key, seq, event and terminal.
    """
    shown = _until_terminal(past)
    newest = W.partitionBy("key").orderBy(F.desc("seq"))
    return shown.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= size).drop("_n")


def _until_terminal(past: DataFrame) -> DataFrame:
    stop = past.where("terminal").groupBy("key").agg(F.min("seq").alias("_stop"))
    return past.join(stop, "key", "left").where("_stop is null or seq <= _stop").drop("_stop")


def live_after(past: DataFrame, live: DataFrame) -> DataFrame:
    """(key, seq, event) of the stream ``live`` that come after ``past``, a stream in append mode.

    The state of each key starts from the batch table ``past``: its last number, and whether
    it is finished - then nothing more comes. Rows that both tables hold are not repeated, none between them is lost,
    and each key's rows come in order of their numbers.
    """
    start = _until_terminal(past).groupBy("key").agg(F.max("seq").alias("seq"), F.bool_or("terminal").alias("done"))
    return live.groupBy("key").transformWithStateInPandas(Replayed(), "key long, seq long, event string", "Append", "None", initialState=start.groupBy("key"))
