"""Answer feedback: windows, histograms, streaks and quality snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.selection import order_statistic

STREAK_FLAG, NEGATIVE_FLAG = 3, 5


def in_window(now: Column, days: int, system: str | None = None, area: str | None = None, time: str = "created_at") -> Column:
    """Rolling window that ends now, with optional scopes compared without case."""
    test = F.col(time) >= now - F.make_dt_interval(days=F.lit(days))
    for column, value in (("system_scope", system), ("area_scope", area)):
        if value is not None:
            test = test & (F.lower(column) == value.lower())
    return test


def totals(events: DataFrame, window: Column) -> DataFrame:
    return events.where(window).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("sentiment") == "up").alias("positive"), F.count_if(F.col("sentiment") == "down").alias("negative")
    )


def reasons(events: DataFrame, window: Column) -> DataFrame:
    """Reason codes by count, then by name."""
    return events.where(window & (F.col("reason_code") != "")).groupBy("reason_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason_code")


def negative_streaks(events: DataFrame) -> DataFrame:
    """Per answer the number of newest ``down`` events before the first other one.

    One pass per answer: an event is in the streak if it is newer than the newest event
    that is not ``down``. Two aggregations and no ranking, so a hot answer with many
    events is combined before the shuffle.
    """
    place = F.struct("created_at", "id")
    stop = events.where("sentiment <> 'down'").groupBy("answer_id").agg(F.max(place).alias("stop"))
    newer = events.where("sentiment = 'down'").join(stop, "answer_id", "left").where(F.col("stop").isNull() | (place > F.col("stop")))
    return newer.groupBy("answer_id").agg(F.count(F.lit(1)).alias("negative_streak"))


def snapshots(events: DataFrame) -> DataFrame:
    """Per answer: counts, quality in -1..1, streak, flag and last time."""
    counts = events.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("feedback_count"), F.count_if(F.col("sentiment") == "up").alias("positive_count"),
        F.count_if(F.col("sentiment") == "down").alias("negative_count"), F.max("created_at").alias("last_feedback_at"),
    )
    out = counts.join(negative_streaks(events), "answer_id", "left").fillna(0, ["negative_streak"])
    quality = F.when(F.col("feedback_count") > 0, (F.col("positive_count") - F.col("negative_count")) / F.col("feedback_count")).otherwise(0.0)
    flagged = (F.col("negative_streak") >= STREAK_FLAG) | (F.col("negative_count") >= NEGATIVE_FLAG)
    return out.withColumns({"quality_score": quality, "is_flagged": flagged})


def merged_snapshots(old: DataFrame, new: DataFrame, key: str, keep_old_if_null: list[str], replaced: list[str]) -> DataFrame:
    """Upsert: new values win, but scopes keep the old value where the new one is null."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in [*keep_old_if_null, *replaced]], F.lit(True).alias("_new"))
    out = old.join(n, key, "full")
    values = {c: F.coalesce(f"_{c}", c) for c in keep_old_if_null} | {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in replaced}
    return out.withColumns(values).select(old.columns)


def validated(requests: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Feedback requests with ``error_code``: target exists, is an answer, belongs to the conversation and to the user."""
    m = messages.select(F.col("id").alias("message_id"), F.col("role").alias("target_role"), F.col("conversation_id").alias("target_conversation"))
    c = conversations.select(F.col("id").alias("target_conversation"), F.col("user_id").alias("owner_id"))
    out = requests.join(m, "message_id", "left").join(c, "target_conversation", "left")
    error = (
        F.when(F.col("target_role").isNull(), "not_found").when(F.col("target_role") != "assistant", "not_an_answer")
        .when(F.col("target_conversation") != F.col("conversation_id"), "wrong_conversation")
        .when(~F.col("role").isin("admin", "reviewer") & ~F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False)), "forbidden")
    )
    return out.withColumn("error_code", error)


def latency(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, minimum, maximum and the value at rank round(0.95 n) per key, however many samples a key has."""
    n = samples.groupBy(key).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    rank = F.greatest(F.lit(1), F.bround(F.lit(0.95) * F.col("n")).cast("int"))
    return n.join(order_statistic(samples, key, value, rank, "p95"), key)


def moving_mean(samples: DataFrame, key: str, order: str, value: str, span: int = 20) -> DataFrame:
    w = W.partitionBy(key).orderBy(order).rowsBetween(1 - span, 0)
    return samples.withColumn("moving_mean", F.avg(value).over(w))
