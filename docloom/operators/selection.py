"""Exact order statistics of large groups by refined histograms: no group is ever sorted whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.shared import shared

#: Parts of a histogram, and candidates of a group from which they are ranked.
PARTS, FEW = 1024, 4096


def order_statistic(rows: DataFrame, key: str, value: str, rank: Column, out: str = "value_at_rank") -> DataFrame:
    """(key, n, ``out``): the value at ``rank`` - an expression of the group's size ``n``, from 1 - in the group's order.

    Each round counts the rows of every group in ``PARTS`` equal parts of the range where the value must
    lie, with partial aggregation, so what is shuffled does not grow with the rows, and
    goes on in the part that holds the rank. A group leaves when the part has one value or at most ``FEW``
    rows; only these are ranked. The limits of a part are values that occur in it, so every round
    drops at least one value and ties need no care. Null values and not-a-numbers are left out, a rank outside the group gives no row.
    """
    own = rows.select(key, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and " + key + " is not null")
    state = own.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = state.select(key, "n", rank.cast("long").alias("rank"), "low", "high").where("rank between 1 and n")
    state, done = shared(state.withColumn("m", F.col("n"))), None
    while True:
        over = state.where((F.col("low") == F.col("high")) | (F.col("m") <= FEW))
        done = over if done is None else done.unionByName(over)
        state = state.where((F.col("low") < F.col("high")) & (F.col("m") > FEW))
        if state.isEmpty():
            break
        # halves of the limits, as their difference may be too large for a double
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        part = F.least(F.lit(PARTS - 1), F.floor(share * PARTS)).cast("int")
        inside = own.join(state, key).where("v between low and high")
        counts = inside.groupBy(key, part.alias("part")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("m").over(W.partitionBy(key).orderBy("part")) - F.col("m")
        found = counts.withColumn("before", before).join(state.select(key, "n", "rank"), key).where("before < rank and rank <= before + m")
        # written, so that a lost executor costs one round
        state = shared(found.select(key, "n", (F.col("rank") - F.col("before")).alias("rank"), "low", "high", "m"))
    done = shared(done)
    one = done.where("low = high").select(key, "n", F.col("low").alias(out))
    few = own.join(done.where("low < high"), key).where("v between low and high")
    ranked = few.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy("v"))).where("k = rank")
    return one.unionByName(ranked.select(key, "n", F.col("v").alias(out)))
