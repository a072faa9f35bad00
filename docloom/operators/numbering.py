"""A running number over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.sources.shared import shared, shares


def numbered_rows(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``rows`` with ``name``, their number by the columns of ``order``, which name one row.

    Rows are range-partitioned and written; the parts' counts - one row a part - give
    each part its first number, and ranks inside a part do the rest.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    cut = shared(rows.repartitionByRange(shares(rows), *keys).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_m").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_m")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    k = F.row_number().over(W.partitionBy("_part").orderBy(*keys))
    return cut.withColumn("_k", k).join(first, "_part").withColumn(name, F.col("_before") + F.col("_k") + (start - 1)).drop("_part", "_k", "_before")


def running_total(rows: DataFrame, order: str, n: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``n`` over the rows before by ``order``; range parts and their sums, as in ``numbered_rows``."""
    key = F.col(order).asc_nulls_first()
    cut = shared(rows.repartitionByRange(shares(rows), key).withColumn("_part", F.spark_partition_id()))
    above = F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = cut.groupBy("_part").agg(F.sum(n).alias("_s")).select("_part", F.coalesce(above, F.lit(0)).alias("_above"))
    inside = F.coalesce(F.sum(n).over(W.partitionBy("_part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_inside", inside).join(first, "_part").withColumn(name, F.col("_above") + F.col("_inside")).drop("_part", "_inside", "_above")
