"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Without that setting this is an error: a folder of one machine would lose rows on a
    cluster.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def shared(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from those files; a lost executor costs a reread, not a rerun."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shares(df: DataFrame) -> int:
    """How many parts a keyed exchange of ``df`` is cut in: as many as it has partitions, so a
    part does not grow with the data, and at least the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
