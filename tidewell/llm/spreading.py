"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores.

    Texts cost far more to work on than to move, and a file of one row group is one
    task. An input that has enough splits, as any large one, is left as it is, so what
    is ever shuffled here is less than one split a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
