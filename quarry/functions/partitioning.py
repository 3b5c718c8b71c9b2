"""Partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    For inputs of a few files ahead of work that costs far more than moving rows, such as tokenizing; an input with
    partitions enough, as any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
