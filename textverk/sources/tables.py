"""Parquet scans with column pruning and enough parallelism for CPU-heavy stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str, factor: int = 1) -> DataFrame:
    """Redistribute by ``keys`` only where the scan has fewer splits than there are cores.

    A file with one row group is one task, however many cores wait. Over many files
    the scan is left as it is, so large inputs pay no shuffle for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * factor, *keys)
