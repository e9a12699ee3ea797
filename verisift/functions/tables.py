"""Helpers for whole tables: broadcasts of a checked size, results that several steps read, composed texts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import composed

BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it has at most so many rows, of which no more are looked at; else df, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held(df: DataFrame) -> DataFrame:
    """df computed once for several readers: in the checkpoint folder, if there is one, so that lost executors do no
    harm, else on local disks. release() lets go of the latter; Spark cleans the former when df is no longer used."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist(StorageLevel.DISK_ONLY)


def release(df: DataFrame) -> None:
    if df.is_cached:
        df.unpersist()


def with_composed(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns in the composed normal form, as a step of its own: it may call a UDF, which expressions over
    arrays cannot hold."""
    return df.withColumns({c: composed(c) for c in columns})


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it has fewer partitions than there are cores: files with one row group are one
    partition, however much work there is for each row. Large inputs have more partitions and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
