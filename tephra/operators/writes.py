"""Writes, deletes, merges and compactions as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.plans.log import latest


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with `rows` (key, value, and seq greater than the log's) written."""
    new = rows.select(F.col("key").cast(log.schema["key"].dataType).alias("key"), "value", F.col("seq").cast("long").alias("seq"), F.lit(False).alias("is_deleted"))
    return log.unionByName(new, allowMissingColumns=True)


def remove(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with deletes of `keys` (key, seq) written."""
    new = keys.select(F.col("key").cast(log.schema["key"].dataType).alias("key"), F.lit(None).cast(log.schema["value"].dataType).alias("value"), F.col("seq").cast("long").alias("seq"), F.lit(True).alias("is_deleted"))
    return log.unionByName(new, allowMissingColumns=True)


def drop_from_buffer(buffered: DataFrame, key) -> DataFrame:
    """The unflushed rows without a key: as if it had not been written since the last flush."""
    return buffered.where(F.col("key") != F.lit(key))


def merge(older: DataFrame, newer: DataFrame) -> DataFrame:
    """One version of each key of two logs, the one of greater seq; deletes are kept."""
    columns = ["key", "value", "seq", "is_deleted"]
    return latest(older.select(*columns).unionByName(newer.select(*columns))).select(*columns)


def compact(log: DataFrame, level: int, bottom: bool | None = None) -> DataFrame:
    """The log after merging `level` into the next: at most one version of a key in both together.

    Deletes are dropped only if no level below the target holds rows (`bottom`; found
    out if None), since they must go on hiding older versions.
    """
    columns = ["key", "value", "seq", "is_deleted"]
    if bottom is None:
        bottom = log.where(F.col("level") > level + 1).isEmpty()
    part = latest(log.where(F.col("level").isin(level, level + 1)))
    if bottom:
        part = part.where(~F.col("is_deleted"))
    merged = part.select(*columns, F.lit(level + 1).alias("level"))
    rest = log.where(~F.col("level").isin(level, level + 1)).select(*columns, F.col("level").cast("int").alias("level"))
    return rest.unionByName(merged)
