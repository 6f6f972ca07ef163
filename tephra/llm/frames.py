"""DataFrame helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tephra.plans.tables import written  # noqa: F401  (the operators' too)


#: Bytes of an Arrow batch that goes to a Python worker, where the session doesn't say: buffers of it are held outside the heap.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_libc = ctypes.CDLL(None)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow() over narrow batches, after which the worker gives memory that it has freed back to the system.

    Workers outlive their tasks, so what they keep is missing elsewhere.
    """
    if df.sparkSession.conf.get(_BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(_BATCH_BYTES, str(BATCH_BYTES))

    def whole(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def release() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that depends on `seed` and the columns only; the same in SQL (see README)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def uniform_sql(seed: int, *cols: str) -> str:
    key = " || '|' || ".join([f"'{seed}'", *[f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols]])
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / {float(2**52)!r})"


def unused(df: DataFrame) -> str:
    """A prefix that no column of `df` begins with, for an operator's own columns."""
    prefix, taken = "__", [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(df: DataFrame) -> int:
    """Shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of `df` and then the fields of `ddl`."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(ddl).fields])


#: Rows of a few numbers that a broadcast may have: some tens of MB.
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(written_table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts a written table of narrow rows if its count allows that; else the join shuffles."""
    return F.broadcast(written_table) if written_table.count() <= most else written_table
