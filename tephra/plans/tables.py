"""Tables in the shared folder, which cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset: a temporary folder in local mode (tests), an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tephra-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tephra-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A name below the application's folder, or below the innermost scope's."""
    return f"{_scopes[-1] if _scopes else _own_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """`df` as a table in the shared folder."""
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at its end: for work whose result is written outside of it."""
    _scopes.append(f"{_own_folder(spark)}/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete(spark, _scopes.pop())


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote; DataFrames that read them can't be used any more."""
    delete(spark, _own_folder(spark))
