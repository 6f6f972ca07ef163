"""The versioned log: one row for each write of a key.

Columns: key, value, seq (unique for each write of a key; the greatest wins) and
is_deleted. A table may carry level, run_id and page_id as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.plans.tables import written

ENTRY_BYTES, KEY_BYTES, VALUE_BYTES = 116, 16, 100
PAGE_BYTES = 4096
PAGE_ROWS = PAGE_BYTES // ENTRY_BYTES
BUFFER_BYTES = 1 << 20
SIZE_RATIO = 10
LEVELS = 7
L0_RUNS = 4
BUFFER_LEVEL = -1


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_key(key: Column, dtype: str) -> Column:
    """-0.0 is 0.0, and NaN isn't a key (it becomes null)."""
    if dtype in ("double", "float"):
        return F.when(~F.isnan(key), F.when(key == 0, F.lit(0.0).cast(dtype)).otherwise(key))
    return key


def as_kv(df: DataFrame, key: str | Column, value: str | Column, seq: str | Column, deleted: str | Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any table as a log. Rows with a null (or NaN) key are left out; a null `deleted` means a live write."""
    out = df.select(
        _column(key).alias("key"),
        _column(value).alias("value"),
        _column(seq).cast("long").alias("seq"),
        (F.coalesce(_column(deleted).cast("boolean"), F.lit(False)) if deleted is not None else F.lit(False)).alias("is_deleted"),
        *keep,
    )
    dtype = dict(out.dtypes)["key"]
    if dtype in ("double", "float"):
        out = out.withColumn("key", canonical_key(F.col("key"), dtype))
    return out.where(F.col("key").isNotNull())


def latest(log: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The newest version of each key, deletes included. Partial aggregation, one shuffle on key.

    Filters on key may be put before or after; a filter on anything else must come
    after, or it would bring older versions back.
    """
    newest = F.max_by(F.struct("value", "is_deleted", "seq", *extra), "seq")
    return log.groupBy("key").agg(newest.alias("v")).select("key", "v.value", "v.seq", "v.is_deleted", *[f"v.{c}" for c in extra])


def latest_by_rank(log: DataFrame) -> DataFrame:
    """The same through a ranking window, which keeps all columns."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def live(log: DataFrame) -> DataFrame:
    """(key, value) of the keys whose newest version isn't a delete."""
    return latest(log).where(~F.col("is_deleted")).select("key", "value")


def numbered(df: DataFrame, order: str, name: str = "position", descending: bool = False) -> DataFrame:
    """Global row numbers from 0 by any column that has an order, without gathering rows in one task.

    Rows are range-partitioned by sampled bounds of the column itself (so long keys stay
    exact and skewed ones spread), numbered inside each range and moved by the rows of
    the ranges before; only the ranges' counts are ordered in one place. The ranges are
    a written table, since sampled bounds can differ from one run to the next. Rows of a
    null `order` come first, or last if descending; the order of equal ones is open.
    """
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    placed = written(df.repartitionByRange(by).withColumn("__range", F.spark_partition_id()))
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__range").orderBy(by)
    return placed.withColumn("__inner", F.row_number().over(inner) - 1).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__inner")).drop("__range", "__inner", "__before")


def paged(log: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """The log with the page of each row in key order; within each run if there is a run_id."""
    if "run_id" in log.columns:
        runs = [c for c in ("level", "run_id") if c in log.columns]
        position = F.row_number().over(Window.partitionBy(*runs).orderBy("key")) - 1
        return log.withColumn("page_id", F.floor(position / rows).cast("long"))
    return numbered(log, "key", "__position").withColumn("page_id", F.floor(F.col("__position") / rows).cast("long")).drop("__position")


def levelled(log: DataFrame, run_rows: int = 100, l0_runs: int = L0_RUNS, l1_runs: int = 10) -> DataFrame:
    """Runs of `run_rows` writes by age: the newest in level 0, then level 1, the rest in level 2."""
    aged = numbered(log, "seq", "__age", descending=True).withColumn("run_id", F.floor(F.col("__age") / run_rows).cast("long")).drop("__age")
    level = F.when(F.col("run_id") < l0_runs, 0).when(F.col("run_id") < l0_runs + l1_runs, 1).otherwise(2)
    return aged.withColumn("level", level)
