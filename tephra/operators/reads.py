"""Point, batched, range and level reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.plans.log import BUFFER_LEVEL, latest, live
from tephra.plans.tables import written


def get(log: DataFrame, key) -> DataFrame:
    """(key, value) of one key; no row if it is absent or deleted. The filter reaches the scan."""
    return live(log.where(F.col("key") == F.lit(key)))


def range_scan(log: DataFrame, low, high, ordered: bool = True) -> DataFrame:
    """Live keys from low to high, both included; empty if low > high."""
    out = live(log.where(F.col("key").between(F.lit(low), F.lit(high))))
    return out.orderBy("key") if ordered else out


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) for each distinct key asked for; a null value with found = false for a miss.

    The keys semi-join the log before its versions are grouped, so only versions of
    wanted keys are shuffled for that. Whether the keys are broadcast is left to
    their size.
    """
    keys = keys.select("key").where(F.col("key").isNotNull()).distinct()
    hits = live(log.join(keys, "key", "left_semi")).withColumn("found", F.lit(True))
    return keys.join(hits, "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def get_from_level(log: DataFrame, level: int, key=None) -> DataFrame:
    """Live keys of one level taken for itself, whatever newer levels hold."""
    log = log.where(F.col("level") == level)
    return live(log if key is None else log.where(F.col("key") == F.lit(key)))


def range_from_level(log: DataFrame, level: int, low, high) -> DataFrame:
    """Live keys from low to high of one level taken for itself, in key order."""
    return range_scan(log.where(F.col("level") == level), low, high)


def get_from_run(log: DataFrame, run_id: int, key) -> DataFrame:
    """(key, value, seq, is_deleted) of a key in one run, deletes too: the run can't tell what hides it."""
    return latest(log.where((F.col("run_id") == run_id) & (F.col("key") == F.lit(key))))


def range_from_run(log: DataFrame, run_id: int, low, high) -> DataFrame:
    """The same of the keys from low to high, in key order."""
    return latest(log.where((F.col("run_id") == run_id) & F.col("key").between(F.lit(low), F.lit(high)))).orderBy("key")


def level_for_key(log: DataFrame) -> DataFrame:
    """(key, level) of the newest version of each live key; -1 is the unflushed buffer."""
    return latest(log, ("level",)).where(~F.col("is_deleted")).select("key", "level")


def fences(pages: DataFrame) -> DataFrame:
    """Least and greatest key of each page (and run)."""
    by = [c for c in ("level", "run_id", "page_id") if c in pages.columns]
    return pages.groupBy(*by).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n_rows"))


def page_of(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, page_id) of the pages whose fences hold a key.

    A range join as an equi-join on cells. Each page is listed under cells about as wide
    as itself, the least power of two that its span doesn't exceed, so under three at
    most however sparse it is; keys look up one cell for each width that occurs.
    """
    by = [c for c in ("level", "run_id", "page_id") if c in pages.columns]
    span = F.col("max_key").cast("double") - F.col("min_key").cast("double")
    width = F.when(span > 0, F.ceil(F.log2(span))).otherwise(-1).cast("int")
    cell = lambda c, w: F.floor(c.cast("double") / F.pow(F.lit(2.0), w)).cast("long")
    listed = written(fences(pages).withColumn("__width", width)).withColumn("__cell", F.explode(F.sequence(cell(F.col("min_key"), F.col("__width")), cell(F.col("max_key"), F.col("__width")))))
    widths = sorted(r[0] for r in listed.select("__width").distinct().collect())  # powers of two: a few dozen at most
    asked = keys.select("key", F.explode(F.array(*map(F.lit, widths or [0]))).alias("__width"))
    near = asked.withColumn("__cell", cell(F.col("key"), F.col("__width"))).join(listed, ["__width", "__cell"])
    return near.where(F.col("key").between(F.col("min_key"), F.col("max_key"))).select("key", *by)


def get_from_page(pages: DataFrame, page: int, key) -> DataFrame:
    """Versions of one key on one page."""
    return pages.where((F.col("page_id") == page) & (F.col("key") == F.lit(key)))


def range_from_page(pages: DataFrame, page: int, low, high) -> DataFrame:
    """Versions from low to high on one page, in key order."""
    return pages.where((F.col("page_id") == page) & F.col("key").between(F.lit(low), F.lit(high))).orderBy("key")


def prune_runs(manifest: DataFrame, low, high) -> DataFrame:
    """Runs whose key bounds meet the range: the only ones that a read must open."""
    return manifest.where((F.col("min_key") <= F.lit(high)) & (F.col("max_key") >= F.lit(low)))


def get_with(log: DataFrame, keys: DataFrame, may_hold: Column) -> DataFrame:
    """multi_get() that looks only at versions which `may_hold` admits: the lossy strategies.

    Unless `may_hold` is true of every version of a live key, keys can be missed and
    older versions returned; the exact reads don't use it.
    """
    return multi_get(log.where(may_hold), keys)


def buffer_first(buffered: DataFrame, stored: DataFrame) -> DataFrame:
    """Unflushed and stored writes as one log; the buffer is level -1."""
    return buffered.withColumn("level", F.lit(BUFFER_LEVEL)).unionByName(stored, allowMissingColumns=True)
