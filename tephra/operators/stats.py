"""Table, level and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.functions.bloom import level_capacity, level_fpr
from tephra.plans.log import BUFFER_BYTES, ENTRY_BYTES, L0_RUNS, LEVELS, PAGE_ROWS, SIZE_RATIO


def run_stats(log: DataFrame) -> DataFrame:
    """One row for each run: what a manifest holds."""
    return log.groupBy("level", "run_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.ceil(F.count(F.lit(1)) / PAGE_ROWS).cast("long").alias("n_pages"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        (F.count(F.lit(1)) * ENTRY_BYTES).alias("size_bytes"),
    )


def level_stats(log: DataFrame, base_fpr: float = 0.01, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """Runs, entries, deletes, bytes, target false positive rate and fullness of each level; level null is the total."""
    rolled = log.groupBy("level", "run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_deleted").cast("long")).alias("d")).rollup("level").agg(
        F.grouping("level").alias("__total"), F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_entries"), F.sum("d").alias("n_deleted")
    )
    size = F.col("n_entries") * ENTRY_BYTES
    full = F.when(F.col("level") == 0, F.col("n_runs") >= L0_RUNS).otherwise(size >= level_capacity(F.col("level"), buffer_bytes))
    return rolled.select("level", "n_runs", "n_entries", "n_deleted", size.alias("size_bytes"), F.when(F.col("__total") == 0, level_fpr(F.col("level"), base_fpr)).alias("fpr"), F.when(F.col("__total") == 0, full).alias("is_full"))


def level_state(log: DataFrame, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """is_empty, is_full and capacity of all levels, those without rows too."""
    levels = log.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    have = log.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("r"))
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0))
    capacity = level_capacity(F.col("level"), buffer_bytes)
    full = F.when(F.col("level") == 0, r >= L0_RUNS).otherwise(n * ENTRY_BYTES >= capacity)
    return levels.join(have, "level", "left").select("level", (n == 0).alias("is_empty"), full.alias("is_full"), capacity.alias("capacity_bytes"))


def buffer_state(n_rows: int, buffer_bytes: int = BUFFER_BYTES) -> dict[str, int | bool]:
    most = buffer_bytes // ENTRY_BYTES
    return {"size": n_rows, "memory_bytes": n_rows * ENTRY_BYTES, "capacity": most, "is_empty": n_rows == 0, "is_full": n_rows >= most}


def filter_stats(spark: SparkSession, levels: int = LEVELS, base_fpr: float = 0.01, base_entries: int = BUFFER_BYTES // ENTRY_BYTES) -> DataFrame:
    """Sizes of the Bloom filters that full levels need."""
    from tephra.functions.bloom import bloom_bits, bloom_bytes, bloom_hashes

    d = spark.range(levels).select(F.col("id").cast("int").alias("level"))
    d = d.withColumn("fpr", level_fpr(F.col("level"), base_fpr)).withColumn("n", F.lit(base_entries) * F.pow(F.lit(float(SIZE_RATIO)), F.col("level")).cast("long"))
    d = d.withColumn("n_bits", bloom_bits(F.col("n"), F.col("fpr")))
    return d.select("level", "n", "fpr", "n_bits", bloom_hashes(F.col("n_bits"), F.col("n")).alias("n_hashes"), bloom_bytes(F.col("n_bits")).alias("n_bytes"), level_capacity(F.col("level"), BUFFER_BYTES).alias("capacity_bytes"))
