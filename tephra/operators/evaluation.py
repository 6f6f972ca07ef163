"""Comparing strategies: presence, error rates, thresholds, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.functions.quantiles import ACCURACY, quantiles


def compared(truth: DataFrame, other: DataFrame) -> DataFrame:
    """(op_idx, level, expected, got, same_value) of two result sets (op_idx, level, value)."""
    t, o = truth.select("op_idx", "level", F.col("value").alias("a")), other.select("op_idx", F.col("value").alias("b"))
    both = t.join(o, "op_idx", "left")
    return both.select("op_idx", "level", F.col("a").isNotNull().alias("expected"), F.col("b").isNotNull().alias("got"), F.col("a").eqNullSafe(F.col("b")).alias("same_value"))


def error_rates(pairs: DataFrame) -> DataFrame:
    """Confusion counts, accuracy and false negative rate of each level; level null is the total."""
    count = lambda c: F.sum(c.cast("long"))
    sums = pairs.rollup("level").agg(
        F.count(F.lit(1)).alias("n"),
        count(F.col("expected") & F.col("got")).alias("tp"),
        count(~F.col("expected") & ~F.col("got")).alias("tn"),
        count(F.col("expected") & ~F.col("got")).alias("fn"),
        count(~F.col("expected") & F.col("got")).alias("fp"),
    )
    return sums.select("*", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), (F.col("fn") / F.nullif(F.col("fn") + F.col("tp"), F.lit(0))).alias("fnr"))


def threshold_sweep(scores: DataFrame, steps: int = 100) -> DataFrame:
    """(threshold, tp, fp, fn, tn) at 0, 1/steps, ..., 1 from (score, label).

    Scores are counted once by the greatest step that they reach; sums over that
    small histogram give all thresholds.
    """
    bins = scores.groupBy(F.floor(F.round(F.col("score") * steps, 9)).cast("int").alias("b")).agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") != 1).cast("long")).alias("n"))
    grid = scores.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    met = grid.crossJoin(F.broadcast(bins)).groupBy("step").agg(*[F.coalesce(F.sum(F.when(F.col("b") >= F.col("step") if over else F.col("b") < F.col("step"), F.col(c))), F.lit(0)).alias(a) for a, c, over in (("tp", "p", True), ("fp", "n", True), ("fn", "p", False), ("tn", "n", False))])
    return met.select((F.col("step") / F.lit(steps)).alias("threshold"), "tp", "fp", "fn", "tn")


def best_threshold(sweep: DataFrame, recall: float = 0.98) -> float | None:
    """The greatest threshold with that recall; else the one of the greatest recall. The whole range counts. None of no scores."""
    rows = sweep.select("threshold", (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("r")).collect()
    good = [t for t, r in rows if (r or 0) >= recall]
    return max(good) if good else max(rows, key=lambda x: (x[1] or 0, x[0]))[0] if rows else None


def best_f1(sweep: DataFrame) -> float | None:
    """The threshold of the best F1, 0 of no members. None of no scores."""
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return sweep.agg(F.max_by("threshold", F.coalesce(f1, F.lit(0.0)))).first()[0]


def latency_stats(timed: DataFrame, by: str, value: str, accuracy: int = ACCURACY) -> DataFrame:
    """Mean, median, deviation and extremes for each kind. The median is a value that occurs, exact. accuracy: of a sketch that finds it."""
    sums = timed.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.min(value).alias("min"), F.max(value).alias("max"))
    middle = quantiles(timed, value, (0.5,), (by,), accuracy).select(F.col(by).alias("__by"), F.col("quantiles")[0].alias("median"))
    return sums.join(middle, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "n", "mean", "median", "stdev", "min", "max")


def speedups(stats: DataFrame, by: str, baseline: str) -> DataFrame:
    """Baseline mean over each kind's mean."""
    base = stats.where(F.col(by) == baseline).select(F.col("mean").alias("__base"))
    return stats.crossJoin(F.broadcast(base)).select(by, (F.col("__base") / F.col("mean")).alias("speedup"))


def page_accuracy(predicted: DataFrame) -> DataFrame:
    """Parts of exact and of off-by-one-at-most predictions from (page_id, guess)."""
    away = F.abs(F.col("page_id") - F.col("guess"))
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.avg((away == 0).cast("double")).alias("exact"), F.avg((away <= 1).cast("double")).alias("within_one"))


def lookup_counters(events: DataFrame) -> DataFrame:
    """Cache hit, bypass and false negative rates from (level, cache_hit, bypassed, expected, got)."""
    rate = lambda c: F.avg(c.cast("double"))
    return events.groupBy("level").agg(F.count(F.lit(1)).alias("n"), rate(F.col("cache_hit")).alias("cache_hit_rate"), rate(F.col("bypassed")).alias("bypass_rate"), (F.sum((F.col("expected") & ~F.col("got")).cast("long")) / F.nullif(F.sum(F.col("expected").cast("long")), F.lit(0))).alias("fnr"))
