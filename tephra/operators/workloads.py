"""Lookup workloads and training sets, deterministic in a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from an MD5 of the seed and the columns."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def draw_sql(seed: int, *cols: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in cols]])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / {float(2**52)!r})"


def apart(candidates: DataFrame, existing: DataFrame, least: float = 1e-4) -> DataFrame:
    """Candidates (key, ...) at a distance of `least` or more from every existing key.

    A range anti-join on cells as wide as the distance: a near key is in the same
    cell or in one beside it.
    """
    cell = F.floor(F.col("key") / F.lit(float(least))).cast("long")
    near = existing.select(F.col("key").alias("__other")).distinct().select("__other", F.explode(F.array(*[F.floor(F.col("__other") / F.lit(float(least))).cast("long") + d for d in (-1, 0, 1)])).alias("__cell"))
    listed = candidates.withColumn("__cell", cell)
    condition = (listed["__cell"] == near["__cell"]) & (F.abs(listed["key"] - near["__other"]) < F.lit(least))
    return listed.join(near, condition, "left_anti").drop("__cell")


def random_lookups(log: DataFrame, misses: DataFrame, n: int = 100, hit_share: float = 0.8, per_run: int = 50, seed: int = 42) -> DataFrame:
    """(op_idx, key, level): hits from at most `per_run` keys of each run and misses (level -1), shuffled."""
    hits = int(n * hit_share)
    u = draw(seed, F.col("level"), F.col("run_id"), F.col("key"))
    ranked = log.select("level", "run_id", "key").distinct().withColumn("u", u).withColumn("r", F.row_number().over(Window.partitionBy("level", "run_id").orderBy("u", "key")))
    some = ranked.where(F.col("r") <= per_run).orderBy("u", "key").limit(hits).select("key", "level")
    return _shuffled(some, misses, n - hits, seed)


def sequential_lookups(log: DataFrame, misses: DataFrame, start: int, n: int = 100, hit_share: float = 0.8) -> DataFrame:
    """(op_idx, key, level) in key order: the live keys at ranks start, start + 1, ... and evenly spaced misses."""
    from tephra.plans.log import numbered

    hits = int(n * hit_share)
    keys = numbered(log.groupBy("key").agg(F.max_by("level", "seq").alias("level")), "key", "position")
    some = keys.where(F.col("position").between(start, start + hits - 1)).select("key", "level")
    spaced = numbered(misses.select("key").distinct(), "key", "position")
    step = F.greatest(F.lit(1), F.floor(F.lit(spaced.count() / max(n - hits, 1))))
    none = spaced.where(F.col("position") % step == 0).orderBy("key").limit(n - hits).select("key", F.lit(-1).alias("level"))
    both = some.withColumn("level", F.col("level").cast("int")).unionByName(none)
    return both.withColumn("op_idx", F.row_number().over(Window.partitionBy().orderBy("key")) - 1).select("op_idx", "key", "level")


def level_lookups(log: DataFrame, level: int, misses: DataFrame, n: int = 100, hit_share: float = 0.8, seed: int = 42) -> DataFrame:
    """(op_idx, key, level): hits from one level."""
    hits = int(n * hit_share)
    some = log.where(F.col("level") == level).select("key", "level").distinct().withColumn("u", draw(seed, F.col("key"))).orderBy("u", "key").limit(hits).select("key", "level")
    return _shuffled(some, misses, n - hits, seed)


def _shuffled(hits: DataFrame, misses: DataFrame, n: int, seed: int) -> DataFrame:
    none = misses.select("key").distinct().withColumn("u", draw(seed + 1, F.col("key"))).orderBy("u", "key").limit(n).select("key", F.lit(-1).alias("level"))
    both = hits.select("key", F.col("level").cast("int").alias("level")).unionByName(none)
    # n rows, a parameter: one task numbers them
    return both.withColumn("op_idx", F.row_number().over(Window.partitionBy().orderBy(draw(seed + 2, F.col("key"), F.col("level")), "key")) - 1).select("op_idx", "key", "level")


def deletions(log: DataFrame, n: int, pattern: str = "random", recent_from: float | None = None, seed: int = 42) -> DataFrame:
    """n keys to delete: any, or those from `recent_from` on."""
    keys = log.select("key").distinct()
    if pattern == "recent":
        keys = keys.where(F.col("key") >= F.lit(recent_from))
    return keys.withColumn("u", draw(seed, F.col("key"))).orderBy("u", "key").limit(n).select("key")


def negatives(keys: DataFrame, ratio: float = 1.0, margin: float = 0.1, seed: int = 7) -> DataFrame:
    """Keys that don't exist: a quarter below, a quarter above the range, the rest among the keys.

    One candidate or several are made for each existing key, so the work is spread as
    the keys are; those that exist are taken out by an anti-join.
    """
    keys = keys.select(F.col("key").cast("double").alias("key")).distinct()
    bounds = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    many = keys.crossJoin(F.broadcast(bounds)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(int(-(-ratio // 1))))))
    many = many.where(draw(seed, F.col("key"), F.col("i")) < F.lit(ratio / (int(-(-ratio // 1)) + 1)))
    kind, u = draw(seed + 1, F.col("key"), F.col("i")), draw(seed + 2, F.col("key"), F.col("i"))
    span = (F.col("hi") - F.col("lo")) * margin + 1e-9
    made = F.when(kind < 0.25, F.col("lo") - span * u).when(kind < 0.5, F.col("hi") + span * u).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * u)
    return many.select(made.alias("key")).distinct().join(keys, "key", "left_anti")


def membership_set(log: DataFrame, most: int = 10_000, ratio: float = 1.0, margin: float = 0.1, seed: int = 7, least: int = 0) -> DataFrame:
    """(level, key, label) of each level: at most `most` of its keys, and keys that it lacks.

    A level of fewer than `least` keys gets moved copies of them as well, by a thousandth
    of its range at most.
    """
    levels = [r[0] for r in log.select("level").distinct().orderBy("level").collect()]
    out = None
    for level in levels:
        own = log.where(F.col("level") == level).select(F.col("key").cast("double").alias("key")).distinct()
        yes = own.withColumn("u", draw(seed, F.col("key"))).orderBy("u", "key").limit(most).select("key")
        made = negatives(yes, ratio, margin, seed)
        there = own.join(made, "key", "left_semi")  # few, as the made ones are: the level's keys are never what a join gathers
        no = made.join(there, "key", "left_anti").select("key", F.lit(0.0).alias("label"))
        n, lo, hi = own.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first() if least else (0, 0, 0)
        if 0 < n < least:
            yes = jittered(yes, -(-least // n) - 1, (hi - lo) / 1000, seed)
        both = yes.withColumn("label", F.lit(1.0)).unionByName(no).select(F.lit(level).cast("int").alias("level"), "key", "label")
        out = both if out is None else out.unionByName(both)
    return out


def page_set(pages: DataFrame) -> DataFrame:
    """(level, key, page_id), labelled on the full order of each run."""
    level = F.col("level").cast("int") if "level" in pages.columns else F.lit(0)
    return pages.select(level.alias("level"), F.col("key").cast("double").alias("key"), "page_id")


def jittered(keys: DataFrame, copies: int, width: float, seed: int = 7) -> DataFrame:
    """Each key and `copies` slightly moved copies, for runs that are too small."""
    more = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("i"))
    return more.select(F.when(F.col("i") == 0, F.col("key")).otherwise(F.col("key") + (draw(seed, F.col("key"), F.col("i")) - 0.5) * 2 * width).alias("key"))


#: Parts of the unit interval in which a class's drawn numbers are counted first.
BINS = 1 << 14


def balanced(rows: DataFrame, by: list[str], most: int, least: int = 0, seed: int = 7, identity: str = "key") -> DataFrame:
    """At most `most` rows of each class, drawn by hash; small classes are repeated up to `least`.

    Counts in bins of the drawn numbers tell up to which bin a class's `most` least ones
    lie, so only those and the rest of one bin are ranked, however large the class is.
    """
    bin_ = F.floor(F.col("__u") * BINS).cast("int")
    drawn = rows.withColumn("__u", draw(seed, F.col(identity)))
    upto = Window.partitionBy(*by).orderBy("__b")
    counts = drawn.groupBy(*by, bin_.alias("__b")).agg(F.count(F.lit(1)).alias("__c")).withColumn("__upto", F.sum("__c").over(upto))
    # a class has as many rows as its last bin's sum says
    cut = counts.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("__upto") >= most, F.col("__b"))), F.lit(BINS)).alias("__cut"), F.max("__upto").alias("__n"))
    named = cut.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__cut", "__n")
    same = [drawn[c].eqNullSafe(named[f"__by{i}"]) for i, c in enumerate(by)]
    near = drawn.join(named, same).where(bin_ <= F.col("__cut"))
    some = near.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__u", identity))).where(F.col("__r") <= most)
    if least:
        n = F.least("__n", F.lit(most))
        extra = F.when(n < least, F.floor(F.lit(least) / n) + (F.col("__r") <= F.lit(least) % n).cast("int")).otherwise(1)
        some = some.withColumn("__copy", F.explode(F.sequence(F.lit(1), extra.cast("int"))))
    return some.select(*rows.columns)


def retrain_due(events: int, every: int) -> bool:
    """Whether a table that has been flushed or compacted so many times is to be trained now."""
    return events > 0 and events % every == 0
