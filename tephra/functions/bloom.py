"""Bloom filters as relations.

A filter is the set of (run_id, position) of its members, with double hashing from
the halves of an MD5: position i is (h1 + i * h2) mod m. The same arithmetic runs on
any SQL engine, and a filter of any size is a distributed table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.plans.log import BUFFER_BYTES, SIZE_RATIO

_LN2 = math.log(2)


def bloom_bits(n: Column, p: Column) -> Column:
    """ceil(-n ln p / ln^2 2); none for p = 1, a filter that admits everything."""
    return F.ceil(-n * F.log(p) / F.lit(_LN2 * _LN2)).cast("long")


def bloom_hashes(m: Column, n: Column) -> Column:
    return F.when(n > 0, F.ceil(m / n * F.lit(_LN2))).otherwise(0).cast("long")


def bloom_bytes(m: Column) -> Column:
    return F.ceil(m / 8).cast("long")


def size_of(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes)."""
    m = math.ceil(-n * math.log(p) / (_LN2 * _LN2)) if n and p < 1 else 0
    return m, math.ceil(m / n * _LN2) if n else 0


def level_fpr(level: Column, base: float) -> Column:
    """1 at level 0, then base, ten times more for each level, a half at most."""
    return F.when(level == 0, 1.0).otherwise(F.least(F.lit(float(base)) * F.pow(F.lit(10.0), level - 1), F.lit(0.5)))


def level_capacity(level: Column, base: int = BUFFER_BYTES) -> Column:
    return (F.lit(base) * F.pow(F.lit(float(SIZE_RATIO)), level)).cast("long")


def halves(key: Column) -> tuple[Column, Column]:
    """Two 32-bit hashes of a key (of its text, so keys must print alike on both sides)."""
    digest = F.md5(key.cast("string"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def positions(key: Column, m: int | Column, k: int | Column) -> Column:
    """The k bit positions of a key."""
    m, k = (x if isinstance(x, Column) else F.lit(x) for x in (m, k))
    h1, h2 = halves(key)
    return F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: (h1 + i.cast("long") * h2) % m)


def build(members: DataFrame, m: int, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The set bits (by run, for example): (*by, position)."""
    if not m:
        return members.select(*by, F.lit(None).cast("long").alias("position")).limit(0)
    return members.select(*by, F.explode(positions(F.col("key"), m, k)).alias("position")).distinct()


#: A filter of up to so many bits is probed as one array of bytes that every worker gets; a larger one by a join on positions.
ARRAY_BITS = 1 << 27


def packed(bits: DataFrame, m: int) -> np.ndarray:
    """The filter as bytes, on the driver; for filters of a checked size."""
    byte = F.floor(F.col("position") / 8)
    rows = bits.groupBy(byte.alias("at")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("position") % 8).cast("int")).alias("byte")).toArrow()
    out = np.zeros(-(-m // 8), np.uint8)
    out[rows.column("at").to_numpy()] = rows.column("byte").to_numpy()
    return out


def probe(keys: DataFrame, bits: DataFrame, m: int, k: int, most: int = ARRAY_BITS) -> DataFrame:
    """(key, maybe) for each distinct key: whether all its bits are set. No filter (m = 0) admits all."""
    keys = keys.select("key").distinct()
    if not m:
        return keys.withColumn("maybe", F.lit(True))
    if m <= most:
        shared = keys.sparkSession.sparkContext.broadcast(packed(bits, m))

        @F.pandas_udf("boolean")
        def held(h1: pd.Series, h2: pd.Series) -> pd.Series:
            a, b, ok = h1.to_numpy(), h2.to_numpy(), np.ones(len(h1), bool)
            for i in range(k):
                at = (a + i * b) % m
                ok &= shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            return pd.Series(ok)

        return keys.select("key", held(*halves(F.col("key"))).alias("maybe"))
    wanted = keys.select("key", F.explode(F.array_distinct(positions(F.col("key"), m, k))).alias("position"))
    met = wanted.join(bits.withColumn("set", F.lit(1)), "position", "left")
    return met.groupBy("key").agg((F.count("set") == F.count(F.lit(1))).alias("maybe"))


def confusion(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts and rates of `answers` (key, maybe) against the member keys of `truth`."""
    known = answers.join(truth.select("key").distinct().withColumn("is_member", F.lit(True)), "key", "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))
    count = lambda c: F.sum(c.cast("long"))
    sums = known.agg(
        count(F.col("maybe") & F.col("is_member")).alias("tp"),
        count(F.col("maybe") & ~F.col("is_member")).alias("fp"),
        count(~F.col("maybe") & ~F.col("is_member")).alias("tn"),
        count(~F.col("maybe") & F.col("is_member")).alias("fn"),
    )
    return sums.select("*", (F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"), (F.col("fn") / (F.col("fn") + F.col("tp"))).alias("fnr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))
