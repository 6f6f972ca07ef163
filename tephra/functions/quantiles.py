"""Exact quantiles of any number of rows, without gathering them in one task."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tephra.plans.tables import written

#: Ranks of a sketch are off by one part in so many at most; it is of that size whatever the rows' number.
ACCURACY = 100_000


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = (), accuracy: int = ACCURACY) -> DataFrame:
    """(*by, quantiles): of each group the values at the ranks ceil(share * n), as SQL's quantile_disc gives them; nulls don't count.

    A sketch gives two values between which each one lies; what is below them is counted,
    and only what lies between, a part in accuracy / 4 of the rows, is ranked. Should the
    sketch have been off by more, so that the rank isn't between, wider ones are tried.
    """
    reach, v = 2.0 / accuracy, F.col("__v")
    own = rows.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(value).alias("__v")).where(v.isNotNull())
    groups = [f"__by{i}" for i in range(len(by))]
    named = [F.col(g).alias(c) for g, c in zip(groups, by)]
    plain = own.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(v, list(shares), accuracy).alias("quantiles"))
    plain = written(plain)
    if 2 * (plain.agg(F.max("__n")).first()[0] or 0) < accuracy:  # the sketch holds all the rows
        return plain.where("__n > 0").select(*named, "quantiles")
    ranks = [f"greatest(1, (__n * {x.numerator} + {x.denominator - 1}) div {x.denominator})" for x in map(Fraction, map(str, shares))]
    while True:
        ends = own.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max"), F.percentile_approx(v, [min(max(s + d, 0.0), 1.0) for d in (-reach, reach) for s in shares], accuracy).alias("__at"))
        low = [F.col("__min") if s <= reach else F.col("__at")[i] for i, s in enumerate(shares)]
        high = [F.col("__max") if s + reach >= 1 else F.col("__at")[len(shares) + i] for i, s in enumerate(shares)]
        ends = written(ends.select(*groups, F.array(*map(F.expr, ranks)).alias("__rank"), F.array(*low).alias("__low"), F.array(*high).alias("__high")))
        other = ends.select(*[F.col(g).alias(f"{g}_") for g in groups], "__rank", "__low", "__high")
        met = own.join(F.broadcast(other), [own[g].eqNullSafe(other[f"{g}_"]) for g in groups]) if groups else own.crossJoin(F.broadcast(other))
        below = met.groupBy(*groups).agg(F.array(*[F.count(F.when(v < F.col("__low")[i], 1)) for i in range(len(shares))]).alias("__below"))
        between = met.select(*groups, v, F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: v.between(F.get("__low", i), F.get("__high", i)))).alias("__i"))
        summed = between.groupBy(*groups, "__i", v).agg(F.count(F.lit(1)).alias("__c")).withColumn("__upto", F.sum("__c").over(Window.partitionBy(*groups, "__i").orderBy("__v")))
        wanted = ends.select(*groups, "__rank").join(below, _same(ends, below, groups)) if groups else ends.select("__rank").crossJoin(below)
        wanted = wanted.select(*[ends[g] for g in groups], F.posexplode(F.arrays_zip("__rank", "__below")).alias("__i", "__both"))
        wanted = wanted.select(*[F.col(g).alias(f"{g}_") for g in groups], F.col("__i").alias("__at"), (F.col("__both.__rank") - F.col("__both.__below")).alias("__left"))
        found = wanted.join(summed, [*[wanted[f"{g}_"].eqNullSafe(summed[g]) for g in groups], (F.col("__at") == F.col("__i")) & (F.col("__left") > 0) & (F.col("__upto") >= F.col("__left"))], "left")
        found = found.groupBy(*[F.col(f"{g}_").alias(g) for g in groups], "__at").agg(F.min("__v").alias("__v")).groupBy(*groups)
        found = written(found.agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"]).alias("quantiles")))
        if found.where(F.exists("quantiles", lambda x: x.isNull())).isEmpty():
            return found.select(*named, "quantiles")
        reach *= 64


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> list:
    return [a[n].eqNullSafe(b[n]) for n in names]
