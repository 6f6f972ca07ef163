"""Mixing sources to target weights by Pareto order sampling.

Each source gets a whole number of copies (largest remainder of its share of the
total). Within a source a document's expected copies are in proportion to its
length. The whole part of that is certain; for the fraction p, documents are
ranked by random odds over inclusion odds, (U / (1 - U)) / (p / (1 - p)), and the
smallest are taken, as many as the source still lacks: its size is then fixed.

The cut of each source is found from a histogram of ranks, so only the rows of
one narrow bin per source are ever sorted, and texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.llm.frames import uniform, uniform_sql, unused, written

BINS = 4096
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 2.0}
SEED = 17


def _weight(weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(out)
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: int | None = None, seed: int = SEED) -> DataFrame:
    """`docs` with a column `copies` (1 or more); rows that got none are left out.

    weights: by source; other sources (a null source is one too) have
    `default_weight`. size: total copies, by default the number of rows.

    Null or empty texts count as one character long. The random number depends on
    doc_id and text alone, so repeated rows tie; a tie at the cut is broken by
    doc_id and a hash of the text, and identical rows are interchangeable, so sizes
    stay exact. An empty table gives an empty result. An input column `copies` is
    replaced; other columns are passed through.
    """
    weights = WEIGHTS if weights is None else weights
    docs = docs.drop("copies")
    kept, p = docs.columns, unused(docs)
    length = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("decimal(38,0)")
    by_source = docs.groupBy("source").agg(F.sum(length).cast("decimal(38,0)").alias(p + "mass"), F.count(F.lit(1)).alias(p + "n")).withColumn(p + "w", _weight(weights, default_weight))
    # one row a source from here on
    every = Window.partitionBy()
    total = F.lit(int(size)) if size is not None else F.sum(p + "n").over(every)
    share = by_source.where(f"{p}w > 0").withColumn(p + "share", total.cast("double") * F.col(p + "w") / F.sum(p + "w").over(every)).withColumn(p + "total", total)
    short = F.col(p + "total") - F.sum(F.floor(p + "share")).over(every)
    order = Window.partitionBy().orderBy((F.col(p + "share") - F.floor(p + "share")).desc(), F.col("source").asc_nulls_first())
    share = share.withColumn(p + "target", F.floor(p + "share") + F.when(F.row_number().over(order) <= short, 1).otherwise(0))
    share = written(share.select(F.col("source").alias(p + "source"), p + "mass", F.col(p + "target").cast("decimal(20,0)").alias(p + "target")))

    def ranked(table: DataFrame) -> DataFrame:
        d = docs.join(table, docs["source"].eqNullSafe(table[p + "source"]))
        d = d.withColumn(p + "part", length.cast("decimal(18,0)") * F.col(p + "target"))
        d = d.withColumn(p + "rest", F.expr(f"{p}part % {p}mass").cast("decimal(38,0)"))
        u, odds = uniform(seed, F.col("doc_id"), F.col("text")), F.col(p + "rest").cast("double") / F.col(p + "mass").cast("double")
        d = d.withColumn(p + "whole", F.expr(f"{p}part div {p}mass").cast("bigint")).withColumn(p + "q", F.when(F.col(p + "rest") > 0, (u / (1 - u)) / (odds / (1 - odds))))
        return d.withColumn(p + "bin", F.floor(F.col(p + "q") / (F.col(p + "q") + 1) * BINS))

    bins = ranked(share).groupBy(p + "source", p + "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(p + "rest").alias("rest"), F.first(p + "mass").alias(p + "mass"), F.first(p + "target").alias(p + "target"))
    up = Window.partitionBy(p + "source").orderBy(F.col(p + "bin").asc_nulls_last())
    bins = bins.withColumn("lack", F.expr(f"sum(rest) OVER (PARTITION BY {p}source) div {p}mass").cast("bigint")).withColumn("upto", F.sum("n").over(up)).withColumn("before", F.col("upto") - F.col("n"))
    cut = bins.groupBy(p + "source", p + "mass", p + "target").agg(
        F.min(F.when((F.col("upto") >= F.col("lack")) & F.col(p + "bin").isNotNull(), F.col(p + "bin"))).alias(p + "cut"),
        F.min_by(F.col("lack") - F.col("before"), F.when((F.col("upto") >= F.col("lack")) & F.col(p + "bin").isNotNull(), F.col(p + "bin"))).alias(p + "need"),
    )
    rows = ranked(written(cut))
    sure = rows.where(~F.coalesce(F.col(p + "bin") == F.col(p + "cut"), F.lit(False))).withColumn("copies", F.col(p + "whole") + F.coalesce((F.col(p + "bin") < F.col(p + "cut")).cast("bigint"), F.lit(0)))
    edge = Window.partitionBy(p + "source").orderBy(p + "q", F.col("doc_id").asc_nulls_first(), F.md5(F.coalesce("text", F.lit(""))))
    drawn = rows.where(F.col(p + "bin") == F.col(p + "cut")).withColumn("copies", F.col(p + "whole") + (F.row_number().over(edge) <= F.col(p + "need")).cast("bigint"))
    return sure.select(*kept, "copies").unionByName(drawn.select(*kept, "copies")).where("copies > 0")


def mix_sql(table: str = "documents", weights: dict[str, float] | None = None, default_weight: float = 1.0, seed: int = SEED, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same in DuckDB, with a full sort in place of the histogram."""
    weights = WEIGHTS if weights is None else weights
    case = " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in weights.items())
    return f"""
WITH d AS (SELECT {columns}, greatest(coalesce(length(text), 0), 1)::HUGEINT AS len, {uniform_sql(seed, "doc_id", "text")} AS u FROM {table}),
s0 AS (SELECT source, sum(len)::HUGEINT AS mass, count(*) AS n, (CASE source {case} ELSE {float(default_weight)!r} END)::DOUBLE AS w FROM d GROUP BY source),
s1 AS (SELECT source, mass, sum(n) OVER ()::DOUBLE * w / sum(w) OVER () AS share, sum(n) OVER () AS total FROM s0 WHERE w > 0),
s2 AS (SELECT source, mass, floor(share)::HUGEINT + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, source ASC NULLS FIRST) <= total - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS target FROM s1),
r AS (SELECT d.*, (len * target) // mass AS whole, (len * target) % mass AS rest, mass, ((len * target) % mass)::DOUBLE / mass::DOUBLE AS p FROM d JOIN s2 ON d.source IS NOT DISTINCT FROM s2.source),
q AS (SELECT *, CASE WHEN rest > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, sum(rest) OVER (PARTITION BY source) // mass AS lack FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q ASC NULLS LAST, doc_id ASC NULLS FIRST, md5(coalesce(text, ''))) AS rk FROM q)
SELECT {columns}, (whole + CASE WHEN rest > 0 AND rk <= lack THEN 1 ELSE 0 END)::BIGINT AS copies FROM k
WHERE whole + CASE WHEN rest > 0 AND rk <= lack THEN 1 ELSE 0 END > 0"""


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as many times as it has copies, without that column."""
    return mixed.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")
