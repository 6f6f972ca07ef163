"""Sharding by sampled splitters.

Keys are sampled with a chance in proportion to record size, quantiles of the sample
become the boundaries of ranges, and ranges that come out overfull are subdivided by
their exact cumulative sizes. A record's key is its doc_id and, among equal ones, a
hash of its text, so ranges of one hot doc_id can be subdivided too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.llm.frames import documents, parts, uniform, uniform_sql, written

TARGET = 32 << 20
#: Shards that there are to be at least, for as many readers; smaller corpora have smaller shards.
LEAST = 512
#: Expected samples of a shard.
SAMPLES = 64
#: A range is overfull beyond so many times the target.
OVER = 1.25
SEED = 23


def _hash() -> Column:
    return F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _packed(known: np.ndarray, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys as strings of 17 bytes that have the keys' order."""
    out = np.empty((len(ids), 17), np.uint8)
    out[:, 0] = known
    out[:, 1:9] = (ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = h.astype(">i8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


_splitters: dict[str, np.ndarray] = {}


def _read(path: str) -> np.ndarray:
    """The sorted splitters of a written table: 17 bytes for each shard, once a worker."""
    if path not in _splitters:
        fs, base = pa.fs.FileSystem.from_uri(path)
        some = [pa.parquet.read_table(f.path, filesystem=fs) for f in fs.get_file_info(pa.fs.FileSelector(base)) if f.path.endswith(".parquet")]
        table = pa.concat_tables(some)
        ids = table.column("doc_id")
        known = ids.is_valid().to_numpy()
        _splitters.clear()
        _splitters[path] = np.sort(_packed(known, ids.fill_null(0).to_numpy(), table.column("h").to_numpy()))
    return _splitters[path]


def _find(splitters: DataFrame, h: Column) -> Column:
    """How many splitters a row's key reaches."""
    files = splitters.inputFiles()
    path = files[0].rsplit("/", 1)[0] if files else ""

    @F.pandas_udf("int")
    def find(known: pd.Series, id_: pd.Series, h: pd.Series) -> pd.Series:
        keys = _packed(known.to_numpy(), id_.to_numpy(), h.to_numpy())
        return pd.Series(np.searchsorted(_read(path), keys, "right").astype(np.int32))

    return find(F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), h) if files else F.lit(0)


def shard(docs: DataFrame, target: int = TARGET, seed: int = SEED, least: int = LEAST) -> DataFrame:
    """`docs` with `shard_id`, rows of a shard in one partition.

    Shards are ranges of (doc_id, hash of the text), numbered in that order, null
    doc_ids first. None holds more than OVER times `target` bytes of text (a null or
    empty text counts one byte) and one record more; rows that are equal in both
    doc_id and text stay together whatever their size. Where `target` would give fewer
    than `least` shards, it is the least-th part of all bytes. An empty table has no
    shards. An input column `shard_id` is replaced; others are passed through.
    """
    docs = docs.drop("shard_id")
    slim = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash().alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint") + 1).alias("size")).groupBy("doc_id", "h").agg(F.sum("size").alias("size")))
    total = slim.agg(F.sum("size")).first()[0] or 0
    size = min(target, max(1, total // max(1, least)))
    rate = F.lit(float(SAMPLES)) / F.lit(float(size))
    drawn = slim.withColumn("p", F.col("size") * rate).where(uniform(seed, F.col("doc_id"), F.col("h")) < F.col("p")).withColumn("m", F.greatest("p", F.lit(1.0)))
    # cumulative mass of the sample in key order: within ranges first, then with the ranges' offsets
    drawn = written(drawn.repartitionByRange(max(1, parts(docs) // 4), F.col("doc_id").asc_nulls_first(), "h").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "h")
    before = drawn.groupBy("part").agg(F.sum("m").alias("mass")).withColumn("off", F.coalesce(F.sum("mass").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("mass")
    upto = drawn.withColumn("in", F.sum("m").over(order)).join(before, "part").withColumn("upto", F.round(F.col("off") + F.col("in"), 3))
    steps = upto.withColumn("step", F.floor(F.col("upto") / SAMPLES)).withColumn("was", F.floor(F.round(F.col("upto") - F.col("m"), 3) / SAMPLES))
    first = written(steps.where("step > was").select("doc_id", "h"))
    ranged = slim.withColumn("range", _find(first, F.col("h")))
    full = written(ranged.groupBy("range").agg(F.sum("size").alias("all")).where(F.col("all") > OVER * size))
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "h")
    more = ranged.join(full, "range").withColumn("upto", F.sum("size").over(inside) - F.col("size")).withColumn("step", F.floor(F.col("upto") / size))
    more = more.withColumn("was", F.lag("step").over(inside)).where("step > was")
    splitters = written(first.union(more.select("doc_id", "h")).distinct())
    n = splitters.count() + 1
    out = docs.withColumn("shard_id", _find(splitters, _hash()))
    together = max(1, min(target // size, n // parts(docs)))  # neighbouring shards in one partition, of `target` bytes at most
    return out.repartitionById((n - 1) // together + 1, F.expr(f"shard_id div {together}").cast("int"))


def shard_sql(table: str = "documents", target: int = TARGET, seed: int = SEED, columns: str = "doc_id, text, lang, source, n_chars", least: int = LEAST) -> str:
    """The same in DuckDB."""
    return f"""
WITH d AS (SELECT {columns}, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h, strlen(coalesce(text, ''))::BIGINT + 1 AS size FROM {table}),
slim AS (SELECT doc_id, h, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY doc_id NULLS FIRST, h) AS rn FROM d GROUP BY doc_id, h),
t AS (SELECT least({target}, greatest(1, sum(size)::BIGINT // {max(1, least)})) AS target FROM slim),
p AS (SELECT slim.*, size * ({float(SAMPLES)!r} / (SELECT target FROM t)::DOUBLE) AS p FROM slim),
drawn AS (SELECT *, greatest(p, 1.0) AS m FROM p WHERE {uniform_sql(seed, "doc_id", "h")} < p),
cum AS (SELECT *, round(sum(m) OVER (ORDER BY rn), 3) AS upto FROM drawn),
s1 AS (SELECT rn FROM cum WHERE floor(upto / {SAMPLES}) > floor(round(upto - m, 3) / {SAMPLES})),
r AS (SELECT slim.*, (SELECT count(*) FROM s1 WHERE s1.rn <= slim.rn) AS rng FROM slim),
f AS (SELECT rng FROM r GROUP BY rng HAVING sum(size) > {OVER} * (SELECT target FROM t)),
c AS (SELECT *, floor((sum(size) OVER (PARTITION BY rng ORDER BY rn) - size) / (SELECT target FROM t)) AS step FROM r WHERE rng IN (SELECT rng FROM f)),
l AS (SELECT *, lag(step) OVER (PARTITION BY rng ORDER BY rn) AS was FROM c),
s AS (SELECT rn FROM s1 UNION SELECT rn FROM l WHERE step > was),
a AS (SELECT doc_id, h, (SELECT count(*) FROM s WHERE s.rn <= slim.rn) AS shard_id FROM slim)
SELECT {", ".join("d." + c.strip() for c in columns.split(","))}, a.shard_id::INTEGER AS shard_id FROM d JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id AND d.h = a.h"""


def query(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
