"""The query catalog over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.functions import bloom, features, values
from tephra.operators import evaluation, reads, stats, workloads, writes
from tephra.plans import log as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.as_kv(table(spark, sf_dir, "events"), "user_id", "value", "event_id", F.col("event_type") == "error")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.as_kv(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", "o_orderkey")


def leveled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.levelled(events_log(spark, sf_dir))


_LOG = "SELECT user_id AS key, value, event_id AS seq, event_type = 'error' AS is_deleted FROM events"
_LATEST = f"SELECT key, arg_max(value, seq) AS value, arg_max(is_deleted, seq) AS is_deleted, max(seq) AS seq FROM ({_LOG}) GROUP BY key"
_LIVE = f"SELECT key, value FROM ({_LATEST}) WHERE NOT is_deleted"
_LEVELED = f"SELECT *, CASE WHEN run_id < 4 THEN 0 WHEN run_id < 14 THEN 1 ELSE 2 END AS level FROM (SELECT *, (row_number() OVER (ORDER BY seq DESC) - 1) // 100 AS run_id FROM ({_LOG}))"
_PAGES = "SELECT o_orderkey AS key, o_orderpriority AS value, (row_number() OVER (ORDER BY o_orderkey) - 1) // 35 AS page_id FROM orders"
_FENCES = f"SELECT page_id, min(key) AS min_key, max(key) AS max_key, count(*) AS n_rows FROM ({_PAGES}) GROUP BY page_id"


@query("kv_latest", _LIVE)
def kv_latest(spark, d):
    return L.live(events_log(spark, d))


@query("kv_latest_rn", f"SELECT key, value, seq, is_deleted FROM ({_LATEST})")
def kv_latest_rn(spark, d):
    return L.latest_by_rank(events_log(spark, d))


@query("kv_get", f"SELECT * FROM ({_LIVE}) WHERE key = 7")
def kv_get(spark, d):
    return reads.get(events_log(spark, d), 7)


@query("kv_range", f"SELECT * FROM ({_LIVE}) WHERE key BETWEEN 3 AND 12")
def kv_range(spark, d):
    return reads.range_scan(events_log(spark, d), 3, 12)


@query("kv_multi_get", f"SELECT k.key, l.value, l.key IS NOT NULL AS found FROM (SELECT DISTINCT c_custkey AS key FROM customer) k LEFT JOIN ({_LIVE}) l ON k.key = l.key")
def kv_multi_get(spark, d):
    return reads.multi_get(events_log(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


@query("kv_remove", f"SELECT key, value FROM ({_LIVE}) WHERE key % 5 <> 0")
def kv_remove(spark, d):
    log = events_log(spark, d)
    gone = log.where("key % 5 = 0").select("key", (F.col("seq") + 1_000_000_000).alias("seq"))
    return L.live(writes.remove(log, gone))


@query("kv_put", f"SELECT key, CASE WHEN key % 3 = 0 THEN -1.0 ELSE value END AS value FROM (SELECT * FROM ({_LIVE}) WHERE key % 3 <> 0 UNION ALL SELECT DISTINCT key, 0.0 FROM ({_LOG}) WHERE key % 3 = 0)")
def kv_put(spark, d):
    log = events_log(spark, d)
    new = log.where("key % 3 = 0").select("key").distinct().select("key", F.lit(-1.0).alias("value"), F.lit(1_000_000_000).alias("seq"))
    return L.live(writes.put(log, new))


@query("kv_merge", f"SELECT key, value, seq, is_deleted FROM ({_LATEST})")
def kv_merge(spark, d):
    log = events_log(spark, d)
    return writes.merge(log.where("seq % 2 = 0"), log.where("seq % 2 = 1"))


@query("kv_level_stats", f"""
WITH r AS (SELECT level, run_id, count(*) AS n, sum(is_deleted::BIGINT) AS d FROM ({_LEVELED}) GROUP BY ALL)
SELECT level, count(*) AS n_runs, sum(n)::BIGINT AS n_entries, sum(d)::BIGINT AS n_deleted, (sum(n) * 116)::BIGINT AS size_bytes,
  CASE WHEN grouping(level) = 0 THEN CASE WHEN level = 0 THEN 1.0 ELSE least(0.01 * pow(10.0, level - 1), 0.5) END END AS fpr,
  CASE WHEN grouping(level) = 0 THEN CASE WHEN level = 0 THEN count(*) >= 4 ELSE sum(n) * 116 >= 1048576 * pow(10.0, level) END END AS is_full
FROM r GROUP BY ROLLUP (level)""")
def kv_level_stats(spark, d):
    return stats.level_stats(leveled_events(spark, d))


@query("kv_run_stats", f"""SELECT level, run_id, count(*) AS n_rows, ceil(count(*) / 35)::BIGINT AS n_pages, min(key) AS min_key, max(key) AS max_key,
min(seq) AS min_seq, max(seq) AS max_seq, count(*) * 116 AS size_bytes FROM ({_LEVELED}) GROUP BY level, run_id""")
def kv_run_stats(spark, d):
    return stats.run_stats(leveled_events(spark, d))


@query("kv_level_state", f"""
WITH h AS (SELECT level, count(*) AS n, count(DISTINCT run_id) AS r FROM ({_LEVELED}) GROUP BY level)
SELECT l.level::INTEGER AS level, coalesce(n, 0) = 0 AS is_empty, CASE WHEN l.level = 0 THEN coalesce(r, 0) >= 4 ELSE coalesce(n, 0) * 116 >= 1048576 * pow(10, l.level) END AS is_full, (1048576 * pow(10, l.level))::BIGINT AS capacity_bytes
FROM range(7) l(level) LEFT JOIN h ON l.level = h.level""")
def kv_level_state(spark, d):
    return stats.level_state(leveled_events(spark, d))


@query("kv_level_for_key", f"SELECT key, level FROM (SELECT key, arg_max(level, seq) AS level, arg_max(is_deleted, seq) AS x FROM ({_LEVELED}) GROUP BY key) WHERE NOT x")
def kv_level_for_key(spark, d):
    return reads.level_for_key(leveled_events(spark, d))


@query("kv_get_from_level", f"SELECT key, value FROM (SELECT key, arg_max(value, seq) AS value, arg_max(is_deleted, seq) AS x FROM ({_LEVELED}) WHERE level = 1 GROUP BY key) WHERE NOT x")
def kv_get_from_level(spark, d):
    return reads.get_from_level(leveled_events(spark, d), 1)


@query("kv_prune_runs", f"SELECT run_id FROM (SELECT level, run_id, min(seq) AS lo, max(seq) AS hi FROM ({_LEVELED}) GROUP BY ALL) WHERE lo <= 500 AND hi >= 120")
def kv_prune_runs(spark, d):
    manifest = stats.run_stats(leveled_events(spark, d)).select("run_id", F.col("min_seq").alias("min_key"), F.col("max_seq").alias("max_key"))
    return reads.prune_runs(manifest, 120, 500).select("run_id")


@query("kv_fences", _FENCES)
def kv_fences(spark, d):
    return reads.fences(L.paged(orders_log(spark, d)))


@query("kv_page_lookup", f"SELECT key, page_id FROM ({_PAGES}) WHERE key % 7 = 0")
def kv_page_lookup(spark, d):
    pages = L.paged(orders_log(spark, d))
    return reads.page_of(orders_log(spark, d).where("key % 7 = 0"), pages)


@query("kv_page_range", f"SELECT key, value FROM ({_PAGES}) WHERE page_id = 3 AND key BETWEEN 0 AND 1000000")
def kv_page_range(spark, d):
    return reads.range_from_page(L.paged(orders_log(spark, d)), 3, 0, 1_000_000).select("key", "value")


_BLOOM = """
s AS (SELECT count(*) AS n, ceil(-count(*) * ln(0.01) / (ln(2) * ln(2)))::BIGINT AS m FROM orders WHERE o_orderkey % 10 = 0),
h AS (SELECT o_orderkey AS key, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 8))::BIGINT AS h2 FROM orders),
p AS (SELECT key, (h1 + i * h2) % m AS position FROM h, s, range(7) r(i)),
b AS (SELECT DISTINCT position FROM p WHERE key % 10 = 0),
a AS (SELECT p.key, bool_and(b.position IS NOT NULL) AS maybe FROM p LEFT JOIN b ON p.position = b.position GROUP BY p.key)"""


def _bloom(spark, d):
    keys = orders_log(spark, d)
    members = keys.where("key % 10 = 0")
    m, k = bloom.size_of(members.count(), 0.01)
    return bloom.probe(keys, bloom.build(members, m, k), m, k), members


@query("kv_bloom_probe", f"WITH {_BLOOM} SELECT key, maybe FROM a")
def kv_bloom_probe(spark, d):
    return _bloom(spark, d)[0]


@query("kv_bloom_fpr", f"""WITH {_BLOOM},
c AS (SELECT sum((maybe AND key % 10 = 0)::BIGINT)::BIGINT AS tp, sum((maybe AND key % 10 <> 0)::BIGINT)::BIGINT AS fp, sum((NOT maybe AND key % 10 <> 0)::BIGINT)::BIGINT AS tn, sum((NOT maybe AND key % 10 = 0)::BIGINT)::BIGINT AS fn FROM a)
SELECT *, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c""")
def kv_bloom_fpr(spark, d):
    return bloom.confusion(*_bloom(spark, d))


@query("kv_bloom_sizing", """
WITH l AS (SELECT level::INTEGER AS level, (9039 * pow(10, level))::BIGINT AS n, CASE WHEN level = 0 THEN 1.0 ELSE least(0.01 * pow(10.0, level - 1), 0.5) END AS fpr FROM range(7) r(level)),
b AS (SELECT *, ceil(-n * ln(fpr) / (ln(2) * ln(2)))::BIGINT AS n_bits FROM l)
SELECT level, n, fpr, n_bits, ceil(n_bits / n * ln(2))::BIGINT AS n_hashes, ceil(n_bits / 8)::BIGINT AS n_bytes, (1048576 * pow(10, level))::BIGINT AS capacity_bytes FROM b""")
def kv_bloom_sizing(spark, d):
    return stats.filter_stats(spark)


_SKIP = "(CAST(trunc(key * 1000) AS BIGINT) + level * 117) % 100 < least({} + 3 * level, 55)"
_FRAC = "SELECT o_totalprice / 7 AS key, o_orderkey AS seq FROM orders"


@query("kv_level_skip", f"SELECT level::INTEGER AS level, count(*) AS n, sum(({_SKIP.format(40)})::BIGINT)::BIGINT AS skipped, sum(({_SKIP.format(45)})::BIGINT)::BIGINT AS skipped_without_model FROM ({_FRAC}), range(1, 4) r(level) GROUP BY level")
def kv_level_skip(spark, d):
    keys = table(spark, d, "orders").select((F.col("o_totalprice") / 7).alias("key"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("level"))
    count = lambda model: F.sum(values.skip_level(F.col("key"), F.col("level"), model).cast("long"))
    return keys.groupBy("level").agg(F.count(F.lit(1)).alias("n"), count(True).alias("skipped"), count(False).alias("skipped_without_model"))


@query("kv_compact", f"""
WITH l AS ({_LEVELED}), m AS (SELECT key, arg_max(value, seq) AS value, max(seq) AS seq, arg_max(is_deleted, seq) AS is_deleted FROM l WHERE level IN (0, 1) GROUP BY key)
SELECT key, value, seq, is_deleted, 1 AS level FROM m UNION ALL SELECT key, value, seq, is_deleted, level FROM l WHERE level NOT IN (0, 1)""")
def kv_compact(spark, d):
    return writes.compact(leveled_events(spark, d), 0, bottom=False)


@query("kv_compact_invariant", _LIVE)
def kv_compact_invariant(spark, d):
    return L.live(writes.compact(writes.compact(leveled_events(spark, d), 0, bottom=False), 1, bottom=True))


@query("kv_workload", f"""
WITH k AS (SELECT DISTINCT level, run_id, key FROM ({_LEVELED})), u AS (SELECT *, {workloads.draw_sql(42, "level", "run_id", "key")} AS u FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY level, run_id ORDER BY u, key) AS r FROM u),
h AS (SELECT key, level FROM r WHERE r <= 50 ORDER BY u, key LIMIT 80),
m AS (SELECT key, -1 AS level FROM (SELECT DISTINCT -c_custkey AS key FROM customer) ORDER BY {workloads.draw_sql(43, "key")}, key LIMIT 20),
b AS (SELECT key, level FROM h UNION ALL SELECT key, level FROM m)
SELECT row_number() OVER (ORDER BY {workloads.draw_sql(44, "key", "level")}, key) - 1 AS op_idx, key, level FROM b""")
def kv_workload(spark, d):
    misses = table(spark, d, "customer").select((-F.col("c_custkey")).alias("key"))
    return workloads.random_lookups(leveled_events(spark, d), misses)


@query("kv_workload_sequential", f"""
WITH k AS (SELECT key, arg_max(level, seq) AS level, row_number() OVER (ORDER BY key) - 1 AS p FROM ({_LEVELED}) GROUP BY key),
m AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT -c_custkey AS key FROM customer)),
h AS (SELECT key, -1 AS level FROM m WHERE p % greatest(1, floor(n / 4)) = 0 ORDER BY key LIMIT 4),
b AS (SELECT key, level FROM k WHERE p BETWEEN 2 AND 17 UNION ALL SELECT * FROM h)
SELECT row_number() OVER (ORDER BY key) - 1 AS op_idx, key, level FROM b""")
def kv_workload_sequential(spark, d):
    misses = table(spark, d, "customer").select((-F.col("c_custkey")).alias("key"))
    return workloads.sequential_lookups(leveled_events(spark, d), misses, 2, 20)


@query("kv_workload_level", f"""
WITH h AS (SELECT key, 1 AS level FROM (SELECT DISTINCT key FROM ({_LEVELED}) WHERE level = 1) ORDER BY {workloads.draw_sql(42, "key")}, key LIMIT 80),
m AS (SELECT key, -1 AS level FROM (SELECT DISTINCT -c_custkey AS key FROM customer) ORDER BY {workloads.draw_sql(43, "key")}, key LIMIT 20),
b AS (SELECT * FROM h UNION ALL SELECT * FROM m)
SELECT row_number() OVER (ORDER BY {workloads.draw_sql(44, "key", "level")}, key) - 1 AS op_idx, key, level FROM b""")
def kv_workload_level(spark, d):
    misses = table(spark, d, "customer").select((-F.col("c_custkey")).alias("key"))
    return workloads.level_lookups(leveled_events(spark, d), 1, misses)


@query("kv_deletions", f"SELECT key FROM (SELECT DISTINCT key FROM ({_LOG})) WHERE key >= 5 ORDER BY {workloads.draw_sql(42, 'key')}, key LIMIT 6")
def kv_deletions(spark, d):
    return workloads.deletions(events_log(spark, d), 6, "recent", 5)


_NEAR = "SELECT o_totalprice + ((o_orderkey * 7919) % 1000) / 10.0 AS key, o_orderkey AS id FROM orders WHERE o_orderkey % 50 = 0"


@query("kv_near_miss", f"WITH c AS ({_NEAR}) SELECT id, key FROM c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE abs(c.key - o.o_totalprice) < 1)")
def kv_near_miss(spark, d):
    orders = table(spark, d, "orders")
    made = orders.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + (F.col("o_orderkey") * 7919 % 1000) / F.lit(10.0)).alias("key"))
    return workloads.apart(made, orders.select(F.col("o_totalprice").alias("key")), 1.0)


_KEYS = "SELECT DISTINCT o_custkey::DOUBLE AS key FROM orders"


@query("kv_negatives", f"""
WITH k AS ({_KEYS}), b AS (SELECT min(key) AS lo, max(key) AS hi FROM k), c AS (SELECT k.key, lo, hi, i FROM k, b, range(2) r(i)),
m AS (SELECT *, {workloads.draw_sql(8, "key", "i")} AS kind, {workloads.draw_sql(9, "key", "i")} AS u FROM c WHERE {workloads.draw_sql(7, "key", "i")} < 0.5)
SELECT DISTINCT round(x, 6) AS key FROM (SELECT CASE WHEN kind < 0.25 THEN lo - ((hi - lo) * 0.1 + 1e-9) * u WHEN kind < 0.5 THEN hi + ((hi - lo) * 0.1 + 1e-9) * u ELSE lo + (hi - lo) * u END AS x FROM m) WHERE x NOT IN (SELECT key FROM k)""")
def kv_negatives(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return workloads.negatives(keys).select(F.round("key", 6).alias("key")).distinct()


@query("kv_balance", f"SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {workloads.draw_sql(7, 'event_id')}, event_id) AS r FROM events) WHERE r <= 50")
def kv_balance(spark, d):
    return workloads.balanced(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], 50, identity="event_id")


@query("kv_features", """
WITH p AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_disc(o_totalprice, 0.1) AS q10, quantile_disc(o_totalprice, 0.25) AS q25, quantile_disc(o_totalprice, 0.5) AS q50, quantile_disc(o_totalprice, 0.75) AS q75, quantile_disc(o_totalprice, 0.9) AS q90 FROM orders)
SELECT o_orderkey AS id, round((o_totalprice - lo) / (hi - lo), 6) AS place, round(ln(1 + o_totalprice), 6) AS log_key, round(ln(1 + abs(hi - o_totalprice)), 6) AS log_to_max,
round((o_totalprice - q10) / (hi - lo), 6) AS from_q10, round((o_totalprice - q50) / (hi - lo), 6) AS from_q50, (o_totalprice >= q90)::DOUBLE AS above_q90, (o_totalprice >= q25 AND o_totalprice < q50)::DOUBLE AS q25_to_q50 FROM orders, p""")
def kv_features(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("key"))
    f = rows.select("id", *features.membership_features(features.key_profile(rows)))
    return f.select("id", F.round("f1", 6).alias("place"), F.round("f2", 6).alias("log_key"), F.round("f3", 6).alias("log_to_max"), F.round("f4", 6).alias("from_q10"), F.round("f6", 6).alias("from_q50"), F.col("f14").alias("above_q90"), F.col("f11").alias("q25_to_q50"))


_SCORES = "SELECT (event_id * 7919 % 1000) / 1000.0 AS score, (value > 50)::INTEGER AS label FROM events"


@query("kv_threshold_sweep", f"""
WITH s AS ({_SCORES}), t AS (SELECT i FROM range(101) r(i))
SELECT i / 100.0::DOUBLE AS threshold, sum((floor(round(score * 100, 9)) >= i AND label = 1)::BIGINT)::BIGINT AS tp, sum((floor(round(score * 100, 9)) >= i AND label = 0)::BIGINT)::BIGINT AS fp, sum((floor(round(score * 100, 9)) < i AND label = 1)::BIGINT)::BIGINT AS fn, sum((floor(round(score * 100, 9)) < i AND label = 0)::BIGINT)::BIGINT AS tn FROM s, t GROUP BY i""")
def kv_threshold_sweep(spark, d):
    e = table(spark, d, "events").select(((F.col("event_id") * 7919 % 1000) / F.lit(1000.0)).alias("score"), (F.col("value") > 50).cast("int").alias("label"))
    return evaluation.threshold_sweep(e)


_FNR = f"""
WITH t AS (SELECT seq AS op_idx, (1 + seq % 3)::INTEGER AS level, key FROM ({_FRAC})),
c AS (SELECT level, (op_idx % 5 <> 0) AS expected, (op_idx % 5 <> 0 AND NOT {_SKIP.format(40)}) AS got FROM t)
SELECT level, count(*) AS n, sum((expected AND got)::BIGINT)::BIGINT AS tp, sum((NOT expected AND NOT got)::BIGINT)::BIGINT AS tn, sum((expected AND NOT got)::BIGINT)::BIGINT AS fn, sum((NOT expected AND got)::BIGINT)::BIGINT AS fp,
(sum((expected AND got)::BIGINT) + sum((NOT expected AND NOT got)::BIGINT)) / count(*) AS accuracy, sum((expected AND NOT got)::BIGINT) / nullif(sum(expected::BIGINT), 0) AS fnr FROM c GROUP BY ROLLUP (level)"""


@query("kv_fnr_by_level", _FNR)
def kv_fnr_by_level(spark, d):
    ops = table(spark, d, "orders").select(F.col("o_orderkey").alias("op_idx"), (1 + F.col("o_orderkey") % 3).cast("int").alias("level"), (F.col("o_totalprice") / 7).alias("key"))
    there = F.when(F.col("op_idx") % 5 != 0, F.lit("v"))
    truth = ops.select("op_idx", "level", there.alias("value"))
    lossy = ops.select("op_idx", "level", F.when(~values.skip_level(F.col("key"), F.col("level")), there).alias("value"))
    return evaluation.error_rates(evaluation.compared(truth, lossy))


@query("kv_latency_stats", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS stdev, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type")
def kv_latency_stats(spark, d):
    out = evaluation.latency_stats(table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev", "min", "max")])


@query("kv_speedups", "WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY event_type) SELECT event_type, round((SELECT mean FROM m WHERE event_type = 'view') / mean, 6) AS speedup FROM m")
def kv_speedups(spark, d):
    s = evaluation.latency_stats(table(spark, d, "events"), "event_type", "value")
    return evaluation.speedups(s, "event_type", "view").select("event_type", F.round("speedup", 6).alias("speedup"))


_INTERP = f"""
WITH p AS ({_PAGES}), b AS (SELECT min(key)::DOUBLE AS lo, max(key)::DOUBLE AS hi, max(page_id) + 1 AS n FROM p),
g AS (SELECT page_id, least(greatest(floor((key - lo) / (hi - lo) * n), 0), n - 1)::BIGINT AS guess FROM p, b)"""


@query("kv_page_interp", f"{_INTERP} SELECT count(*) AS n, avg((page_id = guess)::DOUBLE) AS exact, avg((abs(page_id - guess) <= 1)::DOUBLE) AS within_one FROM g")
def kv_page_interp(spark, d):
    pages = L.paged(orders_log(spark, d))
    bounds = pages.agg(F.min("key").cast("double").alias("lo"), F.max("key").cast("double").alias("hi"), (F.max("page_id") + 1).alias("n"))
    guess = values.interpolated_page(F.col("key"), F.col("lo"), F.col("hi"), F.col("n"))
    return evaluation.page_accuracy(pages.crossJoin(F.broadcast(bounds)).select("page_id", guess.alias("guess")))


@query("kv_format_value", "SELECT o_orderkey AS key, printf('v%.6f', o_totalprice / 7) AS value FROM orders")
def kv_format_value(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), values.format_value(F.col("o_totalprice") / 7).alias("value"))


@query("kv_normalize_value", "SELECT doc_id, CASE WHEN strlen(text) <= 100 THEN text ELSE (SELECT max(left(text, n::INTEGER)) FROM (SELECT max(n) AS n FROM range(1, 101) r(n) WHERE strlen(left(text, n::INTEGER)) <= 100)) END AS value FROM documents")
def kv_normalize_value(spark, d):
    return table(spark, d, "documents").select("doc_id", values.normalize_value(F.col("text")).alias("value"))


from tephra import store_queries  # noqa: E402, F401  (registers the rest of the catalog)
