"""Reads and writes of the log against a Python dictionary, and the contract's edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tephra.operators import reads, workloads, writes
from tephra.plans import log as L
from tephra.sources.files import generated, labelled, read_records, write_records
from tephra.sources.store import KeyValueStore


def store(spark, tmp_path, **options):
    return KeyValueStore(spark, f"file://{tmp_path}/kv", **{"buffer_rows": 1000, "auto_compact": False} | options)


def rows(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_contract(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put(42, "v")
    assert s.get(42) == "v" and s.get_from_level(42, -1) == "v" and s.level_for_key(42) == -1
    s.flush()
    assert s.get(42) == "v" and store(spark, tmp_path).get(42) == "v" and s.level_for_key(42) == 0
    s.put(1, "old")
    s.flush()
    s.put(1, "new")
    s.flush()
    assert store(spark, tmp_path).get(1) == "new"
    s.compact(0)
    assert store(spark, tmp_path).get(1) == "new" and s.level_for_key(1) == 1
    s.remove(1)
    assert s.get(1) is None and 1.0 not in rows(s.range(0, 5))
    s.flush()
    again = store(spark, tmp_path)
    assert again.get(1) is None and 1.0 not in rows(again.range(0, 5))
    s.put(1, "w")
    assert s.get(1) == "w"
    s.put(3, "__DELETED__")
    s.put(4, "")
    s.put(5, "x" * 150)
    s.put(6, "ab\0\0")
    assert [s.get(k) for k in (3, 4, 5, 6)] == ["__DELETED__", "", "x" * 150, "ab\0\0"]
    s.put(0.0, "p")
    s.put(-0.0, "m")
    assert s.get(0.0) == "m" and s.get(-0.0) == "m"
    with pytest.raises(ValueError):
        s.put(float("nan"), "x")
    for k in (-3, -1, 2):
        s.put(k, "n")
    s.flush()
    assert list(rows(s.range(-2, 3))) == [-1.0, 0.0, 1.0, 2.0, 3.0]
    assert rows(s.range(5, 1)) == {} and list(rows(s.range(2, 2))) == [2.0]
    assert {r["key"]: r["found"] for r in s.multi_get(spark.createDataFrame([(2.0,), (99.0,)], "key double")).collect()} == {2.0: True, 99.0: False}


def test_reopening_and_compaction_keep_data(spark, tmp_path):
    s = store(spark, tmp_path)
    for _ in range(6):
        s.put(random.random(), "v")
        s.flush()
    assert len(store(spark, tmp_path).runs) == 6
    s.put_all(spark.range(2000).select(F.col("id").alias("key"), F.lit("v").alias("value")))
    before = s.log().count()
    s.compact(0)
    s.compact(1)
    assert store(spark, tmp_path).log().count() == before == 2006
    assert s.vacuum() == 8 and store(spark, tmp_path).log().count() == before
    assert s.level_stats().where("level IS NULL").first()["n_entries"] == before
    other = s.mirror(f"file://{tmp_path}/other")
    assert other.same_as(s) and other.get(7) == "v"
    s.views("kv")
    assert spark.sql("SELECT count(*) FROM kv_live").first()[0] == before


@pytest.mark.parametrize("seed", range(2))
def test_against_a_dictionary(spark, tmp_path, seed):
    rng, model, s = random.Random(seed), {}, store(spark, tmp_path, l0_runs=2, auto_compact=True)
    for _ in range(12):
        for _ in range(rng.randint(1, 6)):
            k = rng.choice([-2.5, -1.0, 0.0, 1.0, 2.0, 3.5])
            if rng.random() < 0.3:
                s.remove(k)
                model.pop(k, None)
            else:
                model[k] = f"v{rng.random()}"
                s.put(k, model[k])
        step = rng.choice(["flush", "compact", "reopen", "none"])
        if step in ("flush", "reopen"):
            s.flush()
        if step == "compact":
            s.compact(rng.randint(0, 2))
        if step == "reopen":
            s = store(spark, tmp_path, l0_runs=2, auto_compact=True)
        assert rows(s.range(-10, 10)) == model
        k = rng.choice([-2.5, 0.0, 3.5])
        assert s.get(k) == model.get(k)


def test_empty_log(spark):
    log = spark.createDataFrame([], "key long, value string, seq long, is_deleted boolean")
    assert reads.get(log, 1).count() == reads.range_scan(log, 0, 9).count() == L.paged(log).count() == 0
    assert reads.multi_get(log, spark.range(2).select(F.col("id").alias("key"))).where("found").count() == 0


def test_numbering_matches_sorting(spark):
    values = [random.gauss(0, 100) for _ in range(500)]
    got = L.numbered(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()
    assert {r["x"]: r["position"] for r in got} == {v: i for i, v in enumerate(sorted(values))}
    down = L.numbered(spark.createDataFrame([(v,) for v in values], "x double"), "x", descending=True).collect()
    assert {r["x"]: r["position"] for r in down} == {v: i for i, v in enumerate(sorted(values, reverse=True))}


def test_numbering_of_long_skewed_and_null_values(spark):
    values = [2**60 + 3, 2**60 + 1, 2**60 + 2, 2**60, None, 5, 5, -(2**62), 2**62, *range(300)]
    got = sorted(L.numbered(spark.createDataFrame([(v,) for v in values], "x long"), "x").collect(), key=lambda r: r["position"])
    assert [r["x"] for r in got] == sorted(values, key=lambda v: (v is not None, v or 0)) and [r["position"] for r in got] == list(range(len(values)))
    down = sorted(L.numbered(spark.createDataFrame([(v,) for v in values], "x long"), "x", descending=True).collect(), key=lambda r: r["position"])
    assert [r["x"] for r in down] == sorted(values, key=lambda v: (v is not None, v or 0), reverse=True)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id AS key", "'v' AS value", "id AS seq", "false AS is_deleted").write.parquet(f"{tmp_path}/log")
    plan = reads.get(spark.read.parquet(f"{tmp_path}/log"), 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,5)]" in plan


def test_compaction_keeps_deletes_above_older_levels(spark):
    log = spark.createDataFrame([(1, None, 9, True, 0), (1, "a", 1, False, 2), (2, "b", 2, False, 1)], "key long, value string, seq long, is_deleted boolean, level int")
    assert rows(L.live(writes.compact(log, 0))) == {2: "b"}
    assert writes.compact(log, 1).where("is_deleted").count() == 1


def test_sources(spark, tmp_path):
    pairs = [(-1.5, "a"), (0.0, ""), (2.25, "é" * 40)]
    write_records(pairs, f"{tmp_path}/x.bin")
    assert [(r["key"], r["value"]) for r in read_records(spark, f"{tmp_path}/x.bin").collect()] == pairs
    for kind in ("uniform", "normal", "zipfian"):
        df = generated(spark, 200, kind)
        assert df.count() == 200 and df.where("key < 0 OR value <> format_string('v%.6f', key)").count() == 0
    assert labelled(spark, 10).where("value LIKE 'value-%'").count() == 10


def test_data_source_prunes_runs(spark, tmp_path):
    from tephra.sources.datasource import LogReader, LogSource

    s = store(spark, tmp_path)
    for lo in (0, 100, 200):
        s.put_all(spark.range(lo, lo + 50).select(F.col("id").alias("key"), F.lit("v").alias("value")))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
    df = spark.read.format("tephra").option("path", f"{tmp_path}/kv").load()
    assert df.count() == 150 and df.where("key BETWEEN 110 AND 120").count() == 11
    reader = LogReader(f"{tmp_path}/kv")
    from pyspark.sql.datasource import EqualTo

    assert len(list(reader.pushFilters([EqualTo(("key",), 5.0)]))) == 1
    assert {p.value.split("run_id=")[1].split("/")[0] for p in reader.partitions()} == {"1"}


def test_streams(spark, tmp_path):
    from tephra.streaming.puts import put_stream

    source = f"{tmp_path}/in"
    spark.createDataFrame([(1.0, "a", 1), (1.0, "b", 2), (2.0, "c", 3)], "key double, value string, seq long").write.parquet(source)
    s = store(spark, tmp_path)
    stream = spark.readStream.schema("key double, value string, seq long").parquet(source)
    put_stream(stream, s, f"{tmp_path}/check").awaitTermination()
    assert rows(s.range(0, 9)) == {1.0: "b", 2.0: "c"}


def test_batches_replayed_and_late(spark, tmp_path):
    s = store(spark, tmp_path)
    batch = spark.createDataFrame([(1.0, "old", 5), (2.0, "x", 6)], "key double, value string, at long")
    s.put_all(batch, "at")
    s.put(1.0, "new")
    s.put_all(batch, "at")  # again, after a failure
    assert rows(s.range(0, 9)) == {1.0: "new", 2.0: "x"}
    s.put_all(spark.createDataFrame([(2.0, "late", 3), (3.0, "y", 4)], "key double, value string, at long"), "at")
    assert rows(s.range(0, 9)) == {1.0: "new", 2.0: "x", 3.0: "y"}
    twice = spark.createDataFrame([(7.0, "a"), (7.0, "b")], "key double, value string")
    with pytest.raises(ValueError):
        s.put_all(twice)
    with pytest.raises(ValueError):
        s.put_all(spark.createDataFrame([(7.0, "a", None)], "key double, value string, at long"), "at")
    s.put_all(spark.createDataFrame([(8.0, "t")], "key double, value string").withColumn("at", F.lit("2024-01-01").cast("timestamp")), "at")
    assert s.get(8) == "t" and s.get(7) is None
    one = next(r["run_id"] for r in s.runs if r["min_key"] == 1.0)
    assert s.get_from_run(1, one) == ("old", False) and s.get_from_run(99, one) is None
    assert [r["key"] for r in s.range_from_run(0, 1.5, one).collect()] == [1.0]
    assert rows(s.range_from_level(2, 3, 0)) == {2.0: "x", 3.0: "y"}
    s.clear()
    assert s.range(-9, 99).count() == 0 and s.get(8) is None and store(spark, tmp_path).runs == []


def test_training_sets(spark):
    log = spark.range(300).selectExpr("cast(id AS double) / 3 AS key", "'v' AS value", "id AS seq", "false AS is_deleted", "cast(id % 2 AS int) AS level", "cast(id % 4 AS long) AS run_id")
    have = {r[0] for r in log.select("key").collect()}
    made = [r[0] for r in workloads.negatives(log, 2.0).collect()]
    assert made and not have & set(made)
    both = workloads.membership_set(log, 50)
    assert both.where("label = 1").count() == 100 and both.where("label = 0").count() > 0
    assert workloads.jittered(log, 3, 0.01).count() == 1200
    more = workloads.membership_set(log, 50, least=400).where("label = 1").groupBy("level").count().collect()
    assert all(r["count"] >= 100 for r in more)
    few = workloads.balanced(log, ["level"], 20, least=50)
    assert {r["level"]: r["count"] for r in few.groupBy("level").count().collect()} == {0: 50, 1: 50}
    assert not workloads.retrain_due(0, 4) and workloads.retrain_due(8, 4)
    assert workloads.page_set(L.paged(log)).columns == ["level", "key", "page_id"]


def test_console(spark, tmp_path):
    import io

    from tephra.shell import Console

    out = io.StringIO()
    console = Console(store(spark, tmp_path), stdout=out)
    say = lambda line: (out.truncate(0), out.seek(0), console.onecmd(line), out.getvalue().strip())[-2:]
    for k in range(30):
        say(f"put {k} 'value {k}'")
    say("remove 4")
    assert say("flush")[1] == "flushed" and say("flush")[1] == "nothing to flush"
    assert say("get 3")[1] == "value 3" and say("get 4")[1] == "absent"
    assert say("range 3 5")[1].splitlines() == ["3\tvalue 3", "5\tvalue 5"]
    say("compact 0")
    say("switch learned")
    assert say("get 7")[1] == "value 7" and say("get 99")[1] == "absent"
    say("switch skipping")
    assert say("get 7")[1] in ("value 7", "absent")
    assert "one of" in say("switch other")[1] and "could not convert" in say("get x")[1]
    assert "level 1: 1 runs, 29 entries" in say("stats")[1] and "put: 30 times" in say("stats")[1]
    say("reset")
    say("switch exact")
    assert say("get 7")[1] == "absent" and say("exit")[0] is True


def test_a_record_file_in_a_new_folder(spark, tmp_path):
    from tephra.sources import files

    for path in (f"{tmp_path}/new/one.bin", f"file://{tmp_path}/newer/still/two.bin"):
        files.write_records([(1.5, "a"), (-2.0, "")], path)
        assert {(r["key"], r["value"]) for r in files.read_records(spark, path).collect()} == {(1.5, "a"), (-2.0, "")}
