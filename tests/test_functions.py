import math

import pytest
from pyspark.sql import functions as F

from tephra.functions import bloom, features, sliced, values
from tephra.functions.quantiles import quantiles
from tephra.operators import evaluation, learned, pruning, reads, stats
from tephra.plans import log as L


def test_sizes():
    assert bloom.size_of(1000, 0.01) == (9586, 7)
    assert bloom.size_of(1000, 1.0) == (0, 0) and bloom.size_of(0, 0.01) == (0, 0)


def test_level_rates(spark):
    got = [r[0] for r in spark.range(7).select(bloom.level_fpr(F.col("id"), 0.01)).collect()]
    assert got == pytest.approx([1.0, 0.01, 0.1, 0.5, 0.5, 0.5, 0.5])


@pytest.mark.parametrize("p", [0.01, 0.1])
def test_filter_has_no_false_negatives(spark, p):
    members, others = spark.range(2000).select(F.col("id").alias("key")), spark.range(10000, 14000).select(F.col("id").alias("key"))
    m, k = bloom.size_of(2000, p)
    c = bloom.confusion(bloom.probe(members.union(others), bloom.build(members, m, k), m, k), members).first()
    assert c["fn"] == 0 and c["fpr"] < 2 * p
    assert bloom.probe(others, bloom.build(members, 0, 0), 0, 0).where("NOT maybe").count() == 0


def test_skip_rule(spark):
    keys = spark.range(2000).select((F.col("id") * 0.12345).alias("key"))
    for level, key in ((1, -0.5), (2, 17.123), (3, 99.999)):
        got = spark.range(1).select(values.skip_level(F.lit(key), F.lit(level))).first()[0]
        assert got == ((math.trunc(key * 1000) + level * 117) % 100 < min(40 + 3 * level, 55))
    skipped = keys.where(values.skip_level(F.col("key"), F.lit(1))).count() / 2000
    assert 0.38 < skipped < 0.48


def test_values(spark):
    texts = ["a" * 150, "é" * 60, "a" * 99 + "é", "a" * 98 + "é", "x" * 97 + "😀", "", "ab\0\0", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(values.normalize_value(F.col("t"))).collect()]
    assert got == [t if t is None else t.encode()[:100].decode("utf-8", "ignore") for t in texts]
    assert values.duration(1.5) == "1.50s" and values.duration(65) == "1m 5.0s" and values.duration(3725) == "1h 2m 5.0s"


def test_thresholds(spark):
    scores = spark.createDataFrame([(0.4, 1), (0.4, 1), (0.1, 0)], "score double, label int")
    sweep = evaluation.threshold_sweep(scores)
    assert sweep.count() == 101
    assert evaluation.best_threshold(sweep) == pytest.approx(0.4)
    assert 0.1 < evaluation.best_f1(sweep) <= 0.4
    none = evaluation.threshold_sweep(scores.limit(0))
    assert none.where("tp + fp + fn + tn > 0").count() == 0


def test_quantiles_are_exact(spark):
    keys = [(float(i * i % 7919), i % 3 if i % 3 else None) for i in range(9000)] + [(None, 1), (None, 5)]
    rows = spark.createDataFrame(keys, "key double, kind int").repartition(5)
    shares = (0.001, 0.1, 0.25, 0.5, 0.9, 1.0)

    def plain(of):
        own = sorted(k for k, kind in keys if k is not None and kind in of)
        return [own[max(1, math.ceil(round(s * len(own), 6))) - 1] for s in shares]

    for accuracy in (20, 500, 100_000):
        assert quantiles(rows, "key", shares, accuracy=accuracy).first()["quantiles"] == plain((None, 1, 2))
        assert {r["kind"]: r["quantiles"] for r in quantiles(rows, "key", shares, ("kind",), accuracy).collect()} == {k: plain((k,)) for k in (None, 1, 2)}
        assert features.key_profile(rows, accuracy)["quantiles"] == [x for s, x in zip((0.1, 0.25, 0.5, 0.75, 0.9), [*plain((None, 1, 2))[1:4], features.key_profile(rows)["quantiles"][3], plain((None, 1, 2))[4]])]
    stats = {r["kind"]: (r["n"], r["median"]) for r in evaluation.latency_stats(rows, "kind", "key", 20).collect()}
    assert stats == {5: (0, None)} | {k: (3000, plain((k,))[3]) for k in (None, 1, 2)}


def test_pages(spark):
    pages = L.paged(spark.range(200).selectExpr("id * 2 AS key", "'v' AS value", "id AS seq", "false AS is_deleted"))
    found = reads.page_of(spark.range(400).select(F.col("id").alias("key")), pages)
    assert {r["key"]: r["page_id"] for r in found.where("key % 2 = 0").collect()} == {2 * i: i // 35 for i in range(200)}
    assert reads.get_from_page(pages, 1, 70).count() == 1 and reads.get_from_page(pages, 0, 70).count() == 0
    assert [r["key"] for r in reads.range_from_page(pages, 0, 3, 9).collect()] == [4, 6, 8]


def test_pages_of_sparse_and_long_keys(spark):
    keys = [0, 1, 2, 2**40, 2**40 + 1, 2**60, 2**60 + 1, 2**60 + 2, 2**60 + 3, 2**62, -(2**61), -5]
    log = spark.createDataFrame([(k, "v", 1, False) for k in keys], "key long, value string, seq long, is_deleted boolean")
    pages = L.paged(log, 2)
    expected = {k: i // 2 for i, k in enumerate(sorted(keys))}
    assert {r["key"]: r["page_id"] for r in pages.collect()} == expected
    found = reads.page_of(log.select("key"), pages).collect()
    assert {r["key"]: r["page_id"] for r in found} == expected and len(found) == len(keys)
    assert reads.page_of(log.select("key"), pages.limit(0)).count() == 0


def test_large_filters_are_probed_by_a_join(spark):
    keys = spark.range(300).select(F.col("id").alias("key"))
    m, k = bloom.size_of(30, 0.05)
    bits = bloom.build(keys.where("key % 10 = 0"), m, k)
    as_array, as_join = (dict(bloom.probe(keys, bits, m, k, most).collect()) for most in (bloom.ARRAY_BITS, 0))
    assert as_array == as_join and all(as_array[i] for i in range(0, 300, 10)) and not all(as_array.values())


def test_pruned_reads(spark):
    log = spark.createDataFrame([(float(k), f"v{k}", s, k % 7 == 0, lev, r) for s, (k, lev, r) in enumerate([(k, lev, 10 * lev + k % 3) for lev in (2, 1, 0) for k in range(lev * 5, 90, lev + 2)])], "key double, value string, seq long, is_deleted boolean, level int, run_id long")
    keys = spark.range(-5, 120).select((F.col("id") / 1.0).alias("key"))
    runs, bits = pruning.run_filters(log)
    checks = pruning.checked(keys, runs, bits).cache()
    exact = {tuple(r) for r in reads.multi_get(log, keys).collect()}
    assert {tuple(r) for r in pruning.pruned_get(log, keys, checks).collect()} == exact
    counted = {r["level"]: r for r in pruning.read_counters(log, checks).collect()}
    assert all(r["n_missed"] == 0 and r["n_checks"] == r["by_bounds"] + r["by_filter"] + r["n_reads"] for r in counted.values())
    assert counted[1]["by_filter"] > 0 and counted[0]["by_filter"] == 0
    by_run = pruning.read_counters(log, checks, ("level", "run_id"))
    assert by_run.agg(F.sum("n_reads")).first()[0] == sum(r["n_reads"] for r in counted.values())
    filters = {n: learned.LearnedFilter(epochs=3).train(log.where(F.col("level") == n).select("key")) for n in (1, 2)}
    both = pruning.with_learned(checks, filters, {1: pruning.model_threshold(0.5, 1), 2: 0.01})
    assert {tuple(r) for r in pruning.pruned_get(log, keys, both).collect()} == exact
    assert pruning.read_counters(log, both).where("n_missed > 0").count() == 0
    assert pruning.model_threshold(0.12, 1) == 0.1 and pruning.prefilter_threshold(9) == 0.5


@pytest.mark.parametrize("kind", ["double", "long", "decimal(12,2)"])
@pytest.mark.parametrize("most", [sliced.SLICED, 60])
def test_filters_of_many_runs_at_once(spark, monkeypatch, kind, most):
    monkeypatch.setattr(sliced, "SLICED", most)  # 60: larger filters go by a join on positions
    monkeypatch.setattr(sliced, "BLOCK_BITS", 1 << 14)  # blocks of 64 runs
    log = spark.range(4000).selectExpr(f"cast(pmod(hash(id), 1500) - 100 AS {kind}) AS key", "concat('v', id) AS value", "id AS seq", "id % 7 = 0 AS is_deleted", "cast(least(2, id div 400) AS int) AS level", "id div 20 AS run_id").cache()
    keys = spark.range(-200, 1700).selectExpr(f"cast(id AS {kind}) AS key").union(spark.sql(f"SELECT cast(x AS {kind}) FROM VALUES (NULL), (3) t(x)"))
    runs, bits = pruning.run_filters(log)
    every = pruning.checked(keys, runs, bits).cache()
    made = pruning.RunFilters(log)
    assert (made.rest is not None) == (most == 60 or kind[:3] == "dec")
    checks = made.checks(keys).cache()
    assert checks.dtypes == every.dtypes and checks.count() == every.count() == 1900 * 200
    assert checks.exceptAll(every).isEmpty() and 0 < checks.where("maybe").count() < checks.where("in_bounds").count() < checks.count()
    held = made.held(keys)
    assert held.exceptAll(every.where("maybe")).isEmpty() and held.count() == log.select("key", "run_id").distinct().count()
    for by in (("level",), ("level", "run_id")):
        one, other = made.counters(keys, by), pruning.read_counters(log, every, by)
        assert one.columns == other.columns and sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, other.collect()), key=repr)
    assert made.counters(keys.limit(0)).count() == made.checks(keys.limit(0)).count() == 0
    assert pruning.pruned_get(log, keys, held).exceptAll(reads.multi_get(log, keys)).isEmpty()


def test_stats(spark):
    empty = spark.createDataFrame([], "key long, value string, seq long, is_deleted boolean, level int, run_id long")
    assert stats.level_state(empty).where("NOT is_empty").count() == 0 and stats.run_stats(empty).count() == 0
    assert stats.buffer_state(0)["is_empty"] and stats.buffer_state(10**6)["is_full"]


def test_lossy_reads_and_counters(spark):
    log = spark.createDataFrame([(1.5, "a", 1, False, 1), (2.5, "b", 2, False, 2)], "key double, value string, seq long, is_deleted boolean, level int")
    keys = log.select("key")
    assert reads.get_with(log, keys, F.col("level") == 1).where("found").count() == 1
    counted = evaluation.lookup_counters(spark.createDataFrame([(1, True, False, True, False), (1, False, True, True, True)], "level int, cache_hit boolean, bypassed boolean, expected boolean, got boolean")).first()
    assert (counted["cache_hit_rate"], counted["bypass_rate"], counted["fnr"]) == (0.5, 0.5, 0.5)


def test_learned(spark):
    members = spark.range(400).select((F.col("id") * 1.37 + 100).alias("key"))
    others = spark.range(400).select((F.col("id") * 1.37 + 100.5).alias("key"))
    made = learned.LearnedFilter(epochs=5).train(members, others)
    answers = made.probe(members.union(others))
    assert bloom.confusion(answers.select("key", "maybe"), members).first()["fn"] == 0
    assert made.size_bytes()["model"] > 0
    far = others.select((F.col("key") + 5000).alias("key"))
    rows = members.withColumn("label", F.lit(1.0)).union(far.withColumn("label", F.lit(0.0)))
    model = learned.MembershipModel(trees=2, depth=3).train(rows, mine_hard=False)
    scored = model.predict(rows)
    assert scored.where("label = 1 AND NOT maybe").count() <= 20
    best = learned.best_level({1: model}, members, 3)
    assert best.where("level = 1").count() >= 380
    log = members.selectExpr("key", "'v' AS value", "cast(1 AS long) AS seq", "false AS is_deleted", "1 AS level")
    assert learned.learned_get(log, members, {1: model}).where("found").count() >= 380
    profile = features.key_profile(members)
    score = lambda k: spark.range(1).select(features.heuristic_score(profile, F.lit(k))).first()[0]
    assert score(150.0) == pytest.approx(0.9) and score(1e9) == pytest.approx(0.05)


def test_membership_with_hard_negatives_and_files(spark, tmp_path):
    members = spark.range(600).select((F.col("id") * 2).cast("double").alias("key"), F.lit(1.0).alias("label"))
    others = spark.range(600).select((F.col("id") * 2 + 900).cast("double").alias("key"), F.lit(0.0).alias("label"))
    rows = members.unionByName(others)
    model = learned.MembershipModel(trees=2, depth=3).train(rows)
    assert model.hard > 0  # half of the others lie among the members
    model.save(spark, f"file://{tmp_path}/m")
    again = learned.MembershipModel.load(spark, f"file://{tmp_path}/m")
    assert again.threshold == model.threshold and again.predict(rows).exceptAll(model.predict(rows)).isEmpty()
    one = learned.MembershipModel(trees=2, depth=3, folds=2).train(rows, mine_hard=False)
    assert len(one.models) == 1 and one.predict(rows).where("label = 1 AND NOT maybe").count() < 60


def test_membership_of_more_rows_than_are_fitted(spark):
    rows = spark.range(6000).selectExpr("cast(id AS double) AS key", "cast(id % 2 AS double) AS label")
    model = learned.MembershipModel(trees=2, depth=2, most=3000).train(rows, mine_hard=False)
    members = rows.where("label = 1")
    assert 0 < model.threshold and model.predict(members).where("maybe").count() > 0.9 * 3000
    few = learned.MembershipModel(trees=2, depth=2).train(rows.where("key < 5"), mine_hard=False)  # none may be held out
    assert few.predict(members.where("key < 5")).where("maybe").count() == 2


def test_filter_of_more_rows_than_are_fitted(spark):
    members = spark.range(3000).selectExpr("cast(id * 2 AS double) AS key")
    others = members.selectExpr("key + 1 AS key")
    for n in (6000, 6):  # of six rows, none may be held out
        yes, no = members.where(f"key < {n}"), others.where(f"key < {n}")
        made = learned.LearnedFilter(epochs=3, most=3000).train(yes, no)
        assert 0 <= made.threshold <= 1 and made.probe(yes).where("maybe").count() == n // 2
    more = made.add(others).probe(others)
    assert more.where("maybe").count() == 3000


def test_filters_by_level(spark, tmp_path):
    log = spark.range(500).selectExpr("cast(id * 3 AS double) AS key", "concat('v', id) AS value", "id AS seq", "id % 11 = 0 AS is_deleted", "cast(id % 3 AS int) AS level", "cast(id % 3 AS long) AS run_id")
    keys = spark.range(1600).select(F.col("id").cast("double").alias("key"))
    made = learned.LevelFilters().train(log, {1: 0.9}, epochs=4)
    exact = {tuple(r) for r in reads.multi_get(log, keys).collect()}
    assert set(made.filters) == {1, 2} and made.filters[1].threshold == 0.9
    assert {tuple(r) for r in made.get(log, keys).collect()} == exact
    made.save(spark, f"file://{tmp_path}/f")
    again = learned.LevelFilters.load(spark, f"file://{tmp_path}/f")
    assert {tuple(r) for r in again.get(log, keys).collect()} == exact and again.stats(spark).count() == 2
    whole = keys.select(F.col("key").cast("long").alias("key"))  # 36 is 36.0
    assert {(float(r[0]), *r[1:]) for r in made.get(log, whole).collect()} == exact
    one = made.filters[2]
    new = spark.range(300).select((F.col("id") * 50 + 90_000).cast("double").alias("key"))
    assert one.add(new).probe(new).where("NOT maybe").count() == 0
    assert one.probe(log.where("level = 2").select("key")).where("NOT maybe").count() == 0
    grades = {r["key"]: r["grade"] for r in one.graded(keys.union(spark.createDataFrame([(1e7,)], "key double"))).collect()}
    assert grades[1e7] == 0.1 and grades[one.examples[0]] == 1.0 and all(0 <= g <= 1 for g in grades.values())
    assert learned.LearnedFilter().graded(keys).where("grade <> 0.5").count() == 0


def test_filters_of_levels_of_more_keys_than_are_fitted(spark):
    log = spark.range(3000).selectExpr("id * 2 AS key", "'v' AS value", "id AS seq", "false AS is_deleted", "cast(1 + id % 2 AS int) AS level")
    made = learned.LevelFilters().train(log, {1: 0.6}, epochs=3, most=1200)
    assert made.get(log, log.select("key")).where("found").count() == 3000


def test_page_predictor(spark):
    pages = L.paged(spark.range(300).selectExpr("id AS key", "'v' AS value", "id AS seq", "false AS is_deleted")).select(F.col("key").cast("double").alias("key"), "page_id")
    made = learned.PagePredictor(trees=5).train(pages)
    assert evaluation.page_accuracy(made.predict(pages)).first()["within_one"] > 0.95
    assert learned.PagePredictor().predict(pages).where("guess <> 0").count() == 0


def test_two_stages_of_pages(spark, tmp_path):
    rows = spark.range(9000).selectExpr("cast(pow(id, 1.4) AS double) AS key", "'v' AS value", "id AS seq", "false AS is_deleted")
    pages = L.paged(rows).select("key", "page_id").cache()
    made = learned.PagePredictor(trees=5, depth=4).train(pages)
    assert not made.classes and made.pages == 258 and made.fine.count() > 10
    fine = evaluation.page_accuracy(made.predict(pages)).first()
    coarse = evaluation.page_accuracy(made._coarse(pages)).first()
    assert fine["within_one"] > max(0.9, coarse["within_one"])
    made.save(spark, f"file://{tmp_path}/p")
    again = learned.PagePredictor.load(spark, f"file://{tmp_path}/p")
    assert again.predict(pages).exceptAll(made.predict(pages)).isEmpty()
    exact = learned.predicted_page(again, pages.select("key"), pages).cache()
    assert exact.select("key", "page_id").exceptAll(pages).isEmpty() and exact.count() == 9000
    assert exact.where("guessed").count() > 2000


def test_samples_gathered_while_writing(spark, tmp_path):
    from tephra.sources.store import KeyValueStore

    store = KeyValueStore(spark, f"file://{tmp_path}/kv", auto_compact=False)
    training = learned.OnlineTraining(spark, f"file://{tmp_path}/samples", every=2, most=200, trees=2, depth=2)
    store.listeners.append(training.after)
    for lo in (0, 100, 200):
        store.put_all(spark.range(lo, lo + 100).select(F.col("id").alias("key"), F.lit("v").alias("value")))
    store.compact(0)
    assert store.writes == 4 and training.trained == 2 and set(training.models.membership) == {0, 1}
    assert training.samples().where("label = 1").count() >= 300
    found, checked = training.models.checked_get(store.log(), spark.range(300).select(F.col("id").cast("double").alias("key")), every=2)
    counted = checked.first()
    assert found.count() == 300 and 100 < counted["checked"] < 200 and counted["missed"] <= counted["checked"] * 0.1
    assert training.models.timing(training.samples()).where("n > 0 AND micros_per_key > 0").count() == 2
    training.models.save(spark, f"file://{tmp_path}/models")
    assert set(learned.LevelModels.load(spark, f"file://{tmp_path}/models").membership) == {0, 1}


def test_training_sets_gather_no_level(spark):
    from tephra.operators import workloads

    log = spark.range(60_000).selectExpr("cast(id AS double) AS key", "cast(0 AS int) AS level")
    made = workloads.membership_set(log, 100)
    rows = made.collect()
    assert sum(r["label"] for r in rows) == 100 and not any(r["label"] == 0 and r["key"] in range(60_000) for r in rows)

    def gathered(p) -> list[int]:
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return gathered(p.executedPlan())
        if "QueryStage" in name:
            return gathered(p.plan())
        own = [p.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
        return own + [n for i in range(p.children().size()) for n in gathered(p.children().apply(i))]

    told = gathered(made._jdf.queryExecution().executedPlan())
    assert told and max(told) < 1000


def test_models_by_level(spark):
    from tephra.operators import workloads

    log = spark.range(300).selectExpr("cast(id AS double) * 1.5 AS key", "'v' AS value", "id AS seq", "false AS is_deleted", "cast(id % 2 AS int) AS level", "cast(id % 2 AS long) AS run_id")
    samples = workloads.membership_set(log, 100)
    models = learned.LevelModels().train(samples, trees=2, depth=3)
    assert set(models.membership) == {0, 1}
    assert {r["level"] for r in models.accuracy(samples).collect()} == {0, 1}
    assert models.get(log, log.select("key")).count() == 300
    best, _, names = learned.tuned(samples.where("level = 0"), folds=2)
    assert best.stages[-1].getNumTrees in (10, 20) and len(names) == 45
    answers = spark.createDataFrame([(0, None), (100, "a"), (101, None)], "op_idx long, value string")
    exact = spark.createDataFrame([(0, "x"), (100, "a"), (101, "y")], "op_idx long, value string")
    assert tuple(learned.audit(answers, exact).first()) == (2, 1)
