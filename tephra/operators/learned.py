"""Learned membership filters and page predictors on MLlib.

All of them can be wrong about a key except LearnedFilter, whose backup filter holds
exactly the members that its model rejects: it has no false negatives. Exact reads
never consult any of them.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.functions import bloom, features
from tephra.operators import evaluation, reads
from tephra.operators.workloads import balanced, draw, membership_set, negatives, retrain_due
from tephra.plans.tables import written

CLASS_PAGES = 100
FINE_ROWS = 50
COARSE_PAGES = 10
#: Pages whose bounds are features of a page predictor.
BOUNDARIES = 64


def _save_json(spark, path: str, what: dict) -> None:
    spark.createDataFrame([(json.dumps(what),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")


def _load_json(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/parameters").first()[0])


def _featured(rows: DataFrame, columns) -> DataFrame:
    named = rows.select("*", *columns)
    return named, [c for c in named.columns if c not in rows.columns]


def split(rows: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, by a hash of the key, so alike in each class."""
    u = draw(seed, F.col("key"))
    return rows.where(u < share), rows.where(u >= share)


@dataclass
class MembershipModel:
    """Ensemble of boosted trees, a forest and slower boosted trees; the greatest of their scores counts.

    most: rows that it is fitted and tuned on, half of each class at most, drawn by hash.
    folds: if not 0, one forest that cross-validation chooses, in place of the ensemble.
    """

    trees: int = 20
    depth: int = 4
    recall: float = 0.98
    seed: int = 42
    most: int = 100_000
    folds: int = 0
    profile: dict = field(default_factory=dict)
    threshold: float = 0.0
    models: list[PipelineModel] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    hard: int = 0

    def train(self, rows: DataFrame, mine_hard: bool = True) -> "MembershipModel":
        """rows: (key, label) with label 1.0 for members.

        Three parts by a hash of the key: most to fit, some where non-members that score
        high are looked for and fitted again, and the rest, on which the threshold has the
        wanted recall (that on the fitted rows, if so few rows leave no rest). That hash is another
        than the one that draws `most` rows, which are the least by theirs.
        """
        rows = balanced(rows.select("key", "label"), ["label"], self.most // 2, seed=self.seed)
        self.profile = features.key_profile(rows.where("label = 1"))
        u = draw(self.seed + 1, F.col("key"))
        fit, mined, held = rows.where(u < 0.7).cache(), rows.where((u >= 0.7) & (u < 0.8)), rows.where(u >= 0.8)
        counts = dict(fit.groupBy("label").count().collect())
        weight = 5.0 * counts.get(0.0, 1) / max(counts.get(1.0, 1), 1)
        self._fit(fit, weight)
        if mine_hard:
            hard = self.score(mined).where((F.col("label") == 0) & (F.col("score") > 0.3)).select("key", "label").cache()
            self.hard = hard.count()
            if self.hard:
                self._fit(fit.unionByName(hard), weight)
            hard.unpersist()
        found = evaluation.best_threshold(evaluation.threshold_sweep(self.score(held)), self.recall)
        self.threshold = evaluation.best_threshold(evaluation.threshold_sweep(self.score(fit)), self.recall) if found is None else found
        fit.unpersist()
        return self

    def _fit(self, rows: DataFrame, weight: float) -> None:
        named, self.names = _featured(rows, features.membership_features(self.profile))
        named = named.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
        if self.folds:
            self.models = [tuned(rows, self.folds, self.seed, self.profile)[0]]
            return
        kinds = [
            GBTClassifier(maxIter=self.trees, maxDepth=self.depth, seed=self.seed, weightCol="weight"),
            RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth + 4, seed=self.seed, weightCol="weight"),
            GBTClassifier(maxIter=self.trees, maxDepth=self.depth, stepSize=0.05, seed=self.seed + 1, weightCol="weight"),
        ]
        self.models = [Pipeline(stages=[VectorAssembler(inputCols=self.names, outputCol="features"), k]).fit(named) for k in kinds]

    def score(self, rows: DataFrame) -> DataFrame:
        """`rows` with a score in 0..1; 1 if there is no model."""
        if not self.models:
            return rows.withColumn("score", F.lit(1.0))
        kept = rows.columns
        out, _ = _featured(rows, features.membership_features(self.profile))
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumn(f"__s{i}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        return out.select(*kept, F.array_max(F.array(*[F.col(f"__s{i}") for i in range(len(self.models))])).alias("score"))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.score(rows).withColumn("maybe", F.col("score") >= self.threshold)

    def save(self, spark: SparkSession, path: str) -> None:
        """Models, profile and threshold."""
        for i, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/model={i}")
        _save_json(spark, path, {"profile": self.profile, "threshold": self.threshold, "models": len(self.models), "names": self.names, "recall": self.recall})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "MembershipModel":
        p = _load_json(spark, path)
        return cls(recall=p["recall"], profile=p["profile"], threshold=p["threshold"], names=p["names"], models=[PipelineModel.load(f"{path}/model={i}") for i in range(p["models"])])


def best_level(models: dict[int, MembershipModel], keys: DataFrame, levels: int, untrained: float = 0.1) -> DataFrame:
    """(key, level, score): the level whose model scores each key highest."""
    out = keys.select("key").distinct()
    for level in range(levels):
        if level in models:
            out = models[level].score(out).withColumnRenamed("score", f"__l{level}")
        else:
            out = out.withColumn(f"__l{level}", F.lit(untrained))
    all_ = F.array(*[F.struct(F.col(f"__l{n}").alias("score"), F.lit(-n).alias("order")) for n in range(levels)])
    best = F.array_max(all_)
    return out.select("key", (-best["order"]).alias("level"), best["score"].alias("score"))


@dataclass
class LearnedFilter:
    """A small network and a Bloom filter of the members that it rejects. most: rows that the network is fitted on."""

    epochs: int = 60
    fpr: float = 0.1
    seed: int = 42
    most: int = 100_000
    threshold: float = 0.5
    profile: dict = field(default_factory=dict)
    key_type: str = "double"  # of the members, which the backup's hashes depend on
    examples: list[float] = field(default_factory=list)
    model: PipelineModel | None = None
    backup: DataFrame | None = None
    m: int = 0
    k: int = 0

    def train(self, members: DataFrame, others: DataFrame | None = None, threshold: float | None = None) -> "LearnedFilter":
        """The threshold has the best F1 on held-out rows (on the fitted ones, if so few rows leave none), unless it is given;
        then every member is scored and the rejected ones go to the backup. Without `others`, keys that aren't members are made
        up in and about their range. Rows are held out by another hash than the one that draws `most`, which are the least by theirs."""
        members = members.select("key").distinct()
        self.key_type = dict(members.dtypes)["key"]
        others = negatives(members, seed=self.seed) if others is None else others
        self.profile = features.key_profile(members)
        if self.profile["lo"] is None:  # no members: untrained, it admits everything
            return self
        self.examples = [float(r[0]) for r in members.orderBy(draw(self.seed, F.col("key"))).limit(100).collect()]
        rows = members.withColumn("label", F.lit(1.0)).unionByName(others.select("key").distinct().withColumn("label", F.lit(0.0)))
        fit, held = split(balanced(rows, ["label"], self.most // 2, seed=self.seed), seed=self.seed + 1)
        named, names = _featured(fit, features.filter_features(self.profile, self.examples))
        stages = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), MultilayerPerceptronClassifier(layers=[len(names), 64, 32, 2], maxIter=self.epochs, seed=self.seed)]
        self.model = Pipeline(stages=stages).fit(named)
        for some in (held, fit) if threshold is None else ():
            if (threshold := evaluation.best_f1(evaluation.threshold_sweep(self.score(some)))) is not None:
                break
        self.threshold = threshold
        missed = self.rejected(members)
        self.m, self.k = bloom.size_of(missed.count(), self.fpr)
        self.backup = written(bloom.build(missed, self.m, self.k)) if self.m else None
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn("score", F.lit(0.5))
        kept = rows.columns
        named, _ = _featured(rows, features.filter_features(self.profile, self.examples))
        return self.model.transform(named).select(*kept, vector_to_array("probability")[1].alias("score"))

    def rejected(self, members: DataFrame) -> DataFrame:
        """Keys that the model alone doesn't admit."""
        return self.score(members).where(F.col("score") < self.threshold).select("key")

    def add(self, members: DataFrame) -> "LearnedFilter":
        """Takes new members in: those that the model rejects go to the backup, which keeps its size; the range widens."""
        members = members.select(F.col("key").cast(self.key_type).alias("key")).distinct()
        if self.model is None:
            return self
        missed = self.rejected(members)
        if not self.m:
            self.m, self.k = bloom.size_of(missed.count(), self.fpr)
        if self.m:
            bits = bloom.build(missed, self.m, self.k)
            self.backup = written(bits if self.backup is None else self.backup.unionByName(bits).distinct())
        return self

    def probe(self, keys: DataFrame, threshold: float | None = None) -> DataFrame:
        """(key, score, maybe): the model's score reaches the threshold, or the backup admits the key.

        The trained threshold is the greatest that loses no member; a lesser one admits more.
        """
        scored = self.score(keys.select("key").distinct())
        if self.model is None:
            return scored.withColumn("maybe", F.lit(True))
        scored = scored.withColumn("__own", F.col("key").try_cast(self.key_type))
        sure = F.col("score") >= (self.threshold if threshold is None else min(threshold, self.threshold))
        if self.backup is None:
            return scored.select("key", "score", sure.alias("maybe"))
        second = self._backed(scored.where(~sure))
        return scored.join(second, "__own", "left").select("key", "score", (sure | F.coalesce("__backup", F.lit(False))).alias("maybe"))

    def _backed(self, asked: DataFrame) -> DataFrame:
        """(__own, __backup) of the keys, as members are typed: 36 and 36.0 are one key, but hash apart."""
        return bloom.probe(asked.select(F.col("__own").alias("key")).where(F.col("key").isNotNull()), self.backup, self.m, self.k).select(F.col("key").alias("__own"), F.col("maybe").alias("__backup"))

    def graded(self, keys: DataFrame) -> DataFrame:
        """(key, grade): 1 for an example, .1 out of range, a clear score itself, else .7 at least with the backup and .3 at
        most without; .5 untrained. A grade, not an answer: unlike probe() it may be low for a member."""
        asked = keys.select("key").distinct()
        if self.model is None:
            return asked.withColumn("grade", F.lit(0.5))
        scored = self.score(asked).withColumn("__own", F.col("key").try_cast(self.key_type))
        scored = scored.join(self._backed(scored), "__own", "left") if self.backup is not None else scored.withColumn("__backup", F.lit(False))
        x, score = F.col("key").cast("double"), F.col("score")
        grade = F.when(x.isin(self.examples), 1.0).when(~x.between(self.profile["lo"], self.profile["hi"]), 0.1)
        grade = grade.when((score > 0.9) | (score < 0.1), score).when(F.coalesce("__backup", F.lit(False)), F.greatest(score, F.lit(0.7))).otherwise(F.least(score, F.lit(0.3)))
        return scored.select("key", grade.alias("grade"))

    def size_bytes(self) -> dict[str, int]:
        """Weights as 4-byte floats, the examples, and the backup's bits."""
        weights = self.model.stages[-1].weights.size * 4 if self.model else 0
        return {"model": weights, "examples": 8 * len(self.examples), "backup": -(-self.m // 8)}

    def save(self, spark: SparkSession, path: str) -> None:
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        if self.backup is not None:
            self.backup.write.mode("overwrite").parquet(f"{path}/backup")
        _save_json(spark, path, {"profile": self.profile, "threshold": self.threshold, "examples": self.examples, "m": self.m, "k": self.k, "fpr": self.fpr, "key_type": self.key_type, "trained": self.model is not None, "backup": self.backup is not None})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LearnedFilter":
        p = _load_json(spark, path)
        model = PipelineModel.load(f"{path}/model") if p["trained"] else None
        backup = spark.read.parquet(f"{path}/backup") if p["backup"] else None
        return cls(fpr=p["fpr"], threshold=p["threshold"], key_type=p["key_type"], profile=p["profile"], examples=p["examples"], model=model, backup=backup, m=p["m"], k=p["k"])


@dataclass
class LevelFilters:
    """A learned filter for each level but 0: training, reads, statistics and files."""

    filters: dict[int, LearnedFilter] = field(default_factory=dict)

    def train(self, log: DataFrame, thresholds: dict[int, float] | None = None, **options) -> "LevelFilters":
        """thresholds: by level; the others' are chosen on held-out rows."""
        for (level,) in log.where("level > 0").select("level").distinct().orderBy("level").collect():
            members = log.where(F.col("level") == level).select("key")
            self.filters[level] = LearnedFilter(**options).train(members, threshold=(thresholds or {}).get(level))
        return self

    def get(self, log: DataFrame, keys: DataFrame) -> DataFrame:
        """multi_get() of which each level reads only what its filter admits. No filter loses a member, so it is exact."""
        keys = keys.select("key").distinct()
        out = log.where(~F.col("level").isin(list(self.filters)))
        for level, learned in self.filters.items():
            admitted = learned.probe(keys).where("maybe").select("key")
            out = out.unionByName(log.where(F.col("level") == level).join(admitted, "key", "left_semi").select(log.columns))
        return reads.multi_get(out, keys)

    def stats(self, spark: SparkSession) -> DataFrame:
        """(level, threshold, model_bytes, backup_bytes, example_bytes)."""
        rows = [(n, float(f.threshold), s["model"], s["backup"], s["examples"]) for n, f in self.filters.items() for s in [f.size_bytes()]]
        return spark.createDataFrame(rows, "level int, threshold double, model_bytes long, backup_bytes long, example_bytes long")

    def save(self, spark: SparkSession, path: str) -> None:
        for n, f in self.filters.items():
            f.save(spark, f"{path}/level={n}")
        _save_json(spark, path, {"levels": [*self.filters]})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LevelFilters":
        return cls({n: LearnedFilter.load(spark, f"{path}/level={n}") for n in _load_json(spark, path)["levels"]})


@dataclass
class PagePredictor:
    """Page of a key in a sorted run: classes if there are few pages, else regression, coarse and then fine.

    The fine stage is a line of its own for each ten pages that the coarse one guesses, by least
    squares over all rows that it sends there: one aggregation, however many lines.
    most: rows that the coarse stage is fitted on, as many of each page.
    """

    seed: int = 42
    trees: int = 20
    depth: int = 5
    most: int = 30_000
    boundaries: int = BOUNDARIES
    profile: dict = field(default_factory=dict)
    fences: list = field(default_factory=list)
    pages: int = 0
    coarse: PipelineModel | None = None
    fine: DataFrame | None = None
    classes: bool = False

    def _named(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        return _featured(rows, [*features.page_features(self.profile, self.pages), *features.boundary_features(self.fences)])

    def train(self, rows: DataFrame, hierarchical: bool = True) -> "PagePredictor":
        """rows: (key, page_id), labelled on the run's full order. Small pages' rows are repeated, up to 300 times a page."""
        n, self.pages = rows.agg(F.countDistinct("page_id"), F.coalesce(F.max("page_id"), F.lit(0)) + 1).first()
        if not n:
            return self
        self.profile = features.key_profile(rows)
        step = -(-self.pages // self.boundaries)
        bounds = reads.fences(rows.select("key", "page_id").where(F.col("page_id") % step == 0)).orderBy("page_id").collect()
        self.fences = [(float(r["min_key"]), float(r["max_key"])) for r in bounds]
        each = max(1, self.most // n)
        some = balanced(rows.select("key", "page_id"), ["page_id"], each, least=max(1, min(300, each // 2)), seed=self.seed)
        named, names = self._named(some)
        named = named.withColumn("label", F.col("page_id").cast("double")).cache()
        self.classes = 2 <= n <= CLASS_PAGES
        assembler = VectorAssembler(inputCols=names, outputCol="features")
        kind = RandomForestClassifier(numTrees=self.trees, maxDepth=10, seed=self.seed) if self.classes else GBTRegressor(maxIter=self.trees, maxDepth=self.depth, seed=self.seed)
        self.coarse = Pipeline(stages=[assembler, kind]).fit(named)
        named.unpersist()
        if hierarchical and not self.classes:
            x, y = F.col("key").cast("double") - self.profile["lo"], F.col("page_id").cast("double")
            lines = self._coarse(rows.select("key", "page_id")).groupBy(F.floor(F.col("guess") / COARSE_PAGES).alias("__cell"))
            lines = lines.agg(F.regr_slope(y, x).alias("__slope"), F.regr_intercept(y, x).alias("__base"), F.count(F.lit(1)).alias("__rows"))
            self.fine = written(lines.where((F.col("__rows") >= FINE_ROWS) & F.col("__slope").isNotNull()))
        return self

    def _clamped(self, page: Column) -> Column:
        return F.least(F.greatest(F.round(page), F.lit(0)), F.lit(self.pages - 1)).cast("long")

    def _coarse(self, rows: DataFrame) -> DataFrame:
        named, _ = self._named(rows)
        return self.coarse.transform(named).select(*rows.columns, self._clamped(F.col("prediction")).alias("guess"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """`rows` with a guess in 0..pages - 1; 0 without a model."""
        if self.coarse is None:
            return rows.withColumn("guess", F.lit(0).cast("long"))
        out = self._coarse(rows)
        if self.fine is None:
            return out
        near = out.withColumn("__cell", F.floor(F.col("guess") / COARSE_PAGES)).join(self.fine, "__cell", "left")
        line = F.col("__base") + F.col("__slope") * (F.col("key").cast("double") - self.profile["lo"])
        return near.select(*rows.columns, F.coalesce(self._clamped(line), F.col("guess")).alias("guess"))

    def save(self, spark: SparkSession, path: str) -> None:
        if self.coarse is not None:
            self.coarse.write().overwrite().save(f"{path}/coarse")
        if self.fine is not None:
            self.fine.write.mode("overwrite").parquet(f"{path}/fine")
        _save_json(spark, path, {"profile": self.profile, "fences": self.fences, "pages": self.pages, "classes": self.classes, "coarse": self.coarse is not None, "fine": self.fine is not None})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PagePredictor":
        p = _load_json(spark, path)
        coarse = PipelineModel.load(f"{path}/coarse") if p["coarse"] else None
        fine = spark.read.parquet(f"{path}/fine") if p["fine"] else None
        return cls(profile=p["profile"], fences=[tuple(f) for f in p["fences"]], pages=p["pages"], classes=p["classes"], coarse=coarse, fine=fine)


def predicted_page(predictor: PagePredictor, keys: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, page_id, guessed): the page whose fences hold each key, by the predictor's guess where that is right
    (guessed is true) and by a search of all fences where it isn't. Exact for keys on some page."""
    bounds = reads.fences(pages)
    tried = predictor.predict(keys.select("key").distinct()).join(bounds, F.col("guess") == F.col("page_id"), "left")
    tried = written(tried.select("key", "page_id", F.coalesce(F.col("key").between(F.col("min_key"), F.col("max_key")), F.lit(False)).alias("guessed")))
    found = reads.page_of(tried.where(~F.col("guessed")).select("key"), pages)
    return tried.where("guessed").unionByName(found.select("key", "page_id", F.lit(False).alias("guessed")))


def learned_get(log: DataFrame, keys: DataFrame, models: dict[int, MembershipModel], pages: dict[int, PagePredictor] | None = None) -> DataFrame:
    """multi_get() that reads only levels whose model admits a key, and, with predictors, only the guessed page: it may miss."""
    keys = keys.select("key").distinct()
    out = None
    for level in [r[0] for r in log.select("level").distinct().collect()]:
        own = log.where(F.col("level") == level)
        admitted = models[level].predict(keys).where("maybe").select("key") if level in models else keys
        if pages and level in pages and "page_id" in log.columns:
            guess = pages[level].predict(admitted).select("key", F.col("guess").alias("page_id"))
            some = own.join(guess, ["key", "page_id"], "left_semi")
        else:
            some = own.join(admitted, "key", "left_semi")
        out = some if out is None else out.unionByName(some)
    return reads.multi_get(log if out is None else out, keys)


def compare_filters(members: DataFrame, others: DataFrame, learned: LearnedFilter, fpr: float = 0.01) -> DataFrame:
    """Confusion counts, rates and sizes of the learned and of a classical filter on the same keys."""
    keys = members.select("key").unionByName(others.select("key")).distinct()
    m, k = bloom.size_of(members.select("key").distinct().count(), fpr)
    classical = bloom.confusion(bloom.probe(keys, bloom.build(members, m, k), m, k), members)
    new = bloom.confusion(learned.probe(keys).select("key", "maybe"), members)
    size = sum(learned.size_bytes().values())
    return classical.select(F.lit("classical").alias("filter"), "*", F.lit(-(-m // 8)).alias("size_bytes")).unionByName(new.select(F.lit("learned").alias("filter"), "*", F.lit(size).alias("size_bytes")))


def tuned(rows: DataFrame, folds: int = 3, seed: int = 42, profile: dict | None = None) -> tuple[PipelineModel, dict, list[str]]:
    """A forest chosen by cross-validated recall over a small grid, from (key, label): (model, profile, feature names)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    profile = profile or features.key_profile(rows.where("label = 1"))
    named, names = _featured(rows.select("key", "label"), features.membership_features(profile))
    forest = RandomForestClassifier(seed=seed)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [4, 8]).addGrid(forest.numTrees, [10, 20]).build()
    judge = MulticlassClassificationEvaluator(metricName="recallByLabel", metricLabel=1.0)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest])
    return CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed).fit(named).bestModel, profile, names


@dataclass
class LevelModels:
    """Membership models and page predictors by level."""

    membership: dict[int, MembershipModel] = field(default_factory=dict)
    pages: dict[int, PagePredictor] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def train(self, samples: DataFrame, pages: DataFrame | None = None, mine_hard: bool = True, hierarchical: bool = True, **options) -> "LevelModels":
        """samples: (level, key, label), as membership_set() makes them; pages: (level, key, page_id). One model a level."""
        for (level,) in samples.select("level").distinct().collect():
            began = time.perf_counter()
            self.membership[level] = MembershipModel(**options).train(samples.where(F.col("level") == level), mine_hard)
            self.seconds[f"train membership {level}"] = time.perf_counter() - began
        for (level,) in pages.select("level").distinct().collect() if pages is not None else []:
            began = time.perf_counter()
            self.pages[level] = PagePredictor().train(pages.where(F.col("level") == level), hierarchical)
            self.seconds[f"train pages {level}"] = time.perf_counter() - began
        return self

    def get(self, log: DataFrame, keys: DataFrame) -> DataFrame:
        return learned_get(log, keys, self.membership, self.pages)

    def checked_get(self, log: DataFrame, keys: DataFrame, every: int = 100) -> tuple[DataFrame, DataFrame]:
        """get() and, for one key in `every` by hash, what the exact read says: (answers, (checked, missed))."""
        found = written(self.get(log, keys))
        some = found.where(draw(1, F.col("key")) < 1.0 / every).select("key")
        exact = reads.multi_get(log, some).select("key", F.col("found").alias("there"))
        both = found.select("key", "found").join(exact, "key")
        return found, both.agg(F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum((F.col("there") & ~F.col("found")).cast("long")), F.lit(0)).alias("missed"))

    def accuracy(self, samples: DataFrame) -> DataFrame:
        """Confusion counts and rates of each level's model on (level, key, label)."""
        out = None
        for level, model in self.membership.items():
            own = model.predict(samples.where(F.col("level") == level)).select("level", (F.col("label") == 1).alias("expected"), F.col("maybe").alias("got"))
            out = own if out is None else out.unionByName(own)
        return evaluation.error_rates(out).where("level IS NOT NULL")

    def timing(self, samples: DataFrame) -> DataFrame:
        """(level, n, seconds, micros_per_key): how long each level's membership model takes over its rows, all tasks together."""
        rows = []
        for level, model in self.membership.items():
            own = samples.where(F.col("level") == level)
            n, began = own.count(), time.perf_counter()
            model.predict(own).agg(F.count(F.when(F.col("maybe"), 1))).collect()
            took = time.perf_counter() - began
            rows.append((level, n, took, 1e6 * took / max(n, 1)))
        return samples.sparkSession.createDataFrame(rows, "level int, n long, seconds double, micros_per_key double")

    def save(self, spark: SparkSession, path: str) -> None:
        for n, m in self.membership.items():
            m.save(spark, f"{path}/membership/level={n}")
        for n, p in self.pages.items():
            p.save(spark, f"{path}/pages/level={n}")
        _save_json(spark, path, {"membership": [*self.membership], "pages": [*self.pages]})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LevelModels":
        p = _load_json(spark, path)
        return cls({n: MembershipModel.load(spark, f"{path}/membership/level={n}") for n in p["membership"]}, {n: PagePredictor.load(spark, f"{path}/pages/level={n}") for n in p["pages"]})


class OnlineTraining:
    """Samples gathered while a stored log is written to, and models trained anew at every so many flushes and compactions.

        store.listeners.append(OnlineTraining(spark, folder).after)
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 4, most: int = 10_000, **options):
        self.spark, self.path, self.every, self.most, self.options = spark, path.rstrip("/"), every, most, options
        self.models: LevelModels | None = None
        self.trained = 0

    def add(self, samples: DataFrame) -> None:
        """Appends (level, key, label)."""
        samples.select(F.col("level").cast("int").alias("level"), F.col("key").cast("double").alias("key"), F.col("label").cast("double").alias("label")).write.mode("append").parquet(f"{self.path}/samples")

    def samples(self) -> DataFrame:
        """Everything gathered; what was added twice counts once, and a key that was a member at any time is one."""
        return self.spark.read.parquet(f"{self.path}/samples").groupBy("level", "key").agg(F.max("label").alias("label"))

    def after(self, store) -> bool:
        """Whether the models were trained now."""
        if not retrain_due(store.writes, self.every):
            return False
        self.add(membership_set(store.stored(), self.most))
        self.models = LevelModels().train(self.samples(), **self.options)
        self.trained += 1
        return True


def audit(found: DataFrame, exact: DataFrame, every: int = 100) -> DataFrame:
    """A lookup in `every` of (op_idx, value) held against the exact answer: checked and missed."""
    some = found.where(F.col("op_idx") % every == 0)
    both = some.join(exact.select("op_idx", F.col("value").alias("__truth")), "op_idx")
    return both.agg(F.count(F.lit(1)).alias("checked"), F.sum((F.col("value").isNull() & F.col("__truth").isNotNull()).cast("long")).alias("missed"))
