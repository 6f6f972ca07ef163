"""Quality rules in a short-circuit cascade.

Each rule's cost is timed, and its rejections are counted, on a sample of a few
partitions. The rule that rejects most per unit of cost among what the ones before it
let through comes next. The cascade is one expression whose later rules run only if the earlier ones
pass, so the order changes what is computed and never what is kept.
"""

from __future__ import annotations

import random
import uuid
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.llm.frames import documents

#: Rows of the sample on which the order is found, and the partitions that they are read from; results don't depend on either.
SAMPLE = 600
SPOTS = 4
#: Characters of sampled text that a rule is timed on, and how often; the least time counts.
TIMED = 500_000
REPEATS = 3
#: Rates of rejection per cost that differ by no more than this factor count as equal; the rules' own order decides then.
ALIKE = 2
_WORD = r"[^ \t\n\r\f\x0B]+"
_SYMBOLS = "%&#$*|<>{}~^=_@+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_DIGITS = "0123456789"
_COMMON = "the of and to in is that it for was der die und in den von zu das mit sich de la le et les des en un que el y los se del las".split()
_STOP = sorted({f(w) for w in _COMMON for f in (str.lower, str.capitalize, str.upper)})


@dataclass(frozen=True)
class Rule:
    """spark: condition on a text that isn't null; sql: the same for DuckDB."""

    name: str
    spark: str
    sql: str

    @property
    def keep(self) -> Column:
        return F.expr(self.spark)


def _share(chars: str, most: float, name: str) -> Rule:
    """At most a part `most` of the characters is of `chars`."""
    gone = f"translate(text, '{chars}', '')"
    condition = f"(length(text) - length({gone})) <= CAST({most} AS DOUBLE) * length(text)"
    return Rule(name, condition, condition)


def _distinct(spark_items: str, sql_items: str, least: float, above: int, name: str) -> Rule:
    """Of more than `above` items, a part `least` or more is distinct."""
    # the lambda's variable holds the items, so that they are found once
    spark = f"exists(array({spark_items}), x -> size(x) <= {above} OR size(array_distinct(x)) >= CAST({least} AS DOUBLE) * size(x))"
    return Rule(name, spark, f"len({sql_items}) <= {above} OR len(list_distinct({sql_items})) >= CAST({least} AS DOUBLE) * len({sql_items})")


def _lines(pattern: str, most: float, above: int, name: str) -> Rule:
    """Of more than `above` lines, at most a part `most` has the pattern."""
    spark = f"exists(array(split(text, r'\\n+')), x -> size(x) <= {above} OR size(filter(x, l -> rlike(l, r'{pattern}'))) <= CAST({most} AS DOUBLE) * size(x))"
    lines = r"regexp_split_to_array(text, '\n+')"
    return Rule(name, spark, f"len({lines}) <= {above} OR len(list_filter({lines}, lambda l: regexp_matches(l, '{pattern}'))) <= CAST({most} AS DOUBLE) * len({lines})")


def rules() -> list[Rule]:
    spark_words, sql_words = f"regexp_extract_all(text, r'({_WORD})', 1)", f"regexp_extract_all(text, '{_WORD}')"
    spark_solid, sql_solid = r"length(translate(text, ' \t\n\r\u000C\u000B', ''))", r"length(regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g'))"
    return [
        Rule("has_words", r"rlike(text, r'[^ \t\n\r\f\x0B0-9\p{Punct}]')", r"regexp_matches(text, '[^ \t\n\r\f\x0B0-9[:punct:]]')"),
        Rule("word_length", f"exists(array(size({spark_words})), n -> {spark_solid} BETWEEN 2 * n AND 15 * n)", f"{sql_solid} BETWEEN 2 * len({sql_words}) AND 15 * len({sql_words})"),
        _share(_SYMBOLS, 0.05, "symbols"),
        _share("!?", 0.05, "exclamations"),
        _share(_CAPITALS, 0.4, "capitals"),
        _share(_DIGITS, 0.5, "digits"),
        _distinct(spark_words, sql_words, 0.3, 20, "repeated_words"),
        _distinct(r"split(text, r'\n+')", r"regexp_split_to_array(text, '\n+')", 0.5, 4, "repeated_lines"),
        _distinct(r"split(text, r'\n\n+')", r"regexp_split_to_array(text, '\n\n+')", 0.5, 3, "repeated_paragraphs"),
        _lines(r"^[ \t]*[-*•]", 0.9, 4, "bullets"),
        _lines(r"(\.\.\.|…)\z", 0.3, 4, "ellipses"),
        Rule(
            "stop_words",
            f"exists(array({spark_words}), x -> size(x) <= 50 OR size(array_intersect(x, array({', '.join(map(repr, _STOP))}))) >= 2)",
            f"len({sql_words}) <= 50 OR len(list_intersect({sql_words}, [{', '.join(map(repr, _STOP))}])) >= 2",
        ),
        Rule(
            "repeated_trigrams",
            f"exists(array({spark_words}), x -> size(x) <= 30 OR size(array_distinct(transform(sequence(0, size(x) - 3), i -> concat_ws(' ', x[i], x[i + 1], x[i + 2])))) >= CAST(0.3 AS DOUBLE) * (size(x) - 2))",
            f"len(list_filter([{sql_words}], lambda x: len(x) <= 30 OR len(list_distinct(list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]))) >= CAST(0.3 AS DOUBLE) * (len(x) - 2))) = 1",
        ),
    ]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float


def _sampled(docs: DataFrame, sample: int, seed: int) -> list[str]:
    """Texts from the heads of a few partitions chosen by chance: no other partition is read."""
    rows = docs.select("text").where(F.col("text").isNotNull()).rdd
    n = rows.getNumPartitions()
    spots = sorted(random.Random(seed).sample(range(n), min(n, SPOTS)))
    each = -(-sample // max(1, len(spots)))
    return [r[0] for r in docs.sparkSession.sparkContext.runJob(rows, lambda some: islice(some, each), spots)] if spots else []


def _cpu_seconds(job: DataFrame) -> float:
    """CPU time of the tasks that collecting `job` takes; what else runs on the machine hardly tells."""
    context = job.sparkSession.sparkContext
    tag = f"tephra-{uuid.uuid4().hex}"
    context.addJobTag(tag)
    try:
        job.collect()
    finally:
        context.removeJobTag(tag)
    inner = context._jsc.sc()
    inner.listenerBus().waitUntilEmpty()
    stages = {s for j in inner.statusTracker().getJobIdsForTag(tag) for s in context.statusTracker().getJobInfo(j).stageIds}
    return sum(inner.statusStore().lastStageAttempt(s).executorCpuTime() for s in stages) / 1e9


def estimate(docs: DataFrame, every: list[Rule], sample: int = SAMPLE, seed: int = 3) -> list[Estimate]:
    """Rules in cascade order, with cost and the part that each rejects of what reaches it on the sample.

    The cost is the CPU time of one task over the sampled texts again and again: the least
    of some turns, in which all rules take part by turns, less that of a task without a rule.
    """
    spark = docs.sparkSession
    texts = _sampled(docs, sample, seed)
    if not texts:
        return [Estimate(r, 1.0, 0.0) for r in every]
    local = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    outcomes = [list(map(bool, r)) for r in local.select(*[r.keep.alias(str(i)) for i, r in enumerate(every)]).collect()]
    again = local.select("text", F.explode(F.sequence(F.lit(1), F.lit(max(1, TIMED // max(1, sum(map(len, texts))))))))
    tried = [again.agg(F.count(F.when(F.length("text") < 0, 1))), *(again.agg(F.count(F.when(r.keep, 1))) for r in every)]
    took = [[] for _ in tried]
    for turn in range(1 + REPEATS):  # the first one compiles
        for i, job in enumerate(tried):
            seconds = _cpu_seconds(job)
            if turn:
                took[i].append(seconds)
    least = [min(x) for x in took]
    costs = [max(x - least[0], 1e-3) for x in least[1:]]
    left, out, reach = list(range(len(every))), [], outcomes
    while left:
        rate = {i: sum(not o[i] for o in reach) / costs[i] for i in left}
        best = next(i for i in left if rate[i] * ALIKE >= max(rate.values()))
        out.append(Estimate(every[best], costs[best], sum(not o[best] for o in reach) / max(len(reach), 1)))
        reach = [o for o in reach if o[best]]
        left.remove(best)
    return out


def verdict(order: list[Rule]) -> Column:
    """Name of the first rule in this order that rejects a text; null if none does."""
    out = F.when(F.col("text").isNull(), F.lit("null_text"))
    for r in order:
        out = out.when(~r.keep, F.lit(r.name))
    return out


def keep(docs: DataFrame, every: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that pass all rules.

    Null and empty texts don't pass (they have no words). Rows are judged one by
    one: repeated rows fare alike, and texts may have any length. An empty table
    stays empty. All columns are passed through; only `text` matters (and doc_id, to
    draw the sample).
    """
    order = [e.rule for e in estimate(docs, every or rules(), sample)]
    return docs.where(verdict(order).isNull())


def keep_sql(table: str = "documents", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    return f"SELECT {columns} FROM {table} WHERE text IS NOT NULL AND " + " AND ".join(f"({r.sql})" for r in rules())


def query(spark, sf_dir: str) -> DataFrame:
    return keep(documents(spark, sf_dir))
