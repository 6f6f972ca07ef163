"""The corpus pipeline: five stages over `documents`, each written and read again.

All but the last stage return the columns of documents; extra columns are passed
through. Null texts and empty texts go in the first stage (no language), unless no
row at all has a language: then there is no model, and the first stage keeps every
row. A null text then stays null to the end and has no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.llm import bpe, langid, mixing, ngram_join, suffix_array
from tephra.llm.frames import documents, unused
from tephra.plans.tables import delete, new_folder, scope, written


def _aside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of `docs`, of which those that the stage would replace go by another name meanwhile."""
    p = unused(docs)
    out = stage(docs.withColumnsRenamed({n: p + n for n in names if n in docs.columns}))
    return out.select(*[F.col(f"`{p + c}`").alias(c) if c in names else F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one known language has most of the words."""
    return _aside(docs, ("language", "language_share", "n_words", "accepted", "run_start", "run_language"), lambda d: langid.identify(d).where("accepted"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together by n-gram similarity, the one of the least doc_id."""
    return ngram_join.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return suffix_array.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows, by source in the target weights: documents are repeated or left out."""
    return _aside(docs, ("copies",), lambda d: mixing.repeated(mixing.mix(d)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the encoded text; decoding gives it back exactly."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: A trained model, suffix sorting and tokenising aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of the tables between them, and of those inside a stage, only what the result reads is left."""
    docs, path = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        before, path = path, new_folder(spark)
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
