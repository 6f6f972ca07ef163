"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their length in tokens once; sums over the suffixes of
that histogram answer totals, quantiles and truncated totals of every context limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.llm import words as W
from tephra.llm.bpe import AHEAD, VOCABULARY, encoder
from tephra.llm.frames import documents, mapped


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length. Partly aggregated in each task."""

    def run(batches):
        enc, counts = encoder(vocabulary), {}
        for batch in batches:
            column = W.column(batch, "text")
            for lo, hi in W.chunks(column, AHEAD):
                texts = [t for t in column.slice(lo, hi - lo).to_pylist() if t is not None]
                enc.prepare(texts)
                for text in texts:
                    n = len(enc.packed(text)) // enc.vocabulary.dtype.itemsize
                    counts[n] = counts.get(n, 0) + 1
        enc.forget()
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select("text").transform(mapped, run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram and, for each length L as a context limit:

    docs_over, tokens_over: documents longer than L and their tokens; total: tokens
    of all documents; truncated_total: tokens left if each document is cut to L;
    quantile: the part of the documents that have L tokens or fewer.

    One row for each length that occurs; their number depends on the longest text
    alone, so one task orders them.
    """
    longer = Window.partitionBy().orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    over, tokens = F.coalesce(F.sum("n_docs").over(longer), F.lit(0)), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")).over(longer), F.lit(0))
    out = histogram.select("n_tokens", "n_docs", over.alias("docs_over"), tokens.alias("tokens_over"), F.sum(F.col("n_tokens") * F.col("n_docs")).over(every).alias("total"), F.sum("n_docs").over(every).alias("__docs"))
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        "tokens_over",
        "total",
        (F.col("total") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("__docs") - F.col("docs_over")) / F.col("__docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> Column:
    """Aggregate of suffix_sums(): tokens left if each document is cut to any `limit`."""
    at = F.max_by(F.struct("total", "tokens_over", "docs_over"), F.when(F.col("n_tokens") <= limit, F.col("n_tokens")))
    return F.coalesce(at["total"] - at["tokens_over"] + limit * at["docs_over"], limit * F.sum("n_docs"))


def quantile(q: float) -> Column:
    """Aggregate of suffix_sums(): the least length that a part q of the documents doesn't exceed."""
    return F.min(F.when(F.col("quantile") >= q, F.col("n_tokens")))


def count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """suffix_sums() of the documents' lengths.

    Null texts aren't counted; empty ones have no tokens. Repeated rows count each
    time. An empty table has no lengths. Only `text` is read.
    """
    return suffix_sums(lengths(docs, vocabulary))


def query(spark, sf_dir: str) -> DataFrame:
    return count(documents(spark, sf_dir))
