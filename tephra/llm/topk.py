"""Exact top-k inner products over norm-sorted vectors.

Vectors are rotated to the principal axes (eigenvectors of their Gram matrix, the
right singular vectors of all data), so leading coordinates hold most of a product,
and laid down in blocks by descending length in the shared folder. Each task streams
the blocks for its queries: a partial product over the leading coordinates plus the
Cauchy-Schwarz bound of the rest rules pairs out, and once even parallel vectors of
the remaining lengths can't reach any query's k-th best, it stops reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tephra.llm import words as W
from tephra.llm.frames import mapped, parts, written

K = 10
#: The query set of the catalog's query: ids divisible by it, against all rows.
EVERY = 50
BLOCK = 1024
_EPS = 1e-8
_DIGITS = 9


def _gram(rows: DataFrame, d: int) -> np.ndarray:
    def part(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = np.asarray(W.column(batch, "embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["cell", "value"])

    cells = rows.select("embedding").transform(mapped, part, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(d * d)
    for c, v in cells:
        out[c] = v
    return out.reshape(d, d)


def _blocks(path: str) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(greatest norm, ids, vectors) in descending order of norms."""
    fs, base = pa.fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(base)) if f.path.endswith(".parquet"))
    for name in files:
        with fs.open_input_file(name) as raw:
            for batch in pa.parquet.ParquetFile(raw).iter_batches(batch_size=8):
                for norm, ids, matrix in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    ids = np.frombuffer(ids, np.int64)
                    yield norm, ids, np.frombuffer(matrix, np.float64).reshape(len(ids), -1)


class Best:
    """The k best (score rounded, id) of each query so far; ties go to the smaller id. A score of -inf marks a place that is free."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.score, self.id = np.full((len(own), k), -np.inf), np.full((len(own), k), -1, np.int64)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.own[query]
        query, score, ids = query[other], np.round(score[other], _DIGITS), ids[other]
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ids = np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        new = np.ones(len(query), bool)  # one neighbour id counts once, with its best score
        begin = np.searchsorted(query, touched)
        if len(ids) > 1:
            again = np.lexsort((np.arange(len(ids)), ids, query))
            same = (query[again][1:] == query[again][:-1]) & (ids[again][1:] == ids[again][:-1]) & np.isfinite(score[again][1:])
            new[again[1:][same]] = False
        query, score, ids = query[new], score[new], ids[new]
        begin = np.searchsorted(query, touched)
        take = begin[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = score[take], ids[take]


def _kth(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th greatest score of the columns' ids but its own, where an id counts once, by its best; -inf if there are fewer."""
    order = np.argsort(ids, kind="stable")
    every, begin = np.unique(ids[order], return_index=True)
    score = np.maximum.reduceat(score[:, order], begin, axis=1)
    at = np.minimum(np.searchsorted(every, own), len(every) - 1)
    mine = np.flatnonzero(every[at] == own)
    score[mine, at[mine]] = -np.inf
    if len(every) < k:
        return np.full(len(own), -np.inf)
    return np.partition(score, -k, axis=1)[:, -k]


def search(ids: np.ndarray, q: np.ndarray, blocks, k: int) -> Best:
    best, d = Best(ids, k), q.shape[1]
    half = max(1, d // 2)
    length, rest = np.linalg.norm(q, axis=1), np.linalg.norm(q[:, half:], axis=1)
    for norm, other, x in blocks:
        floor = best.floor() - _EPS * (1 + length * norm)
        live = np.flatnonzero(length * norm >= floor)
        if not len(live):
            break
        part = q[live, :half] @ x[:, :half].T
        may = part + rest[live][:, None] * np.linalg.norm(x[:, half:], axis=1)[None] >= floor[live][:, None]
        some = np.count_nonzero(may)
        if some > 0.05 * may.size:
            part += q[live, half:] @ x[:, half:].T
            row, col = np.nonzero(part >= floor[live][:, None])
            score = part[row, col]
        else:
            row, col = np.nonzero(may)
            score = part[row, col] + np.einsum("ij,ij->i", q[live[row], half:], x[col, half:])
        if len(row) > 50 * k * len(live):  # the first blocks: only what reaches each row's k-th best other id can matter
            dense = np.full(part.shape, -np.inf)
            dense[row, col] = score
            cut = _kth(dense, other, ids[live], k)
            near = score >= cut[row] - 1e-8
            row, col, score = row[near], col[near], score[near]
        best.add(live[row], score, other[col])
    return best


def top_k(vectors: DataFrame, k: int = K, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): each row's k greatest inner products with rows of other ids.

    Rows whose id is divisible by `every` are queries; all rows are searched.

    score is rounded to six places; rank goes by the product to nine places, then by
    neighbor_id. Fewer than k rows if there are fewer other ids. Rows with a null
    vec_id, a null or empty embedding, or one that holds a null, NaN or a value of
    1e150 or more (squares of which overflow) take no part. Products exist between
    vectors of one length only: each length is searched by itself, and a row whose
    length no other id has gets no neighbours. Repeated rows count once; of several
    vectors of one id each is a neighbour by its best product, and a query of its own
    whose results are merged by the best. An empty table has no results. Ids may be
    negative. Only vec_id and embedding are read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e150)), F.lit(False))
    rows = rows.where(good)
    lengths = sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect() if r[0])
    found = None
    for d in lengths:  # one in a sound table
        some = _products(rows.where(F.size("embedding") == d).distinct(), d, k, parts(vectors), every)
        found = some if found is None else found.union(some)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, rank int, neighbor_id long, score double")
    found = found.groupBy("vec_id", "neighbor_id").agg(F.max("product").alias("product"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("product").desc(), "neighbor_id"))).where(F.col("rank") <= k)
    return found.select("vec_id", "rank", "neighbor_id", F.round("product", 6).alias("score"))


def _products(rows: DataFrame, d: int, k: int, width: int, every: int) -> DataFrame:
    """(vec_id, neighbor_id, product): the k best of each of the rows, whose vectors have d values."""
    values, axes = np.linalg.eigh(_gram(rows, d))
    axes = np.ascontiguousarray(axes[:, np.argsort(-values)])

    def lay(batches):
        ids, xs = [], []
        for batch in batches:
            ids.append(W.column(batch, "vec_id").to_numpy())
            xs.append(np.asarray(W.column(batch, "embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d))
        if not ids:
            return
        ids, x = np.concatenate(ids), np.concatenate(xs) @ axes
        norm = np.linalg.norm(x, axis=1)
        order = np.lexsort((ids, -norm))
        for lo in range(0, len(ids), BLOCK):
            at = order[lo : lo + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([norm[at[0]] * (1 + 1e-12)]), pa.array([ids[at].tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary())], names=["norm", "ids", "matrix"])

    def laid_of(some: DataFrame, n: int) -> DataFrame:
        length = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
        return some.withColumn("__n", length).repartitionByRange(n, F.col("__n").desc(), F.xxhash64("vec_id")).transform(mapped, lay, "norm double, ids binary, matrix binary")

    index = written(laid_of(rows, width))
    path = index.inputFiles()[0].rsplit("/", 1)[0] if index.inputFiles() else ""

    def ask(batches):
        for batch in batches:
            for ids, matrix in zip(W.column(batch, "ids").to_pylist(), W.column(batch, "matrix").to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                best = search(ids, np.frombuffer(matrix, np.float64).reshape(len(ids), d), _blocks(path), k)
                row, rank = np.nonzero(np.isfinite(best.score))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best.id[row, rank]), pa.array(best.score[row, rank])], names=["vec_id", "neighbor_id", "product"])

    asked = index
    if every > 1:  # the index keeps every row; the queries are laid by themselves, full blocks of like lengths
        asked = laid_of(rows.where(F.col("vec_id") % every == 0), width)
    return asked.repartition(width).transform(mapped, ask, "vec_id long, neighbor_id long, product double")


def top_k_sql(table: str = "embeddings", k: int = K, every: int = 1) -> str:
    return f"""
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM {table} WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e150)) = len(embedding)),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, max(round(list_dot_product(a.v, b.v), {_DIGITS})) AS product FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % {every} = 0 AND len(a.v) = len(b.v) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY product DESC, neighbor_id) AS rank FROM p)
SELECT vec_id, rank::INTEGER AS rank, neighbor_id, round(product, 6) AS score FROM r WHERE rank <= {k}"""


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)
