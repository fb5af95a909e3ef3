"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query. Instead of sorting the scores, each round counts
them in a histogram per query, sums the histograms over all tasks and narrows the interval that
holds the k-th highest score. When the interval is a single integer, one last pass keeps what
reaches that score and settles ties by the smaller id.

Scores are exact: products go through float64 where their sums stay below 2**53, else through Python's
integers. Components beyond the range of a long are its ends, and so are scores beyond it.

Edge cases: rows whose id or vector is null, or whose vector holds a null or non-finite component,
take no part. Empty vectors score 0 with each other. A query with fewer than k candidates gets all of them. A row
that repeats a query's id counts as the query's own row and is no candidate; repeated candidate
rows are candidates once each. An empty table gives an empty result. Vectors whose length differs
from the query's are no candidates of it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) for each component; only rows with whole finite vectors."""
    x = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"))


def _matrix(col, length: int) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.int64).reshape(len(col), length)


def _products(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows as longs, cut to the range of a long."""
    top = [int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, vectors)]
    if top[0] * top[1] * max(q.shape[1], 1) < 1 << 52:
        return np.rint(q.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _scores(batches, queries):
    """(ids, score matrix: queries x rows, own-row mask) for each Arrow batch, by vector length."""
    for pdf in batches:
        lengths = pdf["v"].map(len)
        for n, part in pdf.groupby(lengths):
            q = queries.get(n)
            if q is None:
                continue
            ids, vectors = part["vec_id"].to_numpy(), _matrix(part["v"], n)
            for at in range(0, len(q[0]), 512):
                rows = slice(at, at + 512)
                yield q[2][rows], ids, _products(q[1][rows], vectors), q[0][rows][:, None] != ids[None, :]


def _histogram(shared, bins):
    def run(batches):
        queries, lo, width = shared.value
        for index, _, score, other in _scores(batches, queries):
            low = lo[index][:, None]
            # differences of longs fit an unsigned long
            at = (score.view(np.uint64) - low.view(np.uint64)) // np.uint64(width)
            # what lies above the interval is counted in an extra bin, what lies below is left out
            at = np.minimum(at, np.uint64(bins)).astype(np.int64)
            keep = other & (score >= low)
            key, n = np.unique((index[:, None] * (bins + 1) + at)[keep], return_counts=True)
            yield pd.DataFrame({"q": key // (bins + 1), "bin": key % (bins + 1), "n": n})

    return run


def _reached(shared, k):
    def run(batches):
        queries, lo, _ = shared.value
        ids_of = {int(i): int(v) for n in queries for i, v in zip(queries[n][2], queries[n][0], strict=True)}
        for index, ids, score, other in _scores(batches, queries):
            for r in range(len(index)):
                hit = np.flatnonzero(other[r] & (score[r] >= lo[index[r]]))
                if len(hit) > k:  # no more than k rows of a batch can be among the k best
                    hit = hit[np.lexsort((ids[hit], -score[r][hit]))[:k]]
                if len(hit):
                    yield pd.DataFrame({"query_id": ids_of[int(index[r])], "vec_id": ids[hit], "score": score[r][hit]})

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, bins: int = 256) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank (from 1), vec_id, score.

    ``vectors`` and ``queries`` hold vec_id and v (array<long>). Queries are taken in blocks of
    about ``block``; only one block and its ``bins`` counters a query are ever on the driver or
    broadcast, whatever the size of the tables.
    """
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))  # a repeated query row asks once
    n_queries = queries.count()
    blocks = max(1, math.ceil(n_queries / block))
    bound = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m")).first()["m"] or 0
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        by_length: dict = {}
        for i, row in enumerate(rows):
            by_length.setdefault(len(row["v"]), []).append((row["vec_id"], row["v"], i))
        packed = {n: (np.array([x[0] for x in g], dtype=np.int64), np.array([x[1] for x in g], dtype=np.int64).reshape(len(g), n), np.array([x[2] for x in g], dtype=np.int64)) for n, g in by_length.items()}
        norms = np.array([math.sqrt(sum(float(x) * x for x in row["v"])) for row in rows] or [0.0])
        limit = min(int(norms.max() * math.sqrt(bound) * 1.000001) + 1, 2**63 - 1)  # Cauchy-Schwarz
        lo, width = np.full(len(rows), -limit - 1, dtype=np.int64), -(-(2 * limit + 2) // bins)
        need = np.full(len(rows), k, dtype=np.int64)
        while rows:
            shared = spark.sparkContext.broadcast((packed, lo, width))
            counted = vectors.mapInPandas(_histogram(shared, bins), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
            table = np.zeros((len(rows), bins + 1), dtype=np.int64)
            table[counted["q"].to_numpy(), counted["bin"].to_numpy()] = counted["n"].to_numpy()
            # from the top: the first bin at which k scores are reached; with fewer than k, the lowest
            reached = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] >= need[:, None]
            pick = np.where(reached.any(axis=1), bins - np.argmax(reached[:, ::-1], axis=1), 0)
            lo = (lo.view(np.uint64) + np.minimum(pick, bins - 1).astype(np.uint64) * np.uint64(width)).view(np.int64)
            if width == 1:
                break
            width = -(-width // bins)
        if rows:
            shared = spark.sparkContext.broadcast((packed, lo, 1))
            best = vectors.mapInPandas(_reached(shared, k), SCHEMA)
            out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_topk(spark, sf_dir):
    from keepsake.llm.common import table

    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= 10
"""
