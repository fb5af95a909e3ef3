"""Centroid clustering with a table of pivot distances (LAESA).

Vectors of integers are assigned to the nearest of k centroids by squared Euclidean distance. A few
centroids of the start serve as fixed pivots. The distance of each vector to each pivot is computed
once and stored beside the vector in the shared folder. In every round the difference between a
vector's and a centroid's distance to a pivot bounds their distance from below (triangle
inequality): the centroid with the least bound is measured first, and of the others only those whose
bound does not exceed that measure get an exact integer distance. Bounds are compared with a margin
far above the error of floats, so no nearest centroid is passed over, ties included.

A round reads the table once. Tasks send the sums of each cluster, split in two halves so that no
sum overflows; the driver holds k centroids (k, times components, is what is broadcast: a parameter,
not the data) and divides the sums exactly.

Edge cases: rows whose id or vector is null, whose vector has another number of components, or holds
a null or non-finite component take no part. Components of 2**62 and more are cut below it; squared distances
beyond a long are its end. Rows that repeat an id are vectors of their own; as centroids they stand in
the order of their components. With fewer vectors than k, each is a centroid. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import saved, table

LONG = 2**63 - 1
#: Components beyond are cut to this, so that differences of two fit a long.
LARGEST = 2**62 - 1
#: Share of a bound that the error of floats may take; doubles are good to about 1e-16.
MARGIN = 1e-9


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, length: int, scale: int) -> DataFrame:
    """vec_id and v = floor(scale * x) of every component, only for whole finite vectors of ``length`` components."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) == length) & whole
    cut = lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST))
    return df.where(fine).select(F.col(id_col).alias("vec_id"), F.transform(x, cut).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest sha256 of ``seed:id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def spread_pivots(centroids: np.ndarray, n: int) -> np.ndarray:
    """n of the centroids, each as far as possible from those taken before."""
    c = centroids.astype(np.float64)
    taken = [0]
    gap = ((c - c[0]) ** 2).sum(axis=1)
    while len(taken) < min(n, len(c)):
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((c - c[taken[-1]]) ** 2).sum(axis=1))
    return centroids[taken]


def roots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows as doubles, with an error far below MARGIN."""
    return np.stack([np.sqrt(((x - p).astype(np.float64) ** 2).sum(axis=1)) for p in y], axis=1)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows, at most the largest long."""
    d = x - c
    if d.size and np.abs(d.astype(np.float64)).max() ** 2 * d.shape[1] >= 2.0**62:
        return np.array([min(sum(int(a) ** 2 for a in row), LONG) for row in d], dtype=np.int64)
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row its nearest centroid (ties: the smaller number), the exact squared distance, and how many distances were computed."""
    n, rows = len(x), np.arange(len(x))
    bound = np.zeros((n, len(centroids)))
    for p in range(to_pivots.shape[1]):
        a, b = to_pivots[:, p, None], centroid_pivots[None, :, p]
        np.maximum(bound, np.abs(a - b) - MARGIN * (a + b), out=bound)
    guess = bound.argmin(axis=1)
    best = squares(x, centroids[guess])
    reach = np.sqrt(best.astype(np.float64)) * (1 + MARGIN)
    reach[best == LONG] = np.inf  # cut distances tell nothing
    open_ = bound <= reach[:, None]
    open_[rows, guess] = False
    r, j = np.nonzero(open_)
    d = squares(x[r], centroids[j])
    # rows in ascending order, within a row centroids in ascending order: keep the least of each row
    table_ = np.full((n, len(centroids)), LONG, dtype=np.int64)
    open_[rows, guess] = True
    table_[r, j], table_[rows, guess] = d, best
    pick = np.where(open_, table_, LONG).argmin(axis=1)
    cut = best == LONG  # every measured centroid may be cut to the end of a long: settle these exactly
    for i in np.flatnonzero(cut):
        exact = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], c, strict=True)) for c in centroids]
        pick[i] = exact.index(min(exact))
        table_[i, pick[i]] = min(min(exact), LONG)
    return pick, table_[rows, pick], n + len(r)


def _matrix(col, length: int) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.int64).reshape(len(col), length)


def _with_pivots(pivots: np.ndarray):
    def run(batches):
        for pdf in batches:
            x = _matrix(pdf["v"], pivots.shape[1])
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "p": list(roots(x, pivots))})

    return run


def _assigned(batches, shared):
    centroids, centroid_pivots = shared.value
    for pdf in batches:
        for at in range(0, len(pdf), 4096):
            part = pdf.iloc[at : at + 4096]
            x = _matrix(part["v"], centroids.shape[1])
            p = np.array(part["p"].tolist(), dtype=np.float64).reshape(len(part), -1)
            yield part, x, *nearest(x, p, centroids, centroid_pivots)


def _sums(shared):
    """For each cluster and component the sums of both halves of its numbers; n, and the measured distances, at component -1."""

    def run(batches):
        k, length = shared.value[0].shape
        high, low, n, measured = np.zeros((k, length), np.int64), np.zeros((k, length), np.int64), np.zeros(k, np.int64), 0
        for _, x, cluster, _, seen in _assigned(batches, shared):
            np.add.at(high, cluster, x >> 32)
            np.add.at(low, cluster, x & 0xFFFFFFFF)
            n += np.bincount(cluster, minlength=k)
            measured += seen
        if measured:
            used = np.flatnonzero(n)
            grid = np.repeat(used, length)
            yield pd.DataFrame({"cluster": grid, "part": np.tile(np.arange(length), len(used)), "high": high[used].ravel(), "low": low[used].ravel()})
            yield pd.DataFrame({"cluster": used, "part": -1, "high": n[used], "low": [measured, *[0] * (len(used) - 1)]})

    return run


def _labels(shared):
    def run(batches):
        for part, _, cluster, distance, _ in _assigned(batches, shared):
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance})

    return run


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, pivots: int = 8, measured: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each row of ``vectors`` (vec_id, v array<long> of one length).

    ``measured``, if given, gets the number of exact distances of each round beside the number of all pairs.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, cluster int, distance long"
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    fixed = spread_pivots(centroids, pivots)
    stored = saved(vectors.mapInPandas(_with_pivots(fixed), f"vec_id {id_type}, v array<long>, p array<double>"), "pivots")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((centroids, roots(centroids, fixed)))
        wide = "decimal(38,0)"
        sent = stored.mapInPandas(_sums(shared), "cluster int, part int, high long, low long")
        sums = sent.groupBy("cluster", "part").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).collect()
        count = {r["cluster"]: int(r["high"]) for r in sums if r["part"] < 0}
        if measured is not None:
            measured.append((sum(int(r["low"]) for r in sums if r["part"] < 0), len(centroids) * sum(count.values())))
        centroids = centroids.copy()
        for r in sums:
            if r["part"] >= 0:
                centroids[r["cluster"], r["part"]] = ((int(r["high"]) << 32) + int(r["low"])) // count[r["cluster"]]
    shared = spark.sparkContext.broadcast((centroids, roots(centroids, fixed)))
    labels = saved(stored.mapInPandas(_labels(shared), schema), "labels")
    inertia = {r["cluster"]: int(r["s"]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(inertia.values()), LONG)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # one row a cluster: k rows at most
    per_cluster = spark.createDataFrame([(c, min(s, LONG), total, digests[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark, sf_dir):
    return clustered(kept_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 256))


def _rounds_sql(rounds: int) -> str:
    """A common table expression for the assignment and one for the centroids of each round."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT row, arg_min(n, struct_pack(d := d, n := n)) AS n, min(d) AS d FROM (
  SELECT row, n, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY row)""")
        if i < rounds:
            out.append(f"""m{i} AS (SELECT n, list(((s - ((s % size) + size) % size) // size)::BIGINT ORDER BY place) AS c FROM (
  SELECT n, place, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS size FROM (SELECT a{i}.n, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i} JOIN kept USING (row)) GROUP BY n, place) GROUP BY n),
c{i + 1} AS MATERIALIZED (SELECT c{i}.n, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (n))""")
    return ",\n".join(out)


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT n, c FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS n, v AS c FROM kept) WHERE n < 40),
{_rounds_sql(5)}
SELECT vec_id, a5.n AS cluster, a5.d AS distance, CAST(sum(a5.d) OVER (PARTITION BY a5.n) AS BIGINT) AS cluster_inertia, CAST(sum(a5.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c5.c, ',')) AS centroid_sha256
FROM a5 JOIN kept USING (row) JOIN c5 USING (n)
"""
