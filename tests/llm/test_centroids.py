import hashlib
import math

import duckdb
import numpy as np
import pytest

from keepsake.llm.centroids import OP13_SQL, clustered, kept_vectors, nearest, op13_centroids, roots, squares

SF = "/root/testdata/sf0.001"


def brute(rows, k, rounds, seed):
    """(id, cluster, distance, cluster_inertia, inertia, sha256) by plain loops over Python integers."""
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows)
    cs = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in rows:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cs]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        took = assign()
        for j in range(len(cs)):
            own = [v for (_, v), (_, c, _) in zip(rows, took, strict=True) if c == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    took = assign()
    per, top = {}, 2**63 - 1
    for _, c, d in took:
        per[c] = per.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((i, c, min(d, top), min(per[c], top), min(sum(per.values()), top), sha[c]) for i, c, d in took)


def test_equals_brute_force_with_odd_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=6) + 4 * (i % 5)], "extra") for i in range(400)]
    data += [(1000 + i, data[7][1], "copy") for i in range(60)] + [(5, data[9][1], "repeat"), (5, data[5][1], "repeat")]
    odd = [(None, [1.0] * 6, "x"), (9001, None, "x"), (9002, [1.0, None] * 3, "x"), (9003, [math.nan] * 6, "x"), (9004, [math.inf] * 6, "x"), (9005, [], "x"), (9006, [0.5] * 7, "x")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, cluster string").repartition(5)
    v = kept_vectors(df, "vec_id", "embedding", 6, 256)
    rows = [(r["vec_id"], list(r["v"])) for r in v.collect()]
    assert len(rows) == len(data)
    measured = []
    got = sorted(tuple(r) for r in clustered(v, k=12, rounds=4, seed=7, pivots=3, measured=measured).collect())
    assert got == brute(rows, 12, 4, 7)
    assert len(measured) == 4 and all(0 < m < a for m, a in measured)  # pivots spare distances


def test_few_none_and_large(spark):
    schema = "vec_id long, v array<long>"
    assert clustered(spark.createDataFrame([], schema)).collect() == []
    few = [(1, [0, 5]), (2, [7, -3])]
    assert sorted(tuple(r) for r in clustered(spark.createDataFrame(few, schema)).collect()) == brute(few, 40, 5, 2)
    top = 2**62 - 1
    big = [(1, [2**40, 0]), (2, [2**40 + 3, 1]), (3, [-top, top]), (4, [2**31, -(2**31)]), (5, [0, 0]), (6, [top, -top]), (7, [2**61, 2])]
    assert sorted(tuple(r) for r in clustered(spark.createDataFrame(big, schema), k=3, rounds=2, pivots=2).collect()) == brute(big, 3, 2, 2)


def test_ties_go_to_the_smaller_number():
    x, cs = np.array([[0, 0], [10, 0]]), np.array([[3, 4], [5, 0], [-3, 4], [4, 3]])
    pick, d, _ = nearest(x, roots(x, cs[:1]), cs, roots(cs, cs[:1]))
    assert list(pick) == [0, 1] and list(d) == [25, 25]
    assert list(squares(np.array([[2**62 - 1]]), np.array([[1 - 2**62]]))) == [2**63 - 1]


@pytest.mark.parametrize("sf", [SF])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = op13_centroids(spark, sf)
    want = con.execute(OP13_SQL).fetchall()
    assert [d[0] for d in con.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 0
