import math

import numpy as np

from keepsake.llm.topk import exact_topk, quantised


def brute(rows, k):
    want = []
    for q, qv in rows:
        if q % 3:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(qv, cv)), c) for c, cv in rows if c != q and len(cv) == len(qv)))
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(want)


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=8)], "extra") for i in range(300)]
    data += [(1000 + i, data[5][1], "copy") for i in range(40)]  # ties
    odd = [(None, [1.0] * 8, "x"), (9001, None, "x"), (9002, [1.0, None] * 4, "x"), (9003, [math.nan] * 8, "x"), (9004, [math.inf] * 8, "x"), (9005, [], "x"), (9006, [0.5, 0.5], "x")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, score string").repartition(5)
    v = quantised(df, "vec_id", "embedding", 1024)
    rows = [(r["vec_id"], list(r["v"])) for r in v.collect()]
    assert {r[0] for r in rows} == {d[0] for d in data} | {9005, 9006}
    got = sorted(tuple(r) for r in exact_topk(v, v.where("vec_id % 3 = 0"), k=7, block=50, bins=16).collect())
    assert got == brute(rows, 7)


def test_empty_and_few(spark):
    schema = "vec_id long, v array<long>"
    empty = spark.createDataFrame([], schema)
    assert exact_topk(empty, empty).collect() == []
    few = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [0, 0])], schema)
    assert [tuple(r) for r in exact_topk(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 11), (0, 2, 2, 0)]


def test_large_components(spark):
    big = [(0, [float(2**24), 0.0]), (3, [1e9, -1.0]), (1, [float(2**24), 1.0]), (2, [1.0, 2.0**30]), (4, [-(2.0**40), 3.0]), (6, [1e300, -1e300])]
    v = quantised(spark.createDataFrame(big, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1024)
    rows = [(r["vec_id"], list(r["v"])) for r in v.collect()]
    assert len(rows) == len(big) and max(max(x) for _, x in rows) == 2**63 - 1
    want = [(q, r, c, min(max(s, -(2**63)), 2**63 - 1)) for q, r, c, s in brute(rows, 9)]
    by_query = {}
    for q, _, c, s in want:
        by_query.setdefault(q, []).append((-s, c))
    want = sorted((q, i + 1, c, -s) for q, x in by_query.items() for i, (s, c) in enumerate(sorted(x)[:3]))
    assert sorted(tuple(r) for r in exact_topk(v, v.where("vec_id % 3 = 0"), k=3, bins=16).collect()) == want
