import random

import numpy as np

from keepsake.llm.common import WordHashes, words_of
from keepsake.llm.decontaminate import contaminated, tile


def brute_tiles(a, b, m):
    """Greedy string tiling as the definition says it, word by word."""
    fa, fb, tiles = [True] * len(a), [True] * len(b), []
    m = max(1, min(m, len(a)))
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < m:
            return tiles
        tiles.append((i, j, n))
        for k in range(n):
            fa[i + k] = fb[j + k] = False


def test_tiles_equal_the_definition():
    rng, memo = random.Random(5), WordHashes()
    for _ in range(150):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 20))]
        b = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.5:
            b[5:5] = a[len(a) // 2 :] + ["z"] + a[: len(a) // 2]
        got = tile(memo.of([x.encode() for x in a]), memo.of([x.encode() for x in b]), 3)
        want = brute_tiles(a, b, 3)
        assert sum(t[2] for t in got) == sum(t[2] for t in want)
        assert sorted(got) == sorted(want)


def test_reordered_passages_and_odd_rows(spark):
    item = [f"w{i}" for i in range(30)]
    other = [f"v{i}" for i in range(30)]
    filler = [f"f{i}" for i in range(3000)]
    reordered = " ".join(filler[:50] + item[15:] + filler[50:90] + item[:15] + filler)
    docs = [(1, reordered, "x"), (2, " ".join(filler), None), (3, None, "x"), (4, "", "x"), (5, " ".join(item).upper(), "x"), (6, " ".join(item[:8] + filler[:20]), "x"), (None, " ".join(other), "x"), (7, "short one", "x"), (7, "short one", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, None), (13, ""), (14, "short one")], "item_id long, text string")
    for parts in (2_000_000, 50):
        got = sorted(((r["doc_id"] or -1, r["item_id"], r["n_tiles"], r["coverage"]) for r in contaminated(df, bench, broadcast_seeds=parts).collect()))
        assert got == [(-1, 11, 1, 1.0), (1, 10, 2, 1.0), (5, 10, 1, 1.0), (7, 14, 1, 1.0), (7, 14, 1, 1.0)]
    named = bench.selectExpr("concat('item-', item_id) AS item_id", "text")
    assert {r["item_id"] for r in contaminated(df, named).collect()} == {"item-10", "item-11", "item-14"}
    assert contaminated(df.limit(0), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    memo, want = WordHashes(10**7), []
    items = [(r["item_id"], memo.of(words_of(r["text"]))) for r in bench.collect()]
    for r in docs.collect():
        h = memo.of(words_of(r["text"]))
        for item_id, w in items:
            if len(h) and len(np.intersect1d(h, w)) >= min(5, len(w)):
                c = sum(t[2] for t in tile(w, h, 5)) / len(w)
                if c >= 0.5:
                    want.append((r["doc_id"], item_id, round(c, 9)))
    assert sorted((r["doc_id"], r["item_id"], round(r["coverage"], 9)) for r in contaminated(docs, bench).collect()) == sorted(want)
