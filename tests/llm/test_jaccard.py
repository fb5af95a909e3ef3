import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm.jaccard import bounded_links, common_shingles, first_regions, near_duplicates, op3_jaccard, point_reps, points, region_links


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min([x for x in (low.get(find(i)), d) if x is not None], default=None)
    return sorted(((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed, n_groups=25):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    passage = [word() for _ in range(40)]
    texts = []
    for g in range(n_groups):
        base = [word() for _ in range(rng.choice([3, 5, 20, 60, 150]))]
        if g % 4 == 0:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 3, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.2:
                t = t + [word() for _ in range(len(t) // 6)]
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("small", "region", "pivots"), [(16, 2_000_000, 64), (2, 500, 4)])
def test_equals_brute_force(spark, small, region, pivots):
    rows = corpus(small) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three"), (None, "one two"), (1006, "é É ß"), (1006, "é É ß"), (1007, None), (7, "other text with the same id as one before it"), (None, None), (1008, "x y z " * 20_000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, rep string").repartition(3)
    got = near_duplicates(df, small=small, region=region, pivots=pivots).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_region_joins_all_classes():
    rng, many = np.random.default_rng(4), 0
    for _ in range(30):
        base = [rng.choice(200, 40, replace=False) for _ in range(4)]
        sets = []
        for _ in range(40):
            s = base[rng.integers(4)].copy()
            s[: rng.integers(0, 5)] = s[0]  # some members are left out
            sets.append(np.unique(np.append(s, rng.integers(300, 330, rng.integers(0, 8)))).astype(np.uint64))
        up = list(range(len(sets)))

        def find(i, up):
            while up[i] != i:
                i = up[i]
            return i

        want, got = list(up), list(up)
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    want[find(i, want)] = find(j, want)
        cells = []
        links = region_links(sets, leaf=8, pivots=4, cells=cells)
        many += len(cells) > 2
        bounded = bounded_links(links, len(sets), 2)
        assert max(sum(i in both for both in bounded) for i in range(len(sets))) <= 3
        for i, j in bounded:
            got[find(i, got)] = find(j, got)
        same = lambda u: {frozenset(k for k in range(len(u)) if find(k, u) == r) for r in {find(k, u) for k in range(len(u))}}
        assert same(want) == same(got)
    assert many


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op3_jaccard(spark, sf).collect()), key=repr) == brute(rows)


def test_query_begins_with_many_regions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    held = points(rows, common_shingles(rows, 5, 16), 5, 80).cache()
    space = first_regions(rows, held, point_reps(held, "long"), 5, 80)
    assert space.select("region").distinct().count() > 1
    sets = {(r["region"], r["rep"]): np.frombuffer(r["set"], np.uint64) for r in space.collect()}
    assert all(len({k for k in sets if k[0] == region}) > 1 for region, _ in sets if region != "dense")


def test_borders_are_replicated():
    # a chain of sets, each linked with the next four only
    sets = [np.arange(5 * i, 5 * i + 100, dtype=np.uint64) for i in range(100) if i != 50]
    for gap in (0, 1):
        own = [s for i, s in enumerate(sets) if not gap or not 50 <= i < 54]
        cells = []
        links = region_links(own, leaf=8, pivots=4, cells=cells)
        first = [i for c in cells[1:] for i in c.tolist()]
        assert len(first) > len(set(first))  # points on borders stand in more than one cell
        assert len(links) == len(own) - 1 - gap


def test_no_division_needed():
    rng = np.random.default_rng(1)
    base = rng.choice(10_000, 400, replace=False)
    # all points halfway from each other: pivots divide nothing
    sets = [np.unique(np.append(base[:200], 20_000 + 200 * i + np.arange(100))).astype(np.uint64) for i in range(60)]
    sets += [np.append(s[:-3], [99_999]).astype(np.uint64) for s in sets[:3]]
    assert sorted(tuple(sorted(x)) for x in region_links(sets)) == [(0, 60), (1, 61), (2, 62)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_of_near_copies_are_regions_of_their_own(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(6):  # more copies than a rare shingle has, so all shingles of a group are common
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(24):
            own = list(words)
            own[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    held = points(df, common_shingles(df, 5, 16), 5, 80).cache()
    space = first_regions(df, held, point_reps(held, "long"), 5, 80).collect()
    of = {r["one"]: r["rep"] for r in point_reps(held, "long").collect()}
    regions = {}
    for r in space:
        if r["region"].startswith("dense"):
            regions.setdefault(r["region"], set()).add(r["rep"])
    groups = [{of[str(i)] for i in range(24 * g, 24 * g + 24)} for g in range(6)]
    assert all(any(own <= g for g in groups) for own in regions.values()) and set.union(*regions.values()) == set.union(*groups)
    got = near_duplicates(df, id_col="id", region=3000).collect()
    assert all(r["component_id"] == r["id"] // 24 * 24 for r in got)
