import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm.common import words_of
from keepsake.llm.suffix_tree import DEPTH, MASS, Table, collected, grow, op10_suffix_tree, scored, symbols_of, windows


def brute_base(train, texts):
    c = Counter(w for t in train for w in [*words_of(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for t in texts:
        tokens = [*words_of(t), None]
        out.append((len(tokens), sum(x in c for x in tokens), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)))
    return out


def brute_tree(train, least, gain):
    """Counts and retained contexts, straight from the definition."""
    n = Counter()
    for t in train:
        s = symbols_of(words_of(t)).tolist()
        for i in range(DEPTH, len(s)):
            for d in range(DEPTH + 1):
                n[tuple(s[i - d : i]), s[i]] += 1
    total, after = Counter(), {}
    for (ctx, x), k in n.items():
        total[ctx] += k
        after.setdefault(ctx, []).append(x)
    kept = {()}
    for ctx in total:
        if ctx and total[ctx] >= least:
            up = ctx[1:]
            g = sum(n[ctx, x] * math.log((n[ctx, x] / total[ctx]) / (n[up, x] / total[up])) for x in after[ctx])
            if g >= gain:
                kept |= {ctx[i:] for i in range(len(ctx))}
    return n, total, kept


def brute_score(model, text):
    n, total, kept = model

    def p(ctx, x):
        up = 1 / 256 if not ctx else p(ctx[1:], x)
        if ctx and ctx not in kept:
            return up
        return (n[ctx, x] + MASS * up) / (total[ctx] + MASS) if total[ctx] else up

    s = symbols_of(words_of(text)).tolist()
    return sum(math.log10(p(tuple(s[i - DEPTH : i]), s[i])) for i in range(DEPTH, len(s)))


TRAIN = ["the cat sat on the mat", "The cat ate the rat", "", None, "der hund und der rat éß", "the cat sat on the mat", "x " * 50] * 3
TEXTS = [None, "", "the cat", "THE dog sat\ton\nthe moon", "日本 the the", "x " * 3000, "zzz"]


def test_scores_equal_brute_force(spark):
    train = spark.createDataFrame([(i, t) for i, t in enumerate(TRAIN)], "doc_id long, text string").repartition(3)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (3, "zzz the", "x"), (None, "the", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    tree = collected(grow(train))
    model = brute_tree(TRAIN, 8, 6.0)
    assert {d: len(c) for d, (c, _) in tree.items()} == {d: sum(len(ctx) == d and ctx in model[2] for ctx, _ in model[0]) for d in range(DEPTH + 1)}
    for frequent, entries in ((3, 1 << 20), (1 << 18, 1 << 20), (1 << 18, 5)):
        got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in scored(df, train, frequent=frequent, most_entries=entries).collect()))
        want = [(d if d is not None else -1, *b[:3], round(b[3], 6), round(brute_score(model, t), 6)) for (d, t, _), b in zip(rows, brute_base(TRAIN, [t for _, t, _ in rows]), strict=True)]
        assert got == sorted(want)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scored(df, df.limit(0)).collect()}
    assert got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0
    assert got[1]["score"] == pytest.approx(-4 * math.log10(256)) and got[2]["score"] == pytest.approx(-math.log10(256))
    assert scored(df.limit(0), df).collect() == []


def test_table():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**40, 5000).astype(np.uint64))
    t = Table(codes[::2], np.arange(len(codes[::2]), dtype=float))
    value, missing = t.get(codes)
    assert missing.tolist() == [bool(i % 2) for i in range(len(codes))] and value[::2].tolist() == list(range(len(codes[::2])))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    train = [t for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    want = {d: b for (d, _), b in zip(docs, brute_base(train, [t for _, t in docs]), strict=True)}
    got = op10_suffix_tree(spark, sf)
    for r in got.collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3] and r["base_score"] == pytest.approx(want[r["doc_id"]][3], abs=1e-6)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    # on texts it did not learn from it needs far fewer than the eight bits a byte of the uniform model
    size = sum(len(symbols_of(words_of(t))) - DEPTH for d, t in docs if zlib.crc32(str(d).encode()) % 5 == 1)
    assert got.where("held_out").agg(F.sum("score").alias("s")).first()["s"] > -0.8 * size
