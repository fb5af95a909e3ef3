import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from keepsake.llm.common import crc32_mod
from keepsake.llm.quality import DIMS, REACH, ROWS, SHAPES, Shapes, context_vectors, fit, op7_quality, scored, shape_vectors


def test_odd_rows_and_held_out_accuracy(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        good = i % 2
        docs.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "x"))
        labels.append((i, good))
    labels += [(0, 1), (1, None), (2, 7), (None, 1)]  # clashing, null and foreign labels teach nothing
    df = spark.createDataFrame(docs, "doc_id long, text string, quality string").repartition(3)
    lb = spark.createDataFrame(labels, "doc_id long, quality int")
    model = fit(df, lb, crc32_mod("doc_id", 3) != 1, sample=200)
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "x " * 100_000), (9003, "x " * 100_000), (None, "a b")], "doc_id long, text string")
    got = scored(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    held = scored(df, model).where(crc32_mod("doc_id", 3) == 1).collect()
    assert sum((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in held) / len(held) > 0.97
    assert {r["score"] for r in scored(df, fit(df, lb.limit(0))).collect()} == {0.5}
    assert scored(df.limit(0), model).collect() == []


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.where(F.col("predicted") == F.col("quality")).count() > 0.95 * got.count()


def brute_index(word):
    h, v = xxhash.xxh64_intdigest(word), [0] * DIMS
    for k in range(4):
        v[h >> (6 * k) & (DIMS - 1)] += -1 if h >> (32 + k) & 1 else 1
    return v


def brute_row(word):
    return (xxhash.xxh64_intdigest(word) >> 40) % ROWS


def test_contexts_equal_brute_force(spark):
    texts = ["a b c d a b", "b", None, "", "x a x a", "é b a " * 3]
    got = context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), buckets=4)
    want = np.zeros((ROWS, DIMS))
    for t in texts:
        words = (t or "").encode().split()
        for i, w in enumerate(words):
            for j in range(max(0, i - REACH), min(len(words), i + REACH + 1)):
                if j != i:
                    want[brute_row(w)] += brute_index(words[j])
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["good", "fine", "words", "Here."]) if i % 2 else rng.choice(["BUY", "now!!!", "$$$", "$$$"]) for _ in range(30))) for i in range(60)] + [(60, None), (61, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(df, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    shapes, memo = shape_vectors(), Shapes()
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for r in scored(df.selectExpr("doc_id", "text", "1 AS quality", "true AS held_out", "0 AS predicted"), model).collect():
        words = (r["text"] or "").encode().split()
        x = [0.0] * (3 * DIMS + 1)
        if words:
            shape = [(SHAPES // 2) * (k > 0 and words[k - 1] == w) + int(memo.of([w])[0]) for k, w in enumerate(words)]
            parts = [np.sum([brute_index(w) for w in words], axis=0), np.sum([model["contexts"][brute_row(w)] for w in words], axis=0), np.sum([shapes[k] for k in shape], axis=0)]
            x = [*np.concatenate([unit(v) for v in parts]), np.log1p(len(words)) / 10]
        net = model["net"]
        hidden = [max(0.0, sum((a - m) / s * w for a, m, s, w in zip(x, net["mean"], net["std"], net["w1"][:, j], strict=True)) + net["b1"][j]) for j in range(len(net["b1"]))]
        logit = (sum(a * b for a, b in zip(hidden, net["w2"], strict=True)) + net["b2"][0]) / net["temperature"]
        assert abs(r["score"] - 1 / (1 + np.exp(-logit))) < 1e-6


def test_words_of_one_shape_differ(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["river", "stone", "cloud", "grass"] if i % 2 else ["spamy", "junky", "scamx", "clack"]) for _ in range(25)), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = fit(df, df.select("doc_id", "quality"), crc32_mod("doc_id", 3) != 1)
    held = scored(df, model).where(crc32_mod("doc_id", 3) == 1).collect()
    assert all((r["score"] >= 0.5) == bool(r["quality"]) for r in held)
