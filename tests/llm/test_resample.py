import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from keepsake.llm.resample import LONGEST, OP12_SQL, Head, head_of, moved_on, op12_resample, resampled, words_of

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, buckets):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets=10000, least=20, percent=5, seed=42):
    own = [features(t, buckets) for _, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, x in target for b in features(x, buckets)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (n, f) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def case():
    rng = random.Random(5)
    head, tail = [f"w{i}" for i in range(30)] + ["É", "日本"], [f"rare{i}" for i in range(4000)] + ["x" * (LONGEST + 5)]
    text = lambda n: "".join(rng.choice(head if rng.random() < 0.9 else tail) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)] + [(1000 + i, docs_text) for docs_text in [text(40)] for i in range(200)]
    docs += [(None, text(30)), (None, None), (2000, None), (2001, ""), (2002, " !? "), (7, "Once More"), (7, "Once More"), (2**60 + 1, text(25)), (3000, text(300_00))]
    return docs, [(i, text(50)) for i in range(8)]


def test_equals_brute_force(spark):
    docs, target = case()
    frame = lambda rows: spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rank int").repartition(5)
    for options in ({}, {"share": 40}, {"buckets": 97, "least_words": 5, "percent": 50, "seed": 1}):
        got = resampled(frame(docs), frame(target), **options)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        o = {"buckets": options.get("buckets", 10000), "least": options.get("least_words", 20), "percent": options.get("percent", 5), "seed": options.get("seed", 42)}
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, **o)


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    empty, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a b c")], schema)
    assert resampled(empty, one).collect() == []
    assert [tuple(r) for r in resampled(one, empty).collect()] == brute([(1, "a b c")], [])


def test_states_and_head(spark):
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.bytes(int(rng.integers(0, 30))), rng.bytes(int(rng.integers(1, LONGEST + 1)))
        got = moved_on(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]), np.array([zlib.crc32(b)], np.uint32))
        assert int(got[0]) == zlib.crc32(a + b)
    words = words_of(b"the cat The dog the\xc3\xa9 cat the cat")
    assert words == [b"the", b"cat", b"the", b"dog", "theé".encode(), b"cat", b"the", b"cat"]
    head = Head([b"the", b"cat"], [(b"the", b"cat")], 1000)
    buckets, _ = head.features(words, np.array([0, 3, 8]))
    want = [[zlib.crc32(b" ".join(t[i : i + n])) % 1000 for t in (words[:3], words[3:]) for i in range(len(t) - n + 1)] for n in (1, 2, 3)]
    assert [b.tolist() for b in buckets] == want
    docs, _ = case()
    texts = spark.createDataFrame([(t,) for _, t in docs], "text string").selectExpr("cast(text as binary) as text")
    found = head_of(texts, 1000, 100)
    count = Counter(w for _, t in docs for w in words_of((t or "").encode()))
    assert set(found.number) == {w for w, n in count.items() if n * 100 >= sum(count.values()) and len(w) <= LONGEST}
    assert (head_of(texts, 1000, 3000).key >= 0).sum() > 100


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = op12_resample(spark, SF)
    want = con.execute(OP12_SQL).fetchall()
    assert [d[0] for d in con.description] == got.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
