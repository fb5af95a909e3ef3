"""Recall over planted claims, and its parts against plain Python."""

import math

from pyspark.sql import functions as F

from keepsake.functions import embed
from keepsake.operators import batch_recall, recall
from keepsake.operators.cells import Cells
from keepsake.sources.adapters import now
from test_ledger import claims

PLANTED = {
    "The invoice service retries three times before it gives up": "how many retries does the invoice service make", "Rhea reviews all database migrations": "who reviews migrations of the database", "Staging lives in the Frankfurt region": "which region is staging in",
    "The mobile app is released every second Tuesday": "when is the mobile app released", "Customer exports are kept for ninety days": "how long are customer exports kept", "Feature flags are stored in Redis": "where are feature flags stored",
    "The on-call rotation changes on Monday morning": "when does the on-call rotation change", "Search indexes are rebuilt at midnight": "when are search indexes rebuilt", "Passwords are hashed with argon": "how are passwords hashed", "The design system uses a four pixel grid": "what grid does the design system use",
}


def test_cells_give_what_all_vectors_give(spark, tmp_path):
    m = claims(spark, [(i, c, "active" if i % 3 else "aging", 2) for i, c in enumerate(list(PLANTED) * 6)])
    q = spark.createDataFrame(list(enumerate(PLANTED.values())), "query_id long, query string")
    e = embed.HashEmbedder(64)
    v, asked = m.select("id", e.column(F.col("content")).alias("v")), q.select("query_id", e.column(F.col("query")).alias("v"))
    key = lambda df: sorted((r["query_id"], r["place"], r["id"], r["score"], r["semantic"]) for r in df.collect())
    kept = Cells(spark, str(tmp_path / "c")).build(v)
    allowed = m.where("id % 2 = 0").select("id")
    for a in (None, allowed):
        assert key(batch_recall.recall(m, q, now(), vectors=kept, query_vectors=asked, allowed=a)) == key(batch_recall.recall(m, q, now(), vectors=v, query_vectors=asked, allowed=a))


def test_planted_claims_are_found(spark):
    rows = [(i, c, "active", 2) for i, c in enumerate(PLANTED)] + [(100 + i, f"Note {i} about {w} and other matters of the week", "active", 2) for i, w in enumerate("budget travel lunch hiring desks".split() * 8)]
    m = claims(spark, rows)
    q = spark.createDataFrame(list(enumerate(PLANTED.values())), "query_id long, query string")
    e = embed.HashEmbedder(256)
    for vectors in (None, m.select("id", e.column(F.col("content")).alias("v"))):
        asked = None if vectors is None else q.select("query_id", e.column(F.col("query")).alias("v"))
        hits = batch_recall.recall(m, q, now(), limit=3, vectors=vectors, query_vectors=asked).collect()
        found = {r["query_id"] for r in hits if r["id"] == r["query_id"]}
        assert len(found) >= 8
        assert max(r["place"] for r in hits) <= 3


def test_query_terms(spark):
    many = " ".join(f"t{i}" for i in range(20))
    q = spark.createDataFrame([(1, "What is the Cache, the cache TTL?"), (2, "what is it"), (3, ""), (4, None), (5, many)], "query_id long, query string")
    got = {}
    for r in batch_recall.query_terms(q).collect():
        got.setdefault(r["query_id"], {})[r["term"]] = r["times"]
    assert got == {1: {"cache": 2, "ttl": 1}, 2: {"what": 1, "is": 1, "it": 1}, 5: {f"t{i}": 1 for i in range(12)}}


def test_scores(spark):
    m = claims(spark, [(1, "alpha beta beta", "active", 2), (2, "beta gamma", "tombstoned", 2), (3, "", "active", 2), (4, "delta", "active", 2)])
    terms = spark.createDataFrame([(7, "beta", 2), (7, "delta", 1), (8, "none", 1)], "query_id long, term string, times long")
    score = lambda: sorted((r["query_id"], r["id"], round(r["bm25"], 9)) for r in batch_recall.bm25(batch_recall.matches(m, terms), terms).collect())
    one = score()
    avgdl, idf = 6 / 4, max(math.log((4 - 2 + 0.5) / 2.5), 1e-6)
    assert one[0] == (7, 1, round(2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avgdl)), 9)) and [x[:2] for x in one] == [(7, 1), (7, 2), (7, 4)]


def test_packing_equals_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(s, i, round(rng.random(), 6), rng.choice([20, 20, 35, 90, 200, 650, 900])) for s in ("a", "b") for i in range(120)]
    df = spark.createDataFrame(rows, "scope string, id long, score double, cost long")
    got = {r["scope"]: (r["used"], r["ids"]) for r in recall.context_pack(df, 12, 700, 60).collect()}
    for scope in ("a", "b"):
        used, ids = 60, []
        for _, i, _, cost in sorted((r for r in rows if r[0] == scope), key=lambda r: (-r[2], r[1])):
            if len(ids) < 12 and used + cost <= 700:
                used, ids = used + cost, [*ids, str(i)]
        assert got[scope] == (used, ",".join(ids))
