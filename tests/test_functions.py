"""Text functions, names and vectors against plain Python."""

import datetime
import json
import math
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.functions import embed, entities
from keepsake.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_parse_since():
    assert X.parse_since("30d") == datetime.timedelta(days=30) and X.parse_since(" 2w ") == datetime.timedelta(days=14)
    assert X.parse_since("1h30m") == datetime.timedelta(minutes=90) and X.parse_since("") == datetime.timedelta(0)
    for bad in ("3x", "d", "1 h"):
        with pytest.raises(ValueError):
            X.parse_since(bad)


def test_lines_and_cuts(spark):
    texts = ["a" * 100, "ß" * 60, "🙂" * 30, "short", "x. y", "A long opening clause; and more of it", " many\n\n spaces ", "日本" * 20 + ".end", "ab" * 35 + "🙂"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.one_line(F.col("t"), 60).alias("line"), X.title_line(F.col("t")).alias("title"), X.cut_bytes(F.col("t"), 50, "!").alias("cut")).collect()

    def whole(raw, n):
        while n and len(raw) > n and raw[n] & 0xC0 == 0x80:
            n -= 1
        return raw[:n].decode()

    for r in rows:
        flat = " ".join(r["t"].split())
        assert r["line"] == (flat if len(flat.encode()) <= 60 else whole(flat.encode(), 59) + "…")
        head = next((flat[:i] for i, c in enumerate(flat) if c in ".;"), flat)
        title = head if len(head.encode()) > 12 else flat
        assert r["title"] == (title if len(title.encode()) <= 72 else whole(title.encode(), 71) + "…")
        assert r["cut"] == (r["t"] if len(r["t"].encode()) <= 50 else whole(r["t"].encode(), 50) + "!")


def test_ago_badges_and_imperatives(spark):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    for then, want in (("2024-02-01 11:59:30", "now"), ("2024-02-01 11:10:00", "50m"), ("2024-01-31 11:00:00", "25h"), ("2024-01-20 12:00:00", "12d"), ("2023-01-01 00:00:00", "2023-01-01"), (None, "-")):
        assert one(spark, then, lambda t: X.ago(t.cast("timestamp"), now)) == want
    assert one(spark, "aging", X.badge) == " [aging]" and one(spark, "active", X.badge) == ""
    assert one(spark, " Use tabs. ", X.normalised_imperative) == "Preference (user-stated): Use tabs."
    assert one(spark, "alpha beta beta gamma x", lambda t: X.covered_by(t, F.array(*map(F.lit, ["alpha", "beta", "gamma"])))) is True
    assert one(spark, "", lambda t: X.covered_by(t, F.array(F.lit("a")))) is False
    assert abs(one(spark, "aabb", X.entropy) - 1.0) < 1e-12
    assert one(spark, "Bob", lambda t: X.clean_aliases(F.array(F.lit(" rob "), F.lit("ROB"), F.lit("bob"), F.lit(""), F.lit("Al")), t)) == ["Al", "rob"]


def test_words_of_a_list_are_found_by_hash(spark):
    held = [f"w{i}" for i in range(40)]
    texts = ["w1 W2, w2 w3 x", "w1 x y", "", None, "w39"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    listed = df.select(X.covered_by(F.col("t"), held).alias("x"))
    assert [r["x"] for r in listed.collect()] == [r["x"] for r in df.select(X.covered_by(F.col("t"), F.array(*map(F.lit, held))).alias("x")).collect()] == [True, False, False, None, True]
    assert "INSET" in listed._jdf.queryExecution().optimizedPlan().toString()  # not one word after another
    assert not one(spark, "w1", lambda t: X.covered_by(t, []))


def test_shingle_hashes_agree_with_shingles(spark):
    for t in ("a b", "a b c", "a b c d e f", "a b c d e f g a b c d e f"):
        assert one(spark, t, lambda c: F.size(X.shingles(X.tokens(c)))) == one(spark, t, lambda c: F.size(X.shingle_hashes(X.tokens(c))))


def found_names(spark, texts, known=None):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    known = known and spark.createDataFrame([(k,) for k in known], "name string")
    out = {}
    for r in sorted(entities.names(df, "id", "body", known).collect(), key=lambda r: (r["id"], r["rule"], r["place"])):
        out.setdefault(r["id"], []).append((r["name"], r["type"]))
    return [out.get(i, []) for i in range(len(texts))]


def brute_names(text, known=()):
    """Every match of every rule in order, kept if it counts and its name is new."""
    said = [(m[g] if p != entities.HANDLE else "@" + m[g], kind, True) for p, g, kind in entities.RULES for m in re.finditer(p.replace("$", r"\Z"), text or "", re.ASCII)]
    for m in re.finditer(entities.PROPER, text or "", re.ASCII):
        words, opens = m[0].split(), re.search(r"(\A|[.!?\n:\-])[ \t]*\Z", text[: m.start()])
        person = re.match(entities.TITLES, m[0]) or (len(words) == 2 and not re.search("[0-9]", m[0]))
        if m[0].lower() in known:
            said.append((m[0], "other", True))
        else:
            said.append((m[0], "person" if person else "other", words[0].lower() not in entities.STOPWORDS if len(words) > 1 else not opens))
    named = {}
    for name, kind, counts in said:
        name = name.strip(".,;:!?").strip()
        if counts and name and name.lower() not in entities.STOPWORDS:
            named.setdefault(name.lower(), (name, kind))
    return list(named.values())


def test_entities(spark):
    text = "Ping ana.b@site.org or @kim. Rhea Solano runs acme/core-lib with Postgres. Deploys use Kafka: Nightly Runs. Monday, we met; then Orbit Labs, fine."
    odd = ["Kafka is up", None, "", "we met Dr. Ada Lovelace\nToday and  Tom - Rhen", "a.b@c.org A.B@C.ORG (@x_y @zed) é@café.fr", "The Big Plan. the Big Plan, Foo Inc.", "x/y.z a-b/c_d. Ab Cd Ef", "Zürich München İstanbul Postgres9 Alpha9 Beta", "Acme Corp.", "Line\nBreak Here Labs "]
    got = found_names(spark, [text, *odd])
    assert got == [brute_names(t) for t in [text, *odd]]
    assert {("ana.b@site.org", "person"), ("@kim", "person"), ("Rhea Solano", "person"), ("acme/core-lib", "project"), ("Postgres", "other"), ("Orbit Labs", "org"), ("Kafka", "other")} <= set(got[0])
    assert not {n for n, _ in got[0]} & {"Ping", "Deploys", "Monday"}
    assert found_names(spark, ["So. Ab\u000bCd Ef"]) == [[("Cd Ef", "person")]]  # a vertical tab is no white space here
    assert found_names(spark, ["Kafka is up"], ["kafka"]) == [[("Kafka", "other")]]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    assert found_names(spark, [r["text"] for r in docs]) == [brute_names(r["text"]) for r in docs]
    assert tuple(one(spark, "by Ana Bell <ana@site.org>", entities.named_email)) == ("Ana Bell", "ana@site.org") and one(spark, "none", entities.named_email) is None


def test_folding(spark):
    assert one(spark, "Café naïve Über", X.folded) == "Cafe naive Uber" and one(spark, None, X.folded) is None and one(spark, "plain", X.folded) == "plain"


def brute_hash_vector(text, dims):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    words = "".join(c if c.isalpha() or c.isnumeric() else " " for c in text.lower()).split()
    v = [0.0] * dims
    for i, w in enumerate(w.encode() for w in words):
        feats = [(b"u:" + w, 1.0)] + [(b"c:" + w[j : j + 3], 0.25) for j in range(len(w) - 2)]
        if i + 1 < len(words):
            feats.append((b"b:" + w + b"_" + words[i + 1].encode(), 0.75))
        for f, x in feats:
            h = fnv(f)
            v[h % dims] += -x if h >> 63 else x
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def test_hash_embedding(spark):
    e = embed.HashEmbedder(64)
    for t in ("Invoices go to the billing inbox", "naïve café", "", "x"):
        assert np.allclose(one(spark, t, e.column), brute_hash_vector(t, 64), atol=1e-6)
    assert len(one(spark, None, e.column)) == 64


def test_static_model(spark):
    vocab = {"[UNK]": 0, "deploy": 1, "##s": 2, "on": 3, "friday": 4, "cafe": 5, ".": 6}
    matrix = np.arange(28, dtype=np.float32).reshape(7, 4)
    for dtype, raw in (("F32", matrix.tobytes()), ("F16", matrix.astype("<f2").tobytes())):
        header = json.dumps({"embeddings": {"dtype": dtype, "shape": [7, 4], "data_offsets": [0, len(raw)]}}).encode()
        model = embed.StaticModel("m", struct.pack("<Q", len(header)) + header + raw, json.dumps({"model": {"type": "WordPiece", "vocab": vocab}}))
        assert model.pieces("Deploys on Café.") == [1, 2, 3, 5, 6] and model.pieces("zzz") == [0]
        want = matrix[[1, 2, 3]].mean(0)
        assert np.allclose(one(spark, "Deploys on", model.column), want / np.linalg.norm(want), atol=1e-6)
        assert one(spark, "", model.column) == [0.0] * 4
    assert embed.float16(struct.pack("<e", 6e-8))[0] > 0
