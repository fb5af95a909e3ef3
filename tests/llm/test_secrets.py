import hashlib
import random

from keepsake.llm.secrets import BASE, KINDS, SCOPE, base_findings, op4_secrets, weak_candidates, with_spans


def brute(text, scope=SCOPE):
    text = text or ""
    base = base_findings(text)
    weak = weak_candidates(text, base)
    role = {"assign": "secret", "hex": "secret", "access": "identifier", "id": "identifier", "key": "key", "endpoint": "endpoint"}
    needs = {"id": ("secret", "key"), "key": ("identifier", "endpoint"), "endpoint": ("secret", "key")}
    keep = [w for w in weak if any(role[k] in needs[w[0]] and s <= w[2] + scope and e >= w[1] - scope for k, s, e in base + weak)]
    return sorted(set(base + keep), key=lambda x: (x[1], KINDS.index(x[0])))


def made_up():
    rng = random.Random(7)
    ident, secret = "AK" + "IA" + "Q" * 16, "aB3" * 9
    bits = [ident, "pass" + "word = 'abcdefghijkl0'", "tok" + "en:short", "0123456789abcdef01", secret, "user: alice", "https://db.example.com/x", "host.example.org:5432", "é😀 plain words "]
    texts = [None, "", "nothing here", ident, secret, secret + " " * 500 + ident, secret + " " * 100 + ident, "user=bob", "user=bob " + "tok" + "en=tok" + "en=abcdefghijkl"]
    for _ in range(120):
        texts.append("".join(rng.choice(bits) + " " * rng.choice([1, 3, 100, 230, 260, 700]) for _ in range(rng.randint(1, 12))))
    texts.append(("user: alice " + secret + " ") * 3000)
    return texts


def test_linking_equals_brute_force(spark):
    texts = made_up()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[20], None), (5, texts[20], None), (None, texts[21], "x")]
    got = with_spans(spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute(r["text"]), r["text"]


def test_base_is_what_the_patterns_say():
    assert base_findings("API_KEY : \"abcdefghijkl\"") == [("assign", 0, 23)]
    assert base_findings("to" + "ken=abc token=abcdefghijkl") == [("assign", 10, 28)]
    assert base_findings("0123456789abcdef") == [("hex", 0, 16)] and base_findings("0123456789abcde") == []
    assert set(BASE) == set(KINDS[:3])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_secrets(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        base = [x for x in want if x[0] in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[0] == k for x in base) for k in BASE)
