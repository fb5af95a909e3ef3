import math

import numpy as np
from pyspark.sql import functions as F

from keepsake.llm.language import DIMS, fit, op8_language, predicted


def brute_vector(text, idf):
    raw = b" " + text.encode() + b" "
    b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in raw)
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            g = b[i : i + n]
            if (n == 1 and g != b" ") or (n == 2 and g != b"  ") or (n == 3 and b"  " not in g):
                code = int.from_bytes(g, "big") | (n - 1) << 24
                k = (code * 2654435761 % 2**32) >> 18
                counts[k] = counts.get(k, 0) + 1
    v = np.zeros(DIMS)
    for k, c in counts.items():
        v[k] = math.log(1 + c) * idf[k]
    return v / (np.linalg.norm(v) or 1), set(counts)


def test_equals_brute_force(spark):
    rows = [(1, "the cat sat", "en"), (2, "a dog ran off", "en"), (3, "der hund", "de"), (4, "die katze, klein", "de"), (5, "le chat", "fr"), (6, "", "fr"), (7, "the cat sat", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, sample=100, centroids=1)
    frequencies = np.zeros(DIMS)
    for _, text, _ in rows:
        frequencies[list(brute_vector(text, np.ones(DIMS))[1])] += 1
    idf = np.log((1 + len(rows)) / (1 + frequencies)) + 1
    assert np.allclose(model["idf"], idf)
    centres = {}
    for lang in ("de", "en", "fr", "xx"):  # one centroid: the mean, to length one
        own = [brute_vector(text, idf)[0] for _, text, k in rows if k == lang and text]
        centres[lang] = np.mean(own, axis=0) / np.linalg.norm(np.mean(own, axis=0))
    asked = [(i, t) for i, t in enumerate(["the dog", "katze", "chat chat", "the cat sat", "zzz"])]
    for r in predicted(spark.createDataFrame(asked, "doc_id long, text string"), model).collect():
        cosine = {k: float(brute_vector(r["text"], idf)[0] @ c) for k, c in centres.items()}
        best = max(cosine, key=lambda k: (round(cosine[k], 6), [-ord(c) for c in k]))  # ties to the first in order
        assert abs(r["language"]["score"] - cosine[best]) < 1e-5 and r["language"]["lang"] == best


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "same text", lang) for i, lang in enumerate(["b", "a", "c"] * 5)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert predicted(spark.createDataFrame([("same text",)], "text string"), model).first()["language"]["lang"] == "a"


def test_odd_rows(spark):
    texts = {"en": "the house and the thing with the other", "de": "das haus und die sache mit der anderen", "ja": "これは日本語のテキストです"}
    rows = [(i, texts[lang] + f" {i}", lang, "x") for i, lang in enumerate(list(texts) * 20)] + [(100, "no language", None, "x"), (101, None, "en", "x"), (None, "the", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = fit(df, sample=10, centroids=2)
    odd = [(1, None), (2, ""), (3, "123 -- !?"), (4, "das haus"), (5, "日本語"), (6, "the thing " * 50_000), (6, "the thing"), (None, "und die")]
    got = [(r["doc_id"], r["language"]["lang"]) for r in predicted(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "ja"), (6, "en"), (6, "en"), (None, "de")]
    far = predicted(spark.createDataFrame([(1, "qqq zzz xxx")], "doc_id long, text string"), model).first()["language"]
    assert far["rejected"] and far["lang"] in texts
    assert {r["language"]["lang"] for r in predicted(df, fit(df.limit(0))).collect()} == {"und"}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op8_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where(F.col("lang_pred") == F.col("lang")).count() > 0.97 * got.count()
