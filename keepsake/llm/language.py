"""Language identification by nearest centroids.

A text is the hashed counts of its byte 1- to 3-grams inside words (A-Z lower-cased, every other
byte that is no letter as a blank), weighted by log(1 + count) times the inverse document
frequency, scaled to length one. Document frequencies are counted over all training documents.
Each language has several centroids, found by spherical k-means on a bounded sample; a text gets
the language of the centroid with the highest cosine. A text farther from its centroid than nearly
all training texts of that language (``reject_quantile``) is marked ``rejected``.

Edge cases: null text, or text without any letter, is ``und`` with score 0 and is rejected. Rows
whose language is null teach nothing; languages with one text have one centroid. Where there is
nothing to learn from, every text is ``und``. Ties go to the first language in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import hash_sample

#: Fixed parameters: hashed dimensions, training texts a language for the centroids, centroids a language.
DIMS, SAMPLE, CENTROIDS = 1 << 14, 1500, 4
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32
#: White space that is encoded in several bytes counts as other bytes do; it is part of no alphabet.


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and their counts."""
    raw = np.frombuffer((" " + (text or "") + " ").encode("utf-8", "surrogatepass"), np.uint8)
    b = _FOLD[raw].astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    blank = np.uint32(0x2020)
    grams = np.concatenate([b[b != 32], two[two != blank] | np.uint32(1 << 24), three[(three & np.uint32(0xFFFF) != blank) & (three >> np.uint32(8) != blank)] | np.uint32(2 << 24)])
    total = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - 14), minlength=DIMS)
    held = np.flatnonzero(total)
    return held, total[held]


def vector(held: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = np.log1p(counts) * idf[held]
    norm = np.linalg.norm(w)
    return w / norm if norm else w


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The number of texts that hold each hashed n-gram, over all of them: one counter a task and dimension is moved."""

    def run(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                df[counts_of(t)[0]] += 1
                n += 1
        yield pd.DataFrame({"dim": np.append(np.flatnonzero(df), DIMS), "n": np.append(df[df > 0], n)})

    out = np.zeros(DIMS + 1, np.int64)
    for r in texts.select("text").mapInPandas(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        out[r["dim"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; the first is the mean, each next starts at the text farthest from all before."""
    centres = [x.mean(0)]
    near = x @ centres[0] / max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                m = x[own == i].mean(0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(docs: DataFrame, learn_from=None, sample: int = SAMPLE, centroids: int = CENTROIDS, reject_quantile: float = 0.001) -> dict:
    """A model from text and lang of the rows of ``learn_from``; about ``sample`` texts a language form centroids, chosen by a hash of id and text."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def one_language(pdf: pd.DataFrame) -> pd.DataFrame:
        """The centroids of the ``sample`` texts of a language, so many bytes whatever the corpus holds."""
        kept = pdf[[has_letter(t) for t in pdf["text"]]].sort_values("__key")
        if not len(kept):
            return pd.DataFrame({"lang": [], "place": [], "c": [], "limit": []})
        x = np.zeros((len(kept), DIMS), np.float32)
        for i, t in enumerate(kept["text"]):
            held, counts = counts_of(t)
            x[i, held] = vector(held, counts, shared.value)
        c = spherical_kmeans(x, centroids)
        least = float(np.quantile((x @ c.T).max(1), reject_quantile))
        return pd.DataFrame({"lang": kept["lang"].iloc[0], "place": range(len(c)), "c": [v.astype("<f4").tobytes() for v in c], "limit": least})

    chosen = hash_sample(rows, sample, "lang").select("__key", "lang", "text")
    found = chosen.groupBy("lang").applyInPandas(one_language, "lang string, place int, c binary, limit double").collect()
    found.sort(key=lambda r: (r["lang"], r["place"]))
    langs, limits, centres = [r["lang"] for r in found], [r["limit"] for r in found], [np.frombuffer(r["c"], "<f4")[None] for r in found]
    return {"idf": idf, "langs": langs, "centres": np.vstack(centres).astype(np.float32) if centres else np.zeros((0, DIMS), np.float32), "limits": limits}


def predicted(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct lang, score (cosine, 0 to 1), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        m, rows = shared.value, []
        for t in texts:
            if not m["langs"] or not has_letter(t):
                rows.append((UNKNOWN, 0.0, True))
                continue
            held, counts = counts_of(t)
            cosine = m["centres"][:, held] @ vector(held, counts, m["idf"])
            best = int(np.argmax(cosine))
            rows.append((m["langs"][best], float(min(max(cosine[best], 0.0), 1.0)), bool(cosine[best] < m["limits"][best])))
        return pd.DataFrame(rows, columns=["lang", "score", "rejected"])

    return docs.withColumn(out_col, run(F.col(text_col)))


def op8_language(spark, sf_dir):
    from keepsake.llm.common import crc32_mod, documents

    docs = documents(spark, sf_dir)
    held_out = crc32_mod("doc_id", 5) == 0
    out = predicted(docs.select("doc_id", "text"), fit(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))
