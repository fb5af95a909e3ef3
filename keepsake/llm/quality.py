"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing gives every word a fixed sparse random index vector of ``DIMS`` places, four of them
1 or -1, all drawn from the word's own 64-bit hash, so there is no table of words and none is left
out. A word's context vector is the sum of the index vectors that stand within two words of it in
all training texts; these sums are a Spark aggregation over every text of the training rows. They
are kept in ``ROWS`` rows by hash of the word, a fixed size: rare words may share a row, in which the
commonest of them weighs most.

A document is the mean over its words of index and context vectors, each scaled to length one,
beside them the same mean over the shapes of its words (runs of capitals, small letters, digits and
marks, and whether a word repeats the one before), and the log of its length. A two-layer numpy
network turns it into a logit; a temperature fitted on texts that the network did not see makes the
logit a probability. Neither ids nor languages, sources or labels are inputs of a score.

The network alone is fitted on a sample: about ``sample`` labelled rows, chosen by a hash.

Edge cases: null and empty texts are scored like a text of no words. Rows that repeat are each
scored. Labels that are null or not 0 or 1, and ids with several labels that differ, teach nothing.
Where no labelled rows are left, or only one class, the score is that class's share (0.5 with none).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import WordHashes, freed, hash_sample, trimmed

#: Fixed parameters of the model: places of index vectors, rows of context vectors, words to either side, shapes, hidden units.
DIMS, ROWS, REACH, SHAPES, HIDDEN = 64, 1 << 14, 2, 2048, 32
#: About so many labelled rows the network is fitted on.
SAMPLE = 12_000

_RUNS = re.compile(rb"[A-Z]+|[a-z\x80-\xff]+|[0-9]+|(.)\1*", re.S)


def _shape(word: bytes) -> bytes:
    def one(m):
        c = m.group()[:1]
        if c.isupper():
            return b"A" if len(m.group()) == 1 else b"AA"
        return b"a" if c.islower() or c >= b"\x80" else b"0" if c.isdigit() else c * min(len(m.group()), 3)

    return _RUNS.sub(one, word)[:12]


class Shapes(dict):
    """Memo of words' shapes as numbers, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = zlib.crc32(_shape(word)) % (SHAPES // 2)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """The upper half are words that repeat the one before."""
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        out[1:] += (SHAPES // 2) * np.fromiter(map(bytes.__eq__, words[1:], words), bool, max(len(words) - 1, 0))
        return out


def shape_vectors() -> np.ndarray:
    return np.random.default_rng(20).choice([-1.0, 0.0, 1.0], p=[0.1, 0.8, 0.1], size=(SHAPES, DIMS))


def index_entries(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (words x 4) of the index vectors of word hashes."""
    k = np.arange(4, dtype=np.uint64)
    places = (h[:, None] >> (k * np.uint64(6)) & np.uint64(DIMS - 1)).astype(np.int64)
    signs = 1.0 - 2.0 * (h[:, None] >> (k + np.uint64(32)) & np.uint64(1)).astype(np.float64)
    return places, signs


def rows_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % ROWS


def add_contexts(h: np.ndarray, sums: np.ndarray) -> None:
    """Adds to each word's row the index vectors within ``REACH`` words of it (``sums`` is flat)."""
    places, signs = index_entries(h)
    rows = rows_of(h) * DIMS
    for k in range(1, min(REACH, len(h) - 1) + 1):
        for own, other in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            np.add.at(sums, (rows[own, None] + places[other]).ravel(), signs[other].ravel())


def context_vectors(texts: DataFrame, buckets: int = 64) -> np.ndarray:
    """Context vectors, to length one, from all texts; what reaches the driver has a fixed size."""

    def run(batches):
        memo, sums = WordHashes(), np.zeros(ROWS * DIMS)
        for pdf in batches:
            for t in pdf["text"]:
                if len(h := memo.of(t.encode("utf-8", "surrogatepass").split() if t else [])) > 1:
                    add_contexts(h, sums)
        for i, part in enumerate(np.split(sums, buckets)):
            yield pd.DataFrame({"bucket": [i], "part": [part.astype("<f8").tobytes()]})

    def add(pdf):
        # sums of whole numbers are exact, whatever their order
        total = np.zeros(ROWS * DIMS // buckets)
        for x in pdf["part"]:
            total += np.frombuffer(x, "<f8")
        return pd.DataFrame({"bucket": pdf["bucket"][:1], "part": [total.astype("<f8").tobytes()]})

    got = texts.select("text").mapInPandas(trimmed(run), "bucket int, part binary").groupBy("bucket").applyInPandas(add, "bucket int, part binary").collect()
    sums = np.zeros((buckets, ROWS * DIMS // buckets))
    for r in got:
        sums[r["bucket"]] = np.frombuffer(r["part"], "<f8")
    sums = sums.reshape(ROWS, DIMS)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.where(norm > 0, norm, 1)).astype(np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v)
    return v / norm if norm else v


class Pooling:
    """Documents as vectors."""

    def __init__(self, contexts: np.ndarray):
        self.contexts, self.shapes, self.hashes, self.memo = contexts, shape_vectors(), WordHashes(), Shapes()

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if not words:
            return np.zeros(3 * DIMS + 1)
        h = self.hashes.of(words)
        places, signs = index_entries(h)
        index = np.bincount(places.ravel(), signs.ravel(), DIMS)
        context = np.zeros(DIMS)
        for at in range(0, len(h), 1 << 16):  # very long texts a part at a time
            context += self.contexts[rows_of(h[at : at + (1 << 16)])].sum(0, dtype=np.float64)
        counts = np.bincount(self.memo.of(words), minlength=SHAPES)
        held = np.flatnonzero(counts)
        return np.concatenate([_unit(index), _unit(context), _unit(counts[held] @ self.shapes[held]), [np.log1p(len(words)) / 10]])

    def all(self, texts) -> np.ndarray:
        return np.array([self.of(t) for t in texts]).reshape(len(texts), 3 * DIMS + 1)


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 1, epochs: int = 60) -> dict:
    """Two layers by Adam with early choice, then the temperature that gives the held-back rows the least loss."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    back, rest = order[: max(1, len(x) // 5)], order[max(1, len(x) // 5) :]
    mean, std = x[rest].mean(0), x[rest].std(0) + 1e-6
    z = (x - mean) / std
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v, t, best = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0, (np.inf, None)

    def logits(q, rows):
        return np.maximum(z[rows] @ q["w1"] + q["b1"], 0) @ q["w2"] + q["b2"]

    def loss(s, rows):
        return float(np.mean(np.logaddexp(0, s) - y[rows] * s))

    for _ in range(epochs):
        for at in np.array_split(rng.permutation(rest), max(1, len(rest) // 128)):
            hidden = np.maximum(z[at] @ p["w1"] + p["b1"], 0)
            d = (1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -30, 30))) - y[at]) / len(at)
            dh = np.outer(d, p["w2"]) * (hidden > 0)
            g = {"w1": z[at].T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": hidden.T @ d + 1e-4 * p["w2"], "b2": np.array([d.sum()])}
            t += 1
            for k in p:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if (now := loss(logits(p, back), back)) < best[0]:
            best = (now, {k: a.copy() for k, a in p.items()})
    p, s = best[1], logits(best[1], back)
    temperature = min(np.geomspace(0.25, 8, 60), key=lambda c: loss(s / c, back))
    return p | {"mean": mean, "std": std, "temperature": float(temperature)}


def probability(net: dict, x: np.ndarray) -> np.ndarray:
    hidden = np.maximum(((x - net["mean"]) / net["std"]) @ net["w1"] + net["b1"], 0)
    s = (hidden @ net["w2"] + net["b2"]) / net["temperature"]
    return 1 / (1 + np.exp(-np.clip(s, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, learn_from=None, sample: int = SAMPLE) -> dict:
    """A model from the texts of ``learn_from`` (a condition on doc_id) and the labels of about ``sample`` of them."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    if learn_from is not None:
        rows = rows.where(learn_from)
    contexts = context_vectors(rows)
    once = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    once = once.where("low = high").select("__id", "low")
    # ids are chosen before any text is moved; then rows, for an id may have many
    ids = hash_sample(rows.join(once, F.col("doc_id") == F.col("__id")).select("doc_id", "low"), 4 * sample, key=("doc_id",)).select("doc_id", "low")
    chosen = hash_sample(rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "low"), sample)
    shared = spark.sparkContext.broadcast(contexts)

    def features(batches):
        pooling = Pooling(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["__key"], "y": pdf["low"], "x": [v.astype("<f4").tobytes() for v in pooling.all(pdf["text"])]})

    got = chosen.select("__key", "low", "text").mapInPandas(trimmed(features), "key long, y int, x binary").toPandas().sort_values("key")
    y = got["y"].to_numpy(np.float64)
    if len(set(y)) < 2 or len(y) < 10:
        return {"contexts": contexts, "share": float(y.mean()) if len(y) else 0.5}
    x = np.array([np.frombuffer(x, "<f4") for x in got["x"]], dtype=np.float64)
    del got
    net = fit_network(x, y)
    del x
    freed()
    return {"contexts": contexts, "net": net}


def scored(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared.value
        pooling = Pooling(held["contexts"])
        for texts in batches:
            yield pd.Series(probability(held["net"], pooling.all(texts)) if "net" in held else np.full(len(texts), held["share"]))
        del pooling
        freed()

    return docs.withColumn(score_col, score(F.col(text_col)))


def op7_quality(spark, sf_dir):
    from keepsake.llm.common import crc32_mod, documents, table

    docs = documents(spark, sf_dir)
    held_out = crc32_mod("doc_id", 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
