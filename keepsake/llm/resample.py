"""Importance resampling towards a target distribution, over hashed n-gram buckets.

Features are runs of 1 to 3 consecutive words; a feature's bucket is the crc32 of its bytes modulo the
number of buckets. A bucket's gain is the scaled logarithm of how much commoner it is in the target than
in the corpus; a document weighs the sum of its features' gains, and what Gumbel noise from a hash of its
id adds to that ranks it: the highest scores are a sample without replacement, drawn in proportion to the
documents' importance.

Vocabulary of head and tail: words that make up a fixed share of all words at least are counted over the whole corpus and
broadcast with their crc states (of the word, and of a space and the word); pairs of them that are as frequent are
broadcast with their bucket and state. The state of a longer feature is the state of its beginning moved
on by the length of its last word (a linear map, from a table) xor the state of that word, so features of head words
cost a few array operations. Features with a word of the tail are hashed directly from their bytes. Both give the same
exact buckets: the head decides on speed alone, never on a result.

Bounds: a share of 1 in ``share`` words admits ``share`` head words and pairs at most, whatever the input; totals are
``buckets`` numbers a task. Ranks come from one sort by range over four numbers a document, numbered within partitions.

Edge cases: null texts and texts without words have no features, weight 0, and are never drawn; a null id counts as the
empty text in the hash and comes last among ties. Rows that repeat an id are documents of their own. An
empty corpus gives an empty result; an empty target has T = 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import documents, saved, table

#: A-Z to a-z; everything that belongs to no word to a space.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Longer words belong to the tail.
LONGEST = 40
#: Words that a task handles at a time, and words among which it looks for frequent ones.
SLICE, COUNTED = 1 << 17, 1 << 19
LOOKUP = (1 << 18) - 1


def words_of(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and all beyond ASCII, with A-Z lower-cased."""
    return text.translate(_PLAIN).split() if text else []


def shift_tables(longest: int) -> np.ndarray:
    """For each length and each byte of a crc32, what that byte becomes when so many bytes follow: [length, place, value]."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    out[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for n in range(longest):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ step[out[n] & np.uint32(255)]
    return out


_SHIFT = shift_tables(LONGEST + 1)


def moved_on(state: np.ndarray, length: np.ndarray, then: np.ndarray) -> np.ndarray:
    """crc32 of two runs of bytes joined, from the crc32 of the first, the length of the second and its crc32."""
    flat = _SHIFT.reshape(-1)
    base = length * 1024
    out = then.copy()
    for k in range(4):
        out ^= flat[base + 256 * k + ((state >> np.uint32(8 * k)) & np.uint32(255))]
    return out


class Head:
    """Frequent words with their states, frequent pairs with their buckets and states."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.number = {w: i for i, w in enumerate(words)}
        self.state = np.array([zlib.crc32(w) for w in words] + [0], dtype=np.uint32)
        self.after = np.array([zlib.crc32(b" " + w) for w in words] + [0], dtype=np.uint32)
        self.length = np.array([len(w) + 1 for w in words] + [0], dtype=np.int64)
        self.buckets = buckets
        # a table with one place a slot: of pairs that meet there one stays, the others go through states
        self.key = np.full(LOOKUP + 1, -1, dtype=np.int64)
        self.pair_state, self.pair_bucket = np.zeros(LOOKUP + 1, np.uint32), np.zeros(LOOKUP + 1, np.int64)
        for a, b in reversed(pairs):  # the commonest last
            if a in self.number and b in self.number:
                key = self.number[a] << 32 | self.number[b]
                at = int(self.slot(np.array([key]))[0])
                self.key[at], self.pair_state[at] = key, zlib.crc32(a + b" " + b)
                self.pair_bucket[at] = int(self.pair_state[at]) % buckets

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(0x9E3779B97F4A7C1 | 1)) >> np.int64(31)) & np.int64(LOOKUP)

    def features(self, words: list[bytes], starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For 1, 2 and 3 words: the buckets of all features of the texts that begin at ``starts``, and the place of each feature's first word."""
        n = len(words)
        ids = np.fromiter(map(self.number.get, words, [-1] * n), dtype=np.int64, count=n)
        first = np.zeros(n + 1, dtype=bool)
        first[starts[starts < n]] = True
        whole = [np.arange(n)]
        for k in (1, 2):  # no text begins among the words that follow
            at = whole[-1][whole[-1] + k < n]
            whole.append(at[~first[at + k]])
        buckets = []
        state = self.state[ids]
        for k, at in enumerate(whole):
            tail = ids[at] < 0
            for j in range(1, k + 1):
                tail |= ids[at + j] < 0
            if k == 0:
                bucket = state.astype(np.int64) % self.buckets
            elif k == 1:
                two = np.zeros(n, dtype=np.uint32)
                key = ids[at] << np.int64(32) | ids[at + 1]
                slot = self.slot(key)
                known = (self.key[slot] == key) & ~tail
                bucket = np.zeros(len(at), dtype=np.int64)
                bucket[known], two[at[known]] = self.pair_bucket[slot[known]], self.pair_state[slot[known]]
                rest = ~known & ~tail
                a = at[rest]
                two[a] = moved_on(state[a], self.length[ids[a + 1]], self.after[ids[a + 1]])
                bucket[rest] = two[a].astype(np.int64) % self.buckets
            else:
                bucket = np.zeros(len(at), dtype=np.int64)
                a = at[~tail]
                bucket[~tail] = moved_on(two[a], self.length[ids[a + 2]], self.after[ids[a + 2]]).astype(np.int64) % self.buckets
            direct = np.flatnonzero(tail)
            if len(direct):
                bucket[direct] = np.fromiter((zlib.crc32(b" ".join(words[i : i + k + 1])) % self.buckets for i in at[direct].tolist()), dtype=np.int64, count=len(direct))
            buckets.append(bucket)
        return buckets, whole


def _slices(texts, most: int = SLICE):
    """Runs of texts with about ``most`` words: (words, start of each text and the end); a longer text is a run of its own."""
    words: list[bytes] = []
    starts = [0]
    for t in texts:
        words += words_of(t)
        starts.append(len(words))
        if len(words) >= most:
            yield words, np.array(starts)
            words, starts = [], [0]
    if len(starts) > 1:
        yield words, np.array(starts)


def _frequent(share: int):
    """Words, and pairs of words, with at least 1 in ``share`` of a slice's: whoever has that share of the corpus has it of a slice."""

    def run(batches):
        totals: Counter = Counter()
        for pdf in batches:
            for words, starts in _slices(pdf["text"], COUNTED):
                least = max(1, len(words) // share)
                count = Counter(words)
                own = [w for w, n in count.items() if n >= least and len(w) <= LONGEST]
                totals.update({(w, None): count[w] for w in own})
                number = {w: i for i, w in enumerate(own)}
                ids = np.fromiter(map(number.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
                inner = np.ones(max(len(words) - 1, 0), dtype=bool)
                inner[starts[(starts > 0) & (starts < len(words))] - 1] = False
                both = inner & (ids[:-1] >= 0) & (ids[1:] >= 0)
                keys, n = np.unique((ids[:-1] << np.int64(32) | ids[1:])[both], return_counts=True)
                often = n >= least
                totals.update({(own[k >> 32], own[k & 0xFFFFFFFF]): c for k, c in zip(keys[often].tolist(), n[often].tolist(), strict=True)})
                totals["words"] += len(words)
                if len(totals) > 1 << 19:
                    yield _counted(totals)
                    totals.clear()
        if totals:
            yield _counted(totals)

    return run


def _counted(totals: Counter) -> pd.DataFrame:
    rows = [(None, None, n) if k == "words" else (*k, n) for k, n in totals.items()]
    return pd.DataFrame(rows, columns=["a", "b", "n"])


def head_of(texts: DataFrame, buckets: int, share: int) -> Head:
    """The head over all of ``texts`` (column text, binary): at most ``share`` words and ``share`` pairs."""
    counted = saved(texts.mapInPandas(_frequent(share), "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "head")
    total = counted.where("a is null").agg(F.sum("n")).first()[0] or 0
    often = counted.where(F.col("a").isNotNull() & (F.col("n") * share >= total)).orderBy(F.desc("n"), "a", "b").collect()
    return Head([bytes(r["a"]) for r in often if r["b"] is None], [(bytes(r["a"]), bytes(r["b"])) for r in often if r["b"] is not None], buckets)


def bucket_totals(texts: DataFrame, shared, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for pdf in batches:
            for words, starts in _slices(pdf["text"]):
                for b in shared.value.features(words, starts)[0]:
                    total += np.bincount(b, minlength=buckets)
        used = np.flatnonzero(total)
        if len(used):
            yield pd.DataFrame({"bucket": used.astype(np.int32), "n": total[used]})

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of a bucket's smoothed shares), in doubles."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def noise(seed: int, doc_id) -> int:
    """floor(-1000 * ln(-ln u)), u from the first 32 bits of sha256 of ``seed:doc_id``."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(shared, gain, seed):
    def run(batches):
        g = gain.value
        for pdf in batches:
            n_words, n_features, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for words, starts in _slices(pdf["text"]):
                ends = np.zeros(len(words) + 1, dtype=np.int64)
                for bucket, at in zip(*shared.value.features(words, starts), strict=True):
                    ends[at + 1] += g[bucket]
                summed = np.cumsum(ends)[starts]
                size = np.diff(starts)
                n_words.append(size)
                n_features.append(size + np.maximum(size - 1, 0) + np.maximum(size - 2, 0))
                weight.append(np.diff(summed))
            w = np.concatenate(weight)
            extra = np.array([noise(seed, i) for i in pdf["name"]], dtype=np.int64)
            yield pd.DataFrame({"name": pdf["name"], "n_words": np.concatenate(n_words), "n_features": np.concatenate(n_features), "weight": w, "score": w + extra})

    return run


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10000, least_words: int = 20, percent: int = 5, seed: int = 42, share: int = 1 << 15) -> DataFrame:
    """Each row's id, n_features, weight, score and rank (1 is the highest; null where not drawn).

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn, by score and then the smaller id.
    """
    spark = docs.sparkSession
    body = F.col(text_col).cast("binary").alias("text")
    head = spark.sparkContext.broadcast(head_of(docs.select(body), buckets, share))
    corpus = bucket_totals(docs.select(body), head, buckets)
    gain = spark.sparkContext.broadcast(gains(corpus, bucket_totals(target.select(body), head, buckets)))
    rows = docs.select(F.col(id_col).cast("string").alias("name"), body)
    scored = rows.mapInPandas(_scores(head, gain, seed), "name string, n_words long, n_features long, weight long, score long")
    scored = scored.withColumn("id", F.col("name").cast(docs.schema[id_col].dataType)).drop("name")
    # a number of its own tells rows apart that are alike, so that no range of the sort must hold them all
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= least_words
    draw = percent * scored.where(fit).count() // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = scored.withColumn("fit", fit).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = saved(ranged.withColumns({"part": F.spark_partition_id(), "place": place}), "ranged")
    before, offsets = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    # one row a partition of the sort
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    rank = F.col("before") + F.col("place") + 1
    return ranged.join(starts, "part").select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))


def op12_resample(spark, sf_dir):
    return resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def _crc_table() -> list[int]:
    return [int(x) for x in _SHIFT[1, 0]]


def _features_sql(table_: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT {key}, w, list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS f
  FROM (SELECT {key}, regexp_extract_all({lowered}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table_})"""


OP12_SQL = f"""
WITH d AS MATERIALIZED ({_features_sql("(SELECT row_number() OVER () AS row, doc_id, text FROM documents)", "row, doc_id")}),
b AS MATERIALIZED ({_features_sql("benchmark", "item_id")}),
df AS MATERIALIZED (SELECT row, unnest(f) AS f FROM d), bf AS MATERIALIZED (SELECT unnest(f) AS f FROM b),
crc AS MATERIALIZED (SELECT f, xor(4294967295::BIGINT, list_reduce([('0x' || h[2 * i - 1 : 2 * i])::BIGINT for i in range(1, len(h) // 2 + 1)],
    lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf))),
s AS (SELECT bucket, count(*) AS n FROM df JOIN crc USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bf JOIN crc USING (f) GROUP BY 1),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM crc) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT row, sum(gain)::BIGINT AS weight FROM df JOIN crc USING (f) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT row, doc_id, len(w) >= 20 AS fit, len(f) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (row))
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) FROM x WHERE fit) * 5 // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id NULLS LAST, row) AS place FROM x)
"""
