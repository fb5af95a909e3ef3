"""Language-model scoring with a probabilistic suffix tree over bytes.

Texts are white-space words (A-Z lower-cased), each followed by a space, and one end symbol. From
all training texts, every run of ``DEPTH`` context bytes and a next byte is counted; the counts of
shorter contexts are their sums. A context is retained if it stands in the corpus at least
``least`` times and its next-byte distribution diverges from that of its longest proper suffix: its
count times the Kullback-Leibler divergence reaches ``gain`` nats. All suffixes of a retained
context are retained. Each state's distribution is smoothed with its suffix's:
p(x | s) = (c(s, x) + m * p(x | suffix of s)) / (c(s) + m), down to the uniform one over 256 bytes.
A text is scored byte by byte from its longest suffix state.

Beside it stands the base score: a unigram model of words with counts over all training texts. Word
counts are joined to the words of each text: the ``frequent`` commonest words (a bound on what is
broadcast) are looked up where they stand, and all others by a shuffle of (row, word, times).

Every context that passes the test is kept, so the tree grows with the corpus. While it has no more
than ``most_entries`` (context, byte) pairs it goes to every task, which scores whole texts at once;
beyond that the same probabilities come from joins of the texts' distinct windows with the tree's
tables. Both ways give the same scores.

Words are told apart by 64-bit hashes. Edge cases: null text counts as empty: one end token. Rows
that repeat are each scored, and each teaches. With nothing to learn from, N and V are 0 and every
byte is uniform. What is broadcast is bounded: ``most_entries`` pairs, ``frequent`` words.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import WordHashes, least_of_most, saved, words_of

#: Fixed parameters: context bytes, smoothing mass, least count and divergence (nats) of a state.
DEPTH, MASS, LEAST, GAIN = 4, 2.0, 8, 6.0
#: The most (context, byte) pairs and words that are sent to every task.
MOST_ENTRIES, FREQUENT = 3_000_000, 1 << 18
#: The end of a text as a symbol and as the hash of a word; \x01 and \x00 stand in no split word's place: they mark end and start.
END, START = 1, 0
END_WORD = np.uint64(0x0123456789ABCDEF)


def symbols_of(words: list[bytes]) -> np.ndarray:
    """DEPTH start symbols, the words with a space after each, the end symbol."""
    return np.frombuffer(bytes([START] * DEPTH) + b"".join([w + b" " for w in words]) + bytes([END]), np.uint8)


def windows(symbols: np.ndarray) -> np.ndarray:
    """For each scored symbol the DEPTH symbols before it and itself as one number, itself lowest."""
    s = symbols.astype(np.uint64)
    n = len(s) - DEPTH
    out = np.zeros(n, np.uint64)
    for k in range(DEPTH + 1):
        out = out << np.uint64(8) | s[k : k + n]
    return out


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.append(memo.of(words), END_WORD)


def _counter(make, column: str, flush: int = 1_000_000):
    """Sums of how often each number stands in the texts of a task, sent on whenever ``flush`` have gathered."""

    def run(batches):
        memo, held, size, sums = WordHashes(), [], 0, None

        def settle():
            nonlocal held, size, sums
            u, n = np.unique(np.concatenate(held), return_counts=True)
            if sums is not None:
                all_u, at = np.unique(np.concatenate([sums[0], u]), return_inverse=True)
                u, n = all_u, np.bincount(at, weights=np.concatenate([sums[1], n])).astype(np.int64)
            held, size, sums = [], 0, (u, n)

        for pdf in batches:
            for t in pdf["text"]:
                x = make(words_of(t), memo)
                held.append(x)
                size += len(x)
                if size >= flush:
                    settle()
                    if len(sums[0]) >= flush:
                        yield pd.DataFrame({column: sums[0].astype(np.int64), "n": sums[1]})
                        sums = None
        if held:
            settle()
        if sums is not None:
            for at in range(0, len(sums[0]), 500_000):
                yield pd.DataFrame({column: sums[0][at : at + 500_000].astype(np.int64), "n": sums[1][at : at + 500_000]})

    return run


def word_counts(texts: DataFrame) -> DataFrame:
    """word (64-bit hash), c: how often each word and the end stand in all texts."""
    return texts.select("text").mapInPandas(_counter(word_hashes, "word"), "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _context_counts(texts: DataFrame) -> DataFrame:
    return texts.select("text").mapInPandas(_counter(lambda words, _: windows(symbols_of(words)), "code"), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def grow(texts: DataFrame, least: int = LEAST, gain: float = GAIN) -> dict[int, DataFrame]:
    """The tree: for each depth the rows (code of context and symbol, n) of retained contexts."""
    split = [F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(F.lit(255)).alias("symbol")]
    levels = {DEPTH: saved(_context_counts(texts).select("code", "n", *split), "contexts")}
    for d in range(DEPTH - 1, -1, -1):  # the counts of a shorter context are the sums of those one longer
        code = F.col("code").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1)).alias("code")
        levels[d] = saved(levels[d + 1].groupBy(code).agg(F.sum("n").alias("n")).select("code", "n", *split), "contexts")
    passed = None
    for d in range(1, DEPTH + 1):
        own, up = levels[d], levels[d - 1]
        totals = own.groupBy("context").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
        up_totals = up.groupBy(F.col("context").alias("up_context")).agg(F.sum("n").alias("up_total"))
        suffix = F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))
        x = own.join(totals, "context").withColumn("up_context", suffix).withColumn("up_code", F.shiftleft(suffix, 8).bitwiseOR(F.col("symbol")))
        x = x.join(up.select(F.col("code").alias("up_code"), F.col("n").alias("up_n")), "up_code").join(up_totals, "up_context")
        term = F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("up_n") / F.col("up_total")))
        test = saved(x.groupBy("context").agg(F.sum(term).alias("gain")).where(F.col("gain") >= gain).select(F.lit(d).alias("d"), "context"), "tests")
        passed = test if passed is None else passed.unionByName(test)
    # all suffixes of a retained context
    states = saved(passed.select(F.explode(F.sequence(F.lit(1), "d")).alias("k"), "context").select("k", F.expr("context & (shiftleft(1L, 8 * k) - 1)").alias("context")).distinct(), "states")
    out = {0: levels[0].select("code", "n")}
    for d in range(1, DEPTH + 1):
        out[d] = saved(levels[d].join(states.where(F.col("k") == d).select("context"), "context", "left_semi").select("code", "n"), "tree")
    return out


def collected(tree: dict[int, DataFrame]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The tree as arrays in order of code."""
    out = {}
    for d, rows in tree.items():
        got = rows.toPandas().sort_values("code")
        out[d] = (got["code"].to_numpy(np.int64).astype(np.uint64), got["n"].to_numpy(np.int64))
    return out


def scores_by_join(rows: DataFrame, tree: dict[int, DataFrame], mass: float = MASS) -> DataFrame:
    """id, text_hash and score of distinct rows (id, text_hash, text), for a tree that is too large to send to every task."""

    def run(batches):
        for pdf in batches:
            for doc_id, text_hash, text in zip(pdf["id"], pdf["text_hash"], pdf["text"], strict=True):
                code, n = np.unique(windows(symbols_of(words_of(text))), return_counts=True)
                for at in range(0, len(code), 500_000):
                    some = slice(at, at + 500_000)
                    yield pd.DataFrame({"id": doc_id, "text_hash": text_hash, "code": code[some].astype(np.int64), "times": n[some]}).astype({"id": object, "text_hash": "Int64"})

    own = saved(rows.dropDuplicates(["id", "text_hash"]).mapInPandas(run, "id string, text_hash long, code long, times long"), "windows")
    mask = lambda c, k: F.col(c).bitwiseAND(F.lit((1 << (8 * k)) - 1))
    seen, escapes, before = {}, {}, None
    for d in range(DEPTH + 1):
        level = tree[d].withColumn("context", F.shiftright("code", 8))
        totals = level.groupBy("context").agg(F.sum("n").alias("total"))
        up = F.lit(1 / 256)
        level = level.join(totals, "context")
        if d:
            level, up = level.withColumn("up_code", mask("code", d)).join(before, "up_code"), F.exp("up_p")
        seen[d] = saved(level.select("code", F.log((F.col("n") + mass * up) / (F.col("total") + mass)).alias("p")), "seen")
        escapes[d] = totals.select("context", F.log(mass / (F.col("total") + mass)).alias("e"))
        before = seen[d].select(F.col("code").alias("up_code"), F.col("p").alias("up_p"))
    cur = own.select("code").distinct().withColumns({"p": F.lit(None).cast("double"), "e": F.lit(0.0)})
    for d in range(DEPTH, -1, -1):
        hit = seen[d].select(F.col("code").alias("k1"), F.col("p").alias("p1"))
        out_of = escapes[d].select(F.col("context").alias("k2"), F.col("e").alias("e1"))
        both = cur.withColumns({"k1": mask("code", d + 1), "k2": mask("code", d + 1).bitwiseAND(F.lit(-256))}).withColumn("k2", F.shiftright("k2", 8)).join(hit, "k1", "left").join(out_of, "k2", "left")
        found, fresh = F.col("p").isNull() & F.col("p1").isNotNull(), F.col("p").isNull() & F.col("p1").isNull()
        cur = both.select("code", F.when(found, F.col("p1") + F.col("e")).otherwise(F.col("p")).alias("p"), F.when(fresh, F.col("e") + F.coalesce("e1", F.lit(0.0))).otherwise(F.col("e")).alias("e"))
    known = cur.select("code", F.coalesce("p", F.col("e") - math.log(256)).alias("p"))
    return own.join(known, "code").groupBy("id", "text_hash").agg((F.sum(F.col("p") * F.col("times")) / math.log(10)).alias("score"))


class Table:
    """A hash table from codes to values in arrays; lookups are whole-array operations."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(math.ceil(math.log2(max(len(codes), 1) * 2 + 2))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.zeros(1 << self.bits)
        left, at = np.arange(len(codes)), self.place(codes)
        while len(left):
            free = self.keys[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(left), bool)
            first[np.unique(at[free], return_index=True)[1]] = True  # one winner a slot
            winners = np.flatnonzero(free)[first[: free.sum()]]
            self.keys[at[winners]], self.values[at[winners]] = codes[left[winners]], values[left[winners]]
            stay = np.ones(len(left), bool)
            stay[winners] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where there is none."""
        at = self.place(codes)
        found, out = self.keys[at], self.values[at]
        missing = found != codes
        todo = np.flatnonzero(missing & (found != np.uint64(2**64 - 1)))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == codes[todo]
            out[todo[hit]] = self.values[at[hit]]
            missing[todo[hit]] = False
            go = ~hit & (found != np.uint64(2**64 - 1))
            todo, at = todo[go], at[go]
        return out, missing


class Scorer:
    """Log10 probabilities of the symbols of texts."""

    def __init__(self, tree: dict, mass: float = MASS):
        self.seen, self.states = {}, {}
        before = None
        for d in range(DEPTH + 1):
            codes, n = tree[d]
            contexts, at = np.unique(codes >> np.uint64(8), return_inverse=True)
            totals = np.bincount(at, weights=n, minlength=len(contexts)) if len(codes) else np.zeros(0)
            if d == 0:
                up = np.full(len(codes), 1 / 256)
            else:  # the suffix state is retained too, and has seen whatever this one has
                shorter = codes & np.uint64((1 << (8 * d)) - 1)
                up = np.exp(before.get(shorter)[0]) if len(codes) else np.zeros(0)
            p = (n + mass * up) / (totals[at] + mass) if len(codes) else np.zeros(0)
            before = Table(codes, np.log(p))
            self.seen[d] = before
            self.states[d] = Table(contexts, np.log(mass / (totals + mass)))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """For windows of DEPTH context symbols and one more."""
        out = np.zeros(len(codes))
        todo, own, d = np.arange(len(codes)), codes, DEPTH
        while len(todo):
            value, missing = self.seen[d].get(own & np.uint64((1 << (8 * (d + 1))) - 1))
            out[todo[~missing]] += value[~missing]
            todo, own = todo[missing], own[missing]
            if d == 0:
                # a symbol never seen at all, or no training text
                esc, none = self.states[0].get(np.zeros(len(own), np.uint64))
                out[todo] += np.where(none, 0.0, esc) - math.log(256)
                break
            # a state that has not seen the symbol leaves it to its suffix; a context that is no state costs nothing
            esc, none = self.states[d].get(own >> np.uint64(8) & np.uint64((1 << (8 * d)) - 1))
            out[todo] += np.where(none, 0.0, esc)
            d -= 1
        return out / math.log(10)


def scored(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", frequent: int = FREQUENT, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Each row's id with n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    counts = saved(word_counts(training), "words")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = totals["n"] or 0, totals["v"] or 0
    levels = grow(training)
    fits = sum(rows.count() for rows in levels.values()) <= most_entries
    tree = collected(levels) if fits else None
    common = counts.where(F.col("c") >= least_of_most(counts, "c", frequent)).toPandas().sort_values("word")
    shared = spark.sparkContext.broadcast((tree, common["word"].to_numpy(np.int64).astype(np.uint64), common["c"].to_numpy(np.int64)))
    denominator = math.log10(n_train + 0.5 * (v_train + 1))

    def run(batches):
        tree, words, c = shared.value
        scorer, memo = Scorer(tree) if tree else None, WordHashes()
        known = Table(words, c.astype(float))
        def rows_of(some):
            """Result rows of some texts, whose symbols are scored in one call."""
            codes = [c for *_, c in some]
            starts = np.cumsum([0, *map(len, codes[:-1])])
            scores = np.add.reduceat(scorer.log10(np.concatenate(codes)), starts) if scorer else np.zeros(len(codes))
            for (doc_id, text_hash, hashes, _), s in zip(some, scores, strict=True):
                u, n = np.unique(hashes, return_counts=True)
                value, missing = known.get(u)
                yield doc_id, text_hash, len(hashes), int(n[~missing].sum()), float(np.sum(n[~missing] * np.log10(value[~missing] + 0.5))), float(s), u[missing].astype(np.int64), n[missing]

        for pdf in batches:
            rows, held, size = [], [], 0
            for doc_id, text_hash, text in zip(pdf["id"], pdf["text_hash"], pdf["text"], strict=True):
                words = words_of(text)
                held.append((doc_id, text_hash, word_hashes(words, memo), windows(symbols_of(words))))
                size += len(held[-1][-1])
                if size >= 500_000:  # only so many symbols are held at a time
                    rows += rows_of(held)
                    held, size = [], 0
            if held:
                rows += rows_of(held)
            if rows:
                yield pd.DataFrame(rows, columns=["id", "text_hash", "n_tokens", "n_common", "sum_common", "score", "rest", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    first = saved(rows.mapInPandas(run, "id string, text_hash long, n_tokens long, n_common long, sum_common double, score double, rest array<long>, times array<long>"), "scored")
    if not fits:
        joined = scores_by_join(rows, levels).withColumnsRenamed({"id": "__i", "text_hash": "__h", "score": "__s"})
        same = F.col("id").eqNullSafe(F.col("__i")) & F.col("text_hash").eqNullSafe(F.col("__h"))
        first = saved(first.join(joined, same, "left").withColumn("score", F.col("__s")).drop("__i", "__h", "__s"), "scored")
    # repeated rows have the same words: each distinct row's other words are looked up once
    others = first.where(F.size("rest") > 0).select("id", "text_hash", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("id", "text_hash", F.col("w.rest").alias("word"), F.col("w.times").alias("times")).distinct()
    looked = others.join(counts, "word", "left")
    # sums of whole numbers of tokens and of logarithms rounded to 2**-40, so that order does not matter
    fixed = F.round(F.log10(F.coalesce("c", F.lit(0)) + 0.5) * (1 << 40)).cast("long") * F.col("times")
    rare = looked.groupBy("id", "text_hash").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"), F.sum(fixed.cast("decimal(38,0)")).alias("sum_rare"))
    a, b = first.alias("a"), rare.alias("b")
    out = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & F.col("a.text_hash").eqNullSafe(F.col("b.text_hash")), "left")
    base = F.col("a.sum_common") + F.coalesce(F.col("b.sum_rare").cast("double") / (1 << 40), F.lit(0.0)) - F.col("a.n_tokens") * F.lit(denominator)
    return out.select(
        F.col("a.id").cast(kind).alias(id_col),
        F.col("a.n_tokens").alias("n_tokens"),
        (F.col("a.n_common") + F.coalesce("b.n_rare", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        F.col("a.score").alias("score"),
    )


def op10_suffix_tree(spark, sf_dir):
    from keepsake.llm.common import crc32_mod, documents

    docs = documents(spark, sf_dir)
    held_out = crc32_mod("doc_id", 5) == 1
    out = scored(docs, docs.where(~held_out))
    return out.select("doc_id", (crc32_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
