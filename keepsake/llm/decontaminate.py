"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are white-space words (A-Z lower-cased). Items are cut into seeds, runs
of ``min_match`` words; a document that shares a seed with an item is compared with it by greedy
string tiling: again and again the longest run of words that both still have unmarked becomes a
tile (found by running Karp-Rabin hashes: those of any length follow from sums that are made once), until no run of ``min_match`` words
is left. An item whose tiles cover at least ``threshold`` of its words is reported. Tiles need not
stand in the item's order, so reordered passages are caught.

Edge cases: null or empty texts and null or empty items never match. Items with fewer words than
``min_match`` are compared as one seed of their own length. Rows of either side that repeat are
treated on their own; rows with a null id are reported under that null. Ties between equally
long runs go to the smallest position in the item, then in the document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import WordHashes, running_hashes, trimmed, window_hashes, words_of

#: Fixed parameters: words in a seed, share of an item's words that its tiles must cover.
MIN_MATCH, THRESHOLD = 5, 0.5
#: The most seeds that are sent to every task at a time; a larger benchmark takes several passes over the documents.
BROADCAST_SEEDS = 2_000_000


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length) of two arrays of word hashes."""
    min_match = max(1, min(min_match, len(item)))
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    of_item, of_text, tiles = running_hashes(item), running_hashes(text), []

    def starts(free, n):
        """Where a run of n unmarked words begins."""
        total = np.concatenate(([0], np.cumsum(free)))
        return np.flatnonzero(total[n:] - total[:-n] == n) if len(free) >= n else np.zeros(0, np.int64)

    def common(n):
        a, b = starts(free_item, n), starts(free_text, n)
        if not len(a) or not len(b):
            return None
        ha, hb = of_item(n)[a], of_text(n)[b]
        return (a, ha, b, hb) if np.isin(ha, hb).any() else None

    longest = min(len(item), len(text))
    while longest >= min_match:
        # a common run of n words holds common runs of fewer words, so the longest is found by bisection
        low, high = min_match - 1, longest
        while low < high:
            n = (low + high + 1) // 2
            if common(n) is None:
                high = n - 1
            else:
                low = n
        if low < min_match:
            break
        a, ha, b, hb = common(low)
        for at, h in zip(a, ha, strict=True):
            if not free_item[at : at + low].all():
                continue
            for other in b[hb == h]:
                if free_text[other : other + low].all() and np.array_equal(item[at : at + low], text[other : other + low]):
                    tiles.append((int(at), int(other), int(low)))
                    free_item[at : at + low] = False
                    free_text[other : other + low] = False
                    break
        longest = low
    return tiles


def _near(text: np.ndarray, hits: np.ndarray, reach: int) -> np.ndarray:
    """The words around the seed hits; every cut becomes a word that matches nothing, so runs never cross it."""
    keep = np.zeros(len(text) + 1, np.int64)
    np.add.at(keep, np.maximum(hits - reach, 0), 1)
    np.add.at(keep, np.minimum(hits + reach, len(text)), -1)
    kept = np.cumsum(keep)[:-1] > 0
    edges = np.flatnonzero(~kept & np.concatenate(([False], kept[:-1])))
    out = np.where(kept, text, np.uint64(0))
    kept[edges] = True
    return out[kept]


class _Items:
    """Items by number, and the sorted seeds of all of them."""

    def __init__(self, rows, min_match):
        memo = WordHashes()
        self.ids, self.items, seeds, owner, self.lengths = [], [], [], [], set()
        for item_id, text in rows:
            h = memo.of(words_of(text))
            if not len(h):
                continue
            n = min(min_match, len(h))
            self.lengths.add(n)
            s = np.unique(window_hashes(h, n) + np.uint64(n))
            seeds.append(s)
            owner.append(np.full(len(s), len(self.items)))
            self.ids.append(item_id)
            self.items.append(h)
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owner = self.seeds[order], self.owner[order]


def _matches(h: np.ndarray, held: _Items, min_match: int, threshold: float, memo_bits: np.ndarray):
    hits: dict[int, list] = {}
    for n in held.lengths:
        w = window_hashes(h, n) + np.uint64(n)
        # a bit table drops almost all windows before the search in the sorted seeds
        maybe = np.flatnonzero(memo_bits[(w >> np.uint64(42)).astype(np.int64)])
        if not len(maybe):
            continue
        left, right = np.searchsorted(held.seeds, w[maybe], "left"), np.searchsorted(held.seeds, w[maybe], "right")
        for at, a, b in zip(maybe, left, right, strict=True):
            for k in held.owner[a:b]:
                hits.setdefault(int(k), []).append(at)
    for k, at in sorted(hits.items()):
        item = held.items[k]
        tiles = tile(item, _near(h, np.array(at), len(item)), min_match)
        coverage = sum(t[2] for t in tiles) / len(item)
        if coverage >= threshold:
            yield held.ids[k], len(tiles), float(coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, id_col: str = "doc_id", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """One row for each document row and item of which it holds enough: id, item_id, n_tiles long, coverage double.

    The items are measured first. Where their seeds fit ``broadcast_seeds`` they go to every task;
    a larger benchmark is taken in as many such parts as it needs, one pass over the documents each.
    """
    spark = docs.sparkSession
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where(F.length(F.coalesce("text", F.lit(""))) > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (2 * broadcast_seeds)))  # a seed for every two characters at most
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for p in range(parts):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == p).collect()]
        shared = spark.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            held, memo = _Items(shared.value, min_match), WordHashes()
            bits = np.zeros(1 << 22, bool)
            bits[(held.seeds >> np.uint64(42)).astype(np.int64)] = True
            for pdf in batches:
                found = []
                for doc_id, text in zip(pdf["id"], pdf["text"], strict=True):
                    words = words_of(text)
                    if words and len(held.seeds):
                        found += [(doc_id, *m) for m in _matches(memo.of(words), held, min_match, threshold, bits)]
                if found:
                    yield pd.DataFrame(found, columns=["id", "item_id", "n_tiles", "coverage"])

        # ids travel as text: pandas would turn whole numbers beside nulls into floats
        got = docs.select(F.col(id_col).cast("string").alias("id"), F.col("text").alias("text")).mapInPandas(trimmed(run), "id string, item_id string, n_tiles long, coverage double")
        out = got if out is None else out.unionByName(got)
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("item_id").cast(item_kind).alias("item_id"), "n_tiles", "coverage")


def op9_decontaminate(spark, sf_dir):
    from keepsake.llm.common import documents, table

    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
