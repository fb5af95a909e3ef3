"""Small helpers that the operators share: tables, scratch folders and token hashing."""

from __future__ import annotations

import ctypes
import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.sources.scratch import saved, scratch  # noqa: F401  operators take both from here


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def freed(cycles: bool = True) -> None:
    """Gives memory that numpy and Arrow keep for later back to the system, once something large is done with."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def trimmed(run):
    """``run`` over a task's batches; what it held goes back to the system at the end, for Spark keeps the task's Python worker."""

    def own(batches):
        yield from run(batches)
        freed()

    return own


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def crc32_mod(col: str, mod: int):
    """crc32 of the column as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def words_of(text: str | None) -> list[bytes]:
    """White-space words as UTF-8 with A-Z lower-cased; ``bytes.split`` cuts at exactly x20 and x09-x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_CUT = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """A text cut before each single space between two other characters, and beside each lone line feed.

    A unit is given without the space before it; those that have none (the first, line feeds, what
    follows them) begin with a tab instead, which no other unit does.
    """
    words = text.split()
    if len("".join(words)) + len(words) - 1 == len(text):  # no white space beside white space, none at the ends
        out = text.replace("\n", " \t\n \t").split(" ")
    else:
        out = _CUT.split(text)
    out[0] = "\t" + out[0]
    return out


#: White space of any kind beside white space, or at an end of a text.
_IRREGULAR = r"[W][W]|^[W]|[W]\z".replace("W", r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def unit_lists(texts: pa.Array) -> pa.Array:
    """``units`` of each text (none of which is null), as a list array."""
    if pc.any(pc.match_substring_regex(texts, _IRREGULAR)).as_py():
        return pa.array([units(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    marked = pc.binary_join_element_wise(pa.scalar("\t", texts.type), texts, pa.scalar("", texts.type))
    return pc.split_pattern(pc.replace_substring(marked, "\n", " \t\n \t"), " ")


def unit_text(unit: str) -> str:
    return unit[1:] if unit[0] == "\t" else " " + unit


def joined(own: list[bytes] | pa.Array, index: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The strings of ``own`` (large, if an array) at ``index``, one after another, and the byte where each begins (one entry more: where the last ends)."""
    _, ends, flat = (own if isinstance(own, pa.Array) else pa.array(own, pa.large_binary())).take(index).buffers()
    return flat, np.frombuffer(ends, np.int64)[: len(index) + 1]


class WordHashes(dict):
    """Memo of 64-bit word hashes; it is emptied when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, in order; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out = mix(out) + h[k : k + m]
    return mix(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with 1 to n-1 words the whole sequence is the one shingle."""
    if 0 < len(h) < n:
        return window_hashes(h, len(h)) + np.uint64(len(h))
    return np.unique(window_hashes(h, n))


def running_hashes(h: np.ndarray):
    """Karp-Rabin: a function from n to the hashes of all runs of n words, each from sums that are made once.

    The hash of a run is the polynomial of its word hashes in an odd base, modulo 2**64, which a
    difference of two running sums gives after division by a power of the base.
    """
    powers = np.cumprod(np.append(np.uint64(1), np.full(len(h), _MULTIPLIER)))
    inverse = np.cumprod(np.append(np.uint64(1), np.full(len(h), np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)))))
    sums = np.append(np.uint64(0), np.cumsum(mix(h) * powers[:-1]))

    def of(n: int) -> np.ndarray:
        m = max(len(h) - n + 1, 0)
        return mix((sums[n : n + m] - sums[:m]) * inverse[:m]) if m else np.zeros(0, np.uint64)

    return of


def hash_sample(rows: DataFrame, most: int, by: str | None = None, key=("doc_id", "text")) -> DataFrame:
    """About ``most`` rows (for each value of ``by``) by a hash of ``key``, in column __key; rows that repeat a key are one.

    The share to keep follows from a count, so no group is sorted or gathered. The number kept
    exceeds ``most`` by a few times its square root at most, but for chance of less than one in a million.
    """
    keyed = rows.withColumn("__key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key]))
    group = F.lit("") if by is None else F.col(by).cast("string")
    counts = {r["g"]: r["n"] for r in rows.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return keyed.limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, most / n))]), group)
    return keyed.where(F.shiftrightunsigned("__key", 1) < share * float(1 << 63)).dropDuplicates(["__key", *([by] if by else [])])


def least_of_most(df: DataFrame, col: str, most: int) -> int:
    """The least power of two that at most ``most`` rows of ``df`` reach in ``col``: a bound found by counting, without a sort."""
    classes = df.where(F.col(col) >= 1).groupBy(F.floor(F.log2(F.col(col).cast("double") + 1e-9)).cast("int").alias("k")).count().collect()
    total, least = 0, max((r["k"] for r in classes), default=0) + 1
    for r in sorted(classes, key=lambda r: -r["k"]):
        total += r["count"]
        if total > most:
            break
        least = r["k"]
    return 1 << max(least, 0)
