"""Token-id output in Simple-8b words, with an index that lets blocks decode on their own.

File format: a Parquet folder (so that a lost executor's half-written files never count) with one
row a block: ``part`` and ``block`` (its place), ``start_in_part`` (ids before it in its part),
``n_ids``, ``doc_ids`` and ``n_tokens`` (one entry a document: the offsets), ``words`` (the ids of
all its documents as little-endian 64-bit words). Parts are ranges of doc_id in ascending order.

A word's top four bits are its selector. Selectors 1 to 14 pack COUNTS[s] ids of 60 // COUNTS[s]
bits, first id lowest. Selector 15 is the escape: the id is the whole next word (so any unsigned
64-bit value can be kept). Selector 0 is not used.

Edge cases: null text counts as empty and gives the end id alone; null doc_id sorts first; rows
that repeat an id are kept, in the order of their texts. An empty table gives an empty folder.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.common import joined, unit_lists, unit_text

#: Fixed values of the format: ids in a word by selector.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = "part int, block int, start_in_part long, n_ids long, doc_ids array<long>, n_tokens array<long>, words binary"


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint8)
    rest = ids.copy()
    while rest.any():
        out += rest > 0
        rest >>= np.uint64(1)
    return out


_SHORT = bit_lengths(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    bits = _SHORT[ids.astype(np.int64)] if ids.max() < len(_SHORT) else bit_lengths(ids)
    # the most ids that one word can take from each place on; 0: an escape
    take = (bits <= 60).astype(np.uint8)
    widest, span = bits, 1
    for count in sorted(c for c in COUNTS if c > 1):
        while span < count and span < n:
            step = min(span, count - span)
            if len(widest) <= step:
                break
            widest = np.maximum(widest[:-step], widest[step:])
            span += step
        if span < count:
            break
        np.putmask(take[: len(widest)], widest <= 60 // count, np.uint8(count))
    at, starts, jumps = 0, [], take.tobytes()
    while at < n:
        starts.append(at)
        at += jumps[at] or 1
    starts = np.array(starts)
    taken = take[starts]
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(taken == 0)[:-1]))
    out = np.zeros(len(starts) + int((taken == 0).sum()), np.uint64)
    for selector in range(1, ESCAPE):
        count = COUNTS[selector]
        which = np.flatnonzero(taken == count)
        if len(which):
            word = np.full(len(which), selector << 60, np.uint64)
            for k in range(count):
                word |= ids[starts[which] + k] << np.uint64(k * (60 // count))
            out[place[which]] = word
    escaped = np.flatnonzero(taken == 0)
    out[place[escaped]] = np.uint64(ESCAPE << 60)
    out[place[escaped] + 1] = ids[starts[escaped]]
    return out


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == ESCAPE):  # the word after an escape is no word, unless the escape itself is not
        if not raw[at] and at + 1 < len(words):
            raw[at + 1] = True
    sizes = np.array([*COUNTS, 1])[selector]
    sizes[raw] = 0
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s in range(1, ESCAPE):
        which = np.flatnonzero((selector == s) & ~raw)
        count, width = COUNTS[s], 60 // COUNTS[s]
        mask = np.uint64((1 << width) - 1)
        for k in range(count if len(which) else 0):
            out[first[which] + k] = (words[which] >> np.uint64(k * width)) & mask
    escaped = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[first[escaped]] = words[escaped + 1]
    return out


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class Encoder(dict):
    """The tokenizers library, as loaded from its file, behind a memo of the units between places where its pattern always cuts.

    Its pattern always cuts before a single space between two other characters, on both sides of a
    single line feed between two other characters, and between a letter and '.' or ','. What stands
    between such cuts is a unit. Units that the memo lacks go to the library many at a time, as the
    lines of one text; the token of the line feed parts their ids again. Plain words, which are single
    pieces, go straight to the library's model. The memo has two
    generations: when the younger is full, the elder is dropped, so what is in use stays.

    Strings of the file's special tokens become those tokens wherever they stand, as the library
    has it; texts that hold one go to the library whole.

    """

    def __init__(self, path: str, limit: int = 350_000, characters: int = 1 << 22):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.characters, self.elder = limit, characters, {}
        self.line_feed = self._library("\n")
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        self.plain = parts["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def parts(key: str) -> list[str]:
        """A key as smaller ones, cut at its line feeds and before '.' or ',' at its end."""
        if "\n" in key:
            lines = key.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in (lines[0].removeprefix("\t"), *lines[1:])):
                return [*Encoder.parts(lines[0]), *[y for x in lines[1:] for y in ("\t\n", *Encoder.parts("\t" + x))]]
        core = key.rstrip(".,")
        if core != key and core and core[-1].isalpha() and core[-1] < "ɐ":
            return [core, "\t" + key[len(core) :]]
        return [key]

    def __missing__(self, key: str) -> bytes:
        ids = self.elder.get(key)
        if ids is None:
            own = self.parts(key)
            ids = b"".join([self[x] for x in own]) if len(own) > 1 else self._library(unit_text(key))
            if len(own) > 2:
                return ids  # whole lines seldom come again
        self[key] = ids
        return ids

    def _learn(self, keys: set[str]) -> None:
        """Adds units that the memo lacks."""
        whole = [x for x in keys if x[-1] in ".," or "\n" in x]
        lacking = keys.difference(whole).union([y for x in whole for y in self.parts(x) if y not in self and y not in self.elder])
        if self.plain:
            tokenize, space, rest = self.tokenizer.model.tokenize, _BYTE_LETTERS[32], []
            for x in lacking:
                if not x.isalpha() or (not x.isascii() and max(x) >= "ɐ"):
                    rest.append(x)
                    continue
                # letters of ASCII stand for themselves
                ids = [t.id for t in tokenize(space + (x if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_LETTERS)))]
                self[x] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
            lacking = rest
        # what holds no white space but a tab in front
        lacking = [x for x in lacking if (x.isprintable() and " " not in x) or ((w := x.split()) and x in (w[0], "\t" + w[0]))]
        for i in range(0, len(lacking), 4096):
            own = lacking[i : i + 4096]
            ids = np.frombuffer(self._library("\n".join(map(unit_text, own))), "<u4")
            cut = np.flatnonzero(ids == np.frombuffer(self.line_feed, "<u4")[0]) * 4
            raw, starts, ends = ids.tobytes(), [0, *(cut + 4).tolist()], [*cut.tolist(), 4 * len(ids)]
            self.update(zip(own, [raw[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))

    def encode_all(self, texts: list[str]):
        """Ids of each text as little-endian unsigned 32-bit integers, some ``characters`` of text at a time."""
        at = 0
        while at < len(texts):
            size, stop = 0, at
            while stop < len(texts) and size < self.characters:
                size, stop = size + len(texts[stop]), stop + 1
            part, at = texts[at:stop], stop
            held = pa.array(part, pa.string())
            marked = {i for x in self.special for i in pc.indices_nonzero(pc.match_substring(held, x)).to_pylist()}
            whole = {i: self._library(part[i]) for i in marked}
            if whole:
                held = pa.array(["" if i in whole else t for i, t in enumerate(part)], pa.string())
            lists = unit_lists(held)
            sizes, coded = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
            keys = coded.dictionary.to_pylist()
            if len(self) > self.limit:
                self.elder = dict(self)
                self.clear()
            own = [*map(self.get, keys)]  # equal units of these texts are looked up once
            gaps = [i for i, x in enumerate(own) if x is None]
            self._learn({keys[i] for i in gaps if keys[i] not in self.elder})
            for i in gaps:
                own[i] = self[keys[i]]
            ids, ends = joined(own, coded.indices)
            ids, text_ends = ids.to_pybytes(), ends[np.append(0, np.cumsum(sizes))].tolist()
            for i in range(len(part)):
                yield whole.get(i) or ids[text_ends[i] : text_ends[i + 1]]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process, so that its memo serves all tasks there."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", block_ids: int = BLOCK_IDS) -> None:
    """Encodes the ``text`` of every row, appends ``end_id`` and writes the ids in ascending order of ``id_col``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        end = np.array([end_id], dtype="<u4").tobytes()
        part, start, block, ids, doc_ids, sizes, held = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def row():
            words = pack(np.frombuffer(b"".join(ids), dtype="<u4"))
            return pd.DataFrame({"part": [part], "block": [block], "start_in_part": [start], "n_ids": [held], "doc_ids": [doc_ids], "n_tokens": [sizes], "words": [words.astype("<u8").tobytes()]})

        for pdf in batches:
            texts = [x or "" for x in pdf["text"]]
            for doc_id, own in zip(pdf["id"], encoder(tokenizer).encode_all(texts), strict=True):
                own += end
                ids.append(own)
                doc_ids.append(None if doc_id is None else int(doc_id))
                sizes.append(len(own) // 4)
                held += len(own) // 4
                if held >= block_ids:
                    yield row()
                    start, block, ids, doc_ids, sizes, held = start + held, block + 1, [], [], [], 0
        if doc_ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), "text").repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    rows.select(F.col("key").cast("string").alias("id"), "text").mapInPandas(run, BLOCK_SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: the number of ids before each. Only one total a part is brought to the driver."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([p for p, _ in totals], itertools.accumulate([0, *[n for _, n in totals]]), strict=False))
    offsets = spark.createDataFrame([(p, n) for p, n in before.items()], "part int, before long")
    return blocks.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def _documents_of(blocks: DataFrame, emit, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for doc_ids, sizes, start, words in zip(pdf["doc_ids"], pdf["n_tokens"], pdf["start"], pdf["words"], strict=True):
                ids = unpack(np.frombuffer(words, dtype="<u8"))
                ends = np.cumsum(np.asarray(sizes))
                cut = np.split(ids, ends[:-1])
                yield pd.DataFrame({"doc_id": pd.array([None if d is None or d != d else int(d) for d in doc_ids], dtype="Int64"), "start": start + ends - sizes, **emit(cut)})

    return blocks.select("doc_ids", "n_tokens", "start", "words").mapInPandas(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of each document."""
    return _documents_of(read_blocks(spark, path), lambda cut: {"ids": [x.astype(np.int64) for x in cut]}, "doc_id long, start long, ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids as little-endian unsigned 32-bit integers."""

    def emit(cut):
        return {"n_tokens": [len(x) for x in cut], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in cut]}

    return _documents_of(read_blocks(spark, path), emit, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_output(spark, sf_dir):
    import public_tokenizers

    from keepsake.llm.common import documents, scratch

    path = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_digests(spark, path)
