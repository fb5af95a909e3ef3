"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A text is cut into pieces by the tokenizer's pattern. A piece starts as its bytes; an
``aggregate`` folds merges over them: each step looks up the ranks of neighbouring parts, joins
the first pair of lowest rank and looks up the two ranks beside it, until no pair has a rank. Parts
are held as their ranks. The rank map is by the ranks of two neighbours: flat arrays of numbers
(``pair_ranks``), because Spark's map lookup is linear. It is one row of a saved table that plans read
as a scalar subquery: as a literal it would stand in every description of a plan, some megabytes
each, that the driver makes and keeps.

Distinct pieces are counted over all documents (those beside more than one space at a time as if one stood there, for
the counts only choose what is worth keeping). Those that recur are folded once; up to
``dictionary`` of them, the commonest, go to the tasks in packed arrays. A task cuts its texts into
runs of ids of known pieces and, between them, the other pieces (those of one document, and what is
beyond the bound), which the same fold then turns into ids where they stand. So results do not
depend on the bound, and a text is never shuffled. Pieces of more than ``LONG`` bytes are merged with
a heap instead, for the fold's time grows with the square of a piece's length.

Pieces are known by 64-bit hashes in the packed arrays. Edge cases: null or empty text has no ids
and decodes to no bytes; a null array of ids decodes to null. Repeated rows and null ids are kept,
for encoding works row by row. The columns ``__cut``, ``__ranks`` and ``out_col`` must not stand in the input.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.common import freed, joined, least_of_most, saved, trimmed, unit_lists, unit_text

BUCKETS = 1 << 16
#: Higher than any rank.
NONE = 1 << 30
#: Pieces of more bytes are merged with a heap.
LONG = 256
#: ASCII marks: neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space as the tokenizer's regex library sees it (fixed values).
_SPACE = r"\t-\r\x20\x85\xA0  -     　"


def java_pattern(pattern: str) -> str:
    """The pattern with white space spelt out: Java's own class has ASCII only."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def literal_map(entries: dict[str, object], value_type: str) -> Column:
    """A literal array of maps; an entry's place is its key's 64-bit hash (as Spark's function has it) modulo BUCKETS."""
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        buckets[xxhash.xxh64_intdigest(key.encode(), seed=42) % BUCKETS][key] = value
    return literal(buckets, f"array<map<string,{value_type}>>")


def literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def looked_up(mapping: Column, key: Column) -> Column:
    """The entry of ``key``, else null."""
    return F.element_at(F.get(mapping, F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), key)


def pair_ranks(ranks: dict[bytes, int]) -> tuple[list, list, list, list]:
    """The rank map by the ranks of two neighbours, in arrays: (owners, values, places, codes).

    The pair a, b has a rank if ``owners[places[a] + codes[b]]`` is a, and then that of the same place
    in ``values``. The entries of each a keep their distances and lie in gaps between those of others;
    codes are small for those b that stand in many pairs, so that the gaps are few.
    """
    pairs = [(ranks[k[:i]], ranks[k[i:]], v) for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
    places: list = [None] * (max(ranks.values(), default=-1) + 1)
    codes = places.copy()
    if not pairs:
        return [], [], places, codes
    for code, (b, _) in enumerate(Counter(b for _, b, _ in pairs).most_common()):
        codes[b] = code
    left, right, value = np.array(sorted((a, codes[b], v) for a, b, v in pairs)).T
    starts = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
    sizes = np.diff(np.append(starts, len(left)))
    room = len(left) + len(left) // 4 + 2 * (int(right.max()) + 1)
    free, at, last, slots = np.ones(room, bool), 0, 0, np.zeros(len(left), np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        own = right[starts[k] : starts[k] + sizes[k]]
        at += int(free[at:].argmax())
        if len(own) == 1:
            shift = at - own[0]
        else:
            # the next gaps that take all of them; rows of one entry fill what was passed over
            begin, shift = max(at, last - 16384), None
            while shift is None:
                heads = begin + np.flatnonzero(free[begin : begin + 8192])
                begin += 8192
                if begin + own[-1] - own[0] >= len(free):
                    free = np.append(free, np.ones(len(free), bool))
                for x in (own[1:] - own[0]).tolist():
                    heads = heads[free[heads + x]]
                    if not len(heads):
                        break
                if len(heads):
                    last, shift = int(heads[0]), heads[0] - own[0]
        free[own + shift] = False
        slots[starts[k] : starts[k] + sizes[k]] = own + shift
        places[left[starts[k]]] = int(shift)
    owners, values = [[None] * (int(slots.max()) + 1) for _ in range(2)]
    for i, a, v in zip(slots.tolist(), left.tolist(), value.tolist(), strict=True):
        owners[i], values[i] = a, v
    return owners, values, places, codes


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: the fold of no elements, whose last function gets the start."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


class BytePairs:
    """A vocabulary of ranks as plan expressions."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.table = java_pattern(pattern), ranks
        # a piece that is a token is that token, even where merges would not lead to it
        unmerged = {k.decode("latin-1"): v for k, v in ranks.items() if len(k) > 1 and merged(k, ranks) != [v]}
        self.unmerged = literal_map(unmerged, "int") if unmerged else None
        owners, values, *by_part = pair_ranks(ranks)
        values = [None if v is None else v - NONE for v in values]
        numbers = pa.array([[owners, values, *by_part, [ranks.get(bytes([x]), NONE) for x in range(256)]]], pa.list_(pa.list_(pa.int32())))
        self.row = saved(SparkSession.active().createDataFrame(pa.table({"numbers": numbers})), "ranks")
        del numbers, owners, values, by_part
        parts = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            parts[v] = k
        # strings that hold the pieces' very bytes, whether or not these are characters; they are only joined
        self.parts = F.from_json(F.lit(json.dumps([base64.b64encode(x).decode() for x in parts])), "array<binary>").cast("array<string>")
        freed()

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def with_folds(self, df: DataFrame, out_col: str, use) -> DataFrame:
        """``df`` with ``use(fold)`` in ``out_col``, where ``fold(piece)`` gives the ids of one piece.

        A subquery may not be written within a function of arrays, so it gets a column that ``use`` alone refers to, and once;
        Spark puts the one in the place of the other, and no row holds the numbers. ``__ranks`` must not stand in ``df``.
        """
        held = df.withColumn("__ranks", self.row.scalar())
        return held.withColumn(out_col, _let(F.col("__ranks"), lambda r: use(lambda piece: self.fold(piece, r)))).drop("__ranks")

    def fold(self, piece: Column, ranks: Column) -> Column:
        """The ids of one piece (array<int>)."""
        latin = F.decode(piece.cast("binary"), "ISO-8859-1")
        owners, values, places, codes, singles = [F.get(ranks, F.lit(k)) for k in range(5)]

        def rank(o, v, p, c):
            def of(a, b):
                at = F.get(p, a) + F.get(c, b)
                return F.when(F.get(o, at) == a, F.get(v, at)).otherwise(F.lit(-1))

            return of

        ids = _let(owners, lambda o: _let(values, lambda v: _let(places, lambda p: _let(codes, lambda c: _let(singles, lambda s: self._fold(latin, s, rank(o, v, p, c)))))))
        if self.unmerged is None:
            return ids
        return _let(looked_up(self.unmerged, latin), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(ids))

    def _fold(self, latin: Column, singles: Column, rank) -> Column:
        """One array holds all parts, and before each part the rank of the pair it ends.

        Parts are not negative; ranks are less NONE, and -1 is none, also where no part stands, so that ends need no care. Functions
        here get values bound by ``_let``, for of an expression they work the type out at every call. ``flatten`` takes less time
        than ``concat``, and the least of the places less than ``array_position``, which leaves by an exception.
        """

        def joined(state, at, both):
            middle = F.array(rank(F.get(state, at - 3), both), both, rank(both, F.get(state, at + 3)))
            return _let(F.array(F.slice(state, F.lit(1), at - 2), middle, F.slice(state, at + 4, F.lit(NONE))), F.flatten)

        def step(state, _):
            def lowest(low):
                place = _let(F.transform(state, lambda x, i: F.when(x == low, i)), F.array_min)
                return F.when(low >= -1, state).otherwise(_let(low + NONE, lambda both: _let(place, lambda at: joined(state, at, both))))

            return _let(F.array_min(state), lowest)

        def begin(parts):
            return _let(F.transform(parts, lambda p, i: F.array(rank(F.get(parts, i - 1), p), p)), F.flatten)

        one_by_one = F.transform(F.split(latin, ""), lambda c: F.get(singles, F.ascii(c)))
        return _let(one_by_one, lambda parts: F.aggregate(F.slice(parts, 2, F.size(parts)), begin(parts), step, lambda s: F.filter(s, lambda x: x >= 0)))

    def decoded(self, ids: Column) -> Column:
        """The bytes of an array of ids (binary)."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.parts, i)), "").cast("binary")


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece by the same merges, with a heap: for pieces too long for the fold."""
    n = len(piece)
    ends, begins = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts here, of the part that ends here
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i):
        stop = ends[ends[i]] if ends[i] < n else 0
        if stop and (r := ranks.get(piece[i:stop])) is not None:
            heapq.heappush(heap, (r, i, stop))

    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != stop:
            continue  # one of its parts is gone
        ends[i], ends[middle], begins[stop] = stop, 0, i
        offer(i)
        if i:
            offer(begins[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Known:
    """Ids of common pieces in arrays, by 64-bit hash of the piece."""

    def __init__(self, rows):
        # on the driver: few copies at a time, and rows as they come
        flat = [bytearray(), bytearray(), bytearray()]
        for r in rows:
            for own, x in zip(flat, (r["hashes"], r["sizes"], r["ids"]), strict=True):
                own += x
        hashes, ids = np.frombuffer(flat[0], "<u8"), bytes(flat.pop())
        ends = np.cumsum(np.append(0, 4 * np.frombuffer(flat[1], "<u2").astype(np.int32)), dtype=np.int32)
        self.entries = pa.Array.from_buffers(pa.binary(), len(hashes), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        self.order = np.argsort(hashes).astype(np.uint32)
        self.hashes = hashes[self.order]

    def of(self, pieces: list[str]) -> tuple[np.ndarray, pa.Array]:
        """Which pieces are known, and the ids of those, in order."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, len(pieces))
        if not len(self.hashes):
            return np.zeros(len(h), bool), self.entries
        at, order = np.empty(len(h), np.int64), np.argsort(h)
        at[order] = np.searchsorted(self.hashes, h[order])  # in order, for the next one is near the last
        at[at == len(self.hashes)] = 0
        there = self.hashes[at] == h
        return there, self.entries.take(pa.array(self.order[at[there]]))

    @staticmethod
    def pack(batches):
        """Rows (piece, ids) as few packed ones."""
        hashes, sizes, ids = [], [], []
        for b in batches:
            hashes += [xxhash.xxh64_intdigest(x) for x in b.column("piece").to_pylist()]
            lists = b.column("ids")
            sizes.append(lists.value_lengths().to_numpy(zero_copy_only=False))
            ids.append(lists.flatten().to_numpy(zero_copy_only=False))
        if hashes:
            own = [np.array(hashes, "<u8"), np.concatenate(sizes).astype("<u2"), np.concatenate(ids).astype("<u4")]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in own], names=["hashes", "sizes", "ids"])


class Cutter:
    """Texts as runs of known ids with the rare pieces between them; nothing is kept from one slice of texts to the next."""

    def __init__(self, known: Known, ranks: dict[bytes, int], pattern: str, at_spaces: bool):
        self.known, self.ranks, self.pattern, self.at_spaces = known, ranks, regex.compile(pattern), at_spaces

    def _pieces(self, keys: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of all units, one after another, and how many each unit has."""
        pieces, sizes, found = [], np.ones(len(keys), np.int64), self.pattern.findall
        for i, k in enumerate(keys):
            if self.at_spaces and k.isalpha():
                pieces.append(" " + k)
                continue
            if self.at_spaces and (word := k.rstrip(MARKS)).isalpha():
                own = (" " + word, k[len(word) :])
            else:
                own = found(unit_text(k))
            pieces += own
            sizes[i] = len(own)
        return pieces, sizes

    def ids_of(self, keys: list[str]) -> tuple[pa.Array, list[str]]:
        """The ids of each unit as 32-bit integers; -1 - k stands for the k-th of the rare pieces that come with them."""
        pieces, sizes = self._pieces(keys)
        there, known = self.known.of(pieces)
        gaps = np.flatnonzero(~there)
        own, rare, long = [], [], {}
        for i in gaps.tolist():
            p = pieces[i]
            if 4 * len(p) > LONG and len(raw := p.encode()) > LONG:
                if p not in long:
                    long[p] = np.array(merged(raw, self.ranks), "<u4").tobytes()
                own.append(long[p])
            else:
                rare.append(p)
                own.append(struct.pack("<i", -len(rare)))
        place = np.empty(len(pieces), np.int64)
        place[there], place[gaps] = np.arange(len(known)), len(known) + np.arange(len(gaps))
        data, ends = joined(pa.concat_arrays([known, pa.array(own, pa.binary())]).cast(pa.large_binary()), pa.array(place))
        ends = ends[np.cumsum(np.append(0, sizes))]
        return pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(ends), data]), rare

    def cut(self, texts: pa.Array) -> pa.Array:
        """array of struct<runs, rare>: one run more than rare pieces. Equal units are looked up once for some texts together."""
        texts = texts.fill_null("")
        flat, rare, run_ends, text_runs, text_rare = bytearray(), [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        n_ids = n_runs = n_rare = 0
        for part in self._slices(texts):
            if self.at_spaces:
                lists = unit_lists(part)
                sizes, coded = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
                keys, index = coded.dictionary.to_pylist(), coded.indices
            else:
                keys = ["\t" + t for t in part.to_pylist()]
                sizes, index = np.ones(len(keys), np.int64), pa.array(range(len(keys)), pa.int32())
            own, own_rare = self.ids_of(keys)
            # all units' ids, one after another
            data, ends = joined(own, index)
            ids = np.frombuffer(data, "<i4")[: ends[-1] // 4]
            text_ends = ends[np.cumsum(sizes)] // 4
            # runs end where a rare piece stands and at the end of a text
            gaps = np.flatnonzero(ids < 0)
            before = np.searchsorted(gaps, text_ends)
            stops = np.concatenate([gaps - np.arange(len(gaps)), text_ends - before])
            order = np.argsort(np.concatenate([2 * gaps + 1, 2 * text_ends]), kind="stable")
            flat += ids[ids >= 0].tobytes()
            rare += [own_rare[k] for k in (-1 - ids[gaps]).tolist()]
            run_ends.append(n_ids + stops[order])
            text_runs.append(n_runs + before + np.arange(1, len(part) + 1))
            text_rare.append(n_rare + before)
            n_ids, n_runs, n_rare = len(flat) // 4, n_runs + len(stops), n_rare + len(gaps)
        offsets = lambda ends: pa.array(np.concatenate(ends).astype(np.int32))
        runs = pa.ListArray.from_arrays(offsets(run_ends), pa.Array.from_buffers(pa.int32(), n_ids, [None, pa.py_buffer(flat)]))
        parts = [pa.ListArray.from_arrays(offsets(ends), values) for ends, values in ((text_runs, runs), (text_rare, pa.array(rare, pa.string())))]
        return pa.StructArray.from_arrays(parts, names=["runs", "rare"])

    @staticmethod
    def _slices(texts: pa.Array, rows: int = 4096, size: int = 1 << 22):
        """Up to ``rows`` texts at a time, and about ``size`` bytes of them."""
        ends = np.cumsum(np.append(0, pc.binary_length(texts).to_numpy(zero_copy_only=False)))
        at = 0
        while at < len(texts):
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, ends[at] + size, "right")) - 1))
            yield texts.slice(at, stop - at)
            at = stop


def encode(docs: DataFrame, pairs: BytePairs, dictionary: int = 1_500_000, text_col: str = "text", out_col: str = "ids", at_spaces: bool = True) -> DataFrame:
    """``docs`` with the ids of its texts (array<int>) in ``out_col``.

    ``at_spaces``: whether the pattern always cuts before a single space between two other
    characters and beside a line feed between two others, and takes letters after a space as a piece and
    ASCII marks between them and a cut as another, as ``public_tokenizers.PATTERN`` does.
    """
    spark = docs.sparkSession
    # plans hold the parts to decode by as a literal; the descriptions that Spark keeps of them need not
    spark.conf.set("spark.sql.maxPlanStringLength", "8192")
    # a task's texts come to its Python worker, and its ids go back, some megabytes at a time
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    if at_spaces:  # what stands between spaces is counted first, so that the pattern is applied to each such unit once
        found = docs.select(F.explode(F.split(F.coalesce(text_col, F.lit("")), " ")).alias("unit")).groupBy("unit").count()
        found = found.select(F.explode(pairs.pieces(F.concat(F.lit(" "), F.col("unit")))).alias("piece"), "count").groupBy("piece").agg(F.sum("count").alias("count"))
    else:
        found = docs.select(F.explode(pairs.pieces(F.col(text_col))).alias("piece")).groupBy("piece").count()
    counts = saved(found.where("count > 1"), "pieces")
    common = counts.where((F.col("count") >= least_of_most(counts, "count", dictionary)) & (F.octet_length("piece") <= LONG))
    common = common.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("piece")
    folded = pairs.with_folds(common, "ids", lambda fold: fold(F.col("piece")))
    # folded by all tasks, then fetched some files at a time: the driver's JVM never holds all of them
    packed = saved(folded.mapInArrow(trimmed(Known.pack), "hashes binary, sizes binary, ids binary"), "known")
    known = Known(packed.toLocalIterator())
    shared = spark.sparkContext.broadcast((known, pairs.table, pairs.pattern))
    del known
    freed()

    @F.arrow_udf("struct<runs:array<array<int>>,rare:array<string>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cutter = Cutter(*shared.value, at_spaces)
        for texts in batches:
            yield cutter.cut(texts)
            freed(cycles=False)
        del cutter
        freed()

    held = docs.withColumn("__cut", cut(F.col(text_col)))

    def whole(fold):
        with_rare = F.transform(F.col("__cut.rare"), lambda p, i: F.flatten(F.array(fold(p), F.get(F.col("__cut.runs"), i + 1))))
        return F.concat(F.get(F.col("__cut.runs"), F.lit(0)), F.flatten(with_rare))

    return pairs.with_folds(held, out_col, whole).drop("__cut")


def op6_bpe(spark, sf_dir):
    import public_tokenizers

    from keepsake.llm.common import documents

    pairs = BytePairs(load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    encoded = encode(documents(spark, sf_dir).select("doc_id", "text"), pairs)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.replace(F.replace(F.to_json("ids"), F.lit("["), F.lit("")), F.lit("]"), F.lit("")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(pairs.decoded(F.col("ids")), 256).alias("decoded_sha256"),
    )
