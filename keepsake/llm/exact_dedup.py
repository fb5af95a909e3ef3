"""Exact deduplication by an extendible-hash index on shared files.

Map tasks read every row once and keep a bounded table of the texts they have met: copies within a
task become one entry (largest id, number of rows) before anything is shuffled. Rows (with the number
of their entry) and entries (with text and a 64-bit key) are written to the shared folder; these files
are the pages of the index.

The directory has one slot for each prefix of a key. Bytes are counted by prefix; a bucket that holds
more than ``capacity`` is split by one more bit, and where its depth reaches that of the directory, the
directory doubles. A bucket that more bits cannot split (all its bytes belong to few keys) is chained over
overflow pages instead, each of bounded size, which merge on their own first; what is left of them meets in
the next pass. Each bucket is a range of keys and goes to one owner task, which chains entries of
one key and tells them apart by their bytes. No decision rests on a hash: of equal texts the row with
the largest id stays (ties of one id: one of the rows).

Rows find their class through the number of their entry, of which a hot text has one in each task, so no
key of that join is larger than what one task read.

Bounds: a task's table of texts holds ``held`` bytes (beyond, it starts anew; copies then meet at their
owner); an owner gets a page of about ``capacity`` bytes, or a single text that is longer. The directory
has 2**20 slots at most and is broadcast; capacity grows with the input, so that these are enough.

Edge cases: a null text counts as the empty text and is a copy of it. Null ids are smaller than all others;
a class of null ids only keeps one of its rows, with a null keep_id. Rows that repeat an id and text are copies, and
only one is kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keepsake.llm.common import documents, saved

KEY_BITS = 64
#: Depth that the directory may reach: 2**20 slots of 24 bytes are broadcast at most. Fuller buckets get overflow pages.
MOST_BITS = 20
#: Bytes of text that fill a bucket, at least.
CAPACITY = 4 << 20
#: Bytes that a map task holds to find its own copies.
HELD = 16 << 20
#: What an entry takes beside its text.
OVERHEAD = 200


def leading_bits(digest: bytes) -> int:
    """The first 64 bits of a sha256, as a signed long."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _entries(held: int, key_of: Callable[[bytes], int], id_type: pa.DataType):
    """Rows as (uid, id, entry) and entries as (entry, key, sha, size, text, best_id, best_uid, n), in one table with nulls."""

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        uid = entry = base
        texts: dict[bytes, list] = {}
        used = 0

        def flushed():
            rows = list(texts.items())
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                digests = [hashlib.sha256(t).digest() for t, _ in part]
                n = len(part)
                yield _batch(
                    {
                        "entry": pa.array([e[0] for _, e in part], pa.int64()),
                        "key": pa.array([key_of(d) for d in digests], pa.int64()),
                        "sha": pa.array([d.hex() for d in digests], pa.string()),
                        "size": pa.array([len(t) + OVERHEAD for t, _ in part], pa.int64()),
                        "text": pa.array([t for t, _ in part], pa.binary()),
                        "best_id": pa.array([e[1] for _, e in part], id_type),
                        "best_uid": pa.array([e[2] for _, e in part], pa.int64()),
                        "n": pa.array([e[3] for _, e in part], pa.int64()),
                    },
                    n,
                    id_type,
                )
            texts.clear()

        for batch in batches:
            ids, of_rows, first = batch.column(0).to_pylist(), [], uid
            column = batch.column(1)
            for at in range(len(ids)):
                text, i = column[at].as_py(), ids[at]
                e = texts.get(text)
                if e is None:
                    e = texts[text] = [entry, i, uid, 0]
                    entry += 1
                    used += len(text) + OVERHEAD
                elif i is not None and (e[1] is None or i > e[1]):
                    e[1], e[2] = i, uid
                e[3] += 1
                of_rows.append(e[0])
                uid += 1
                if used > held:
                    yield from flushed()
                    used = 0
            yield _batch({"uid": pa.array(np.arange(first, uid)), "id": batch.column(0), "of": pa.array(of_rows, pa.int64())}, len(ids), id_type)
        yield from flushed()

    return run


def _fields(id_type: pa.DataType) -> pa.Schema:
    long = pa.int64()
    return pa.schema([("uid", long), ("id", id_type), ("of", long), ("entry", long), ("key", long), ("sha", pa.string()), ("size", long), ("text", pa.binary()), ("best_id", id_type), ("best_uid", long), ("n", long)])


def _batch(columns: dict, n: int, id_type: pa.DataType) -> pa.RecordBatch:
    schema = _fields(id_type)
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _prefix(depth: int):
    """The first ``depth`` bits of the key."""
    return F.shiftrightunsigned("key", KEY_BITS - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int, step: int = 8, most_bits: int = MOST_BITS) -> list[tuple[int, int, int]]:
    """The buckets as (depth, prefix, pages), in the order of their keys.

    Bytes are counted ``step`` bits deeper at a time, and only in buckets that are still too full; ``pages`` is over 1
    where a bucket stays too full though it was split as far as its keys let it, or as far as ``most_bits``.
    """
    out: list = []
    open_, depth = [0], 0
    while open_:
        deeper = min(depth + step, most_bits)
        rows = entries
        if depth:  # bounded by the bytes of the table over ``capacity``
            rows = entries.join(F.broadcast(entries.sparkSession.createDataFrame([(p,) for p in open_], "p long")), _prefix(depth) == F.col("p"), "left_semi")
        counted = rows.groupBy(_prefix(deeper).alias("p")).agg(F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        below: dict[int, dict] = {p: {} for p in open_}
        for r in counted:
            below[r["p"] >> (deeper - depth)][r["p"]] = (r["b"], r["lo"] == r["hi"])
        open_ = []
        for p, counts in below.items():
            _split(depth, p, counts, deeper, most_bits, capacity, out, open_)
        depth = deeper
    return sorted(out, key=lambda b: b[1] << (KEY_BITS - b[0]))


def _split(depth: int, prefix: int, counts: dict, deeper: int, most_bits: int, capacity: int, out: list, open_: list) -> None:
    """Splits one bucket by single bits while it is too full and its counts tell how."""
    todo = [(depth, prefix, counts)]
    while todo:
        d, p, part = todo.pop()
        size = sum(b for b, _ in part.values())
        if size <= capacity:
            out.append((d, p, 1))
        elif d < deeper and not (len(part) == 1 and next(iter(part.values()))[1]):
            bit = deeper - d - 1
            for half in (0, 1):
                todo.append((d + 1, 2 * p + half, {q: x for q, x in part.items() if (q >> bit) & 1 == half}))
        elif d < most_bits and not all(one for _, one in part.values()):
            open_.append(p)  # counted further down
        else:
            out.append((d, p, math.ceil(size / capacity)))


def slots(buckets: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """The directory's depth and its slots (slot, bucket, pages): a bucket of less depth stands in several."""
    depth = max((d for d, _, _ in buckets), default=0)
    return depth, [(s, i, pages) for i, (d, p, pages) in enumerate(buckets) for s in range(p << (depth - d), (p + 1) << (depth - d))]


def _owner(id_type: pa.DataType):
    """Chains the entries of each key; entries with equal bytes are one class, named by its first entry."""
    schema = pa.schema([("entry", pa.int64()), ("rep", pa.int64()), ("sha", pa.string()), ("best_id", id_type), ("best_uid", pa.int64()), ("n", pa.int64()), ("pages", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_pylist() for c in ("entry", "key", "sha", "best_id", "best_uid", "n", "pages")}
        texts = table.column("text").combine_chunks()
        chains: dict[int, list] = {}
        of = []
        for at, (entry, key, sha, i, u, n) in enumerate(zip(*[rows[c] for c in ("entry", "key", "sha", "best_id", "best_uid", "n")], strict=True)):
            text = texts[at].as_buffer()
            chain = chains.setdefault(key, [])
            for c in chain:
                if c[0].equals(text):
                    if i is not None and (c[2] is None or i > c[2]) or i == c[2] and u < c[3]:
                        c[2], c[3] = i, u
                    c[4] += n
                    break
            else:
                c = [text, entry, i, u, n, sha]
                chain.append(c)
            of.append(c)
        return pa.Table.from_arrays(
            [
                pa.array(rows["entry"], pa.int64()),
                pa.array([c[1] for c in of], pa.int64()),
                pa.array([c[5] for c in of], pa.string()),
                pa.array([c[2] for c in of], id_type),
                pa.array([c[3] for c in of], pa.int64()),
                pa.array([c[4] for c in of], pa.int64()),
                pa.array(rows["pages"], pa.int64()),
            ],
            schema=schema,
        )

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, held: int = HELD, key_of: Callable[[bytes], int] = leading_bits, most_bits: int = MOST_BITS, report: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows as (uid, id, of: an entry), and entries as (entry, sha, best_id, best_uid, n) with the totals of their class.

    ``report``, if given, gets the depth and number of buckets of each pass.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)
    name = kind.simpleString()
    shape = f"uid long, id {name}, of long, entry long, key long, sha string, size long, text binary, best_id {name}, best_uid long, n long"
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    files = saved(docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(_entries(held, key_of, arrow), shape), "pages")
    rows = files.where("uid is not null").select("uid", "id", "of")
    entries = files.where("entry is not null").select("entry", "key", "sha", "size", "text", "best_id", "best_uid", "n")
    found = f"entry long, rep long, sha string, best_id {name}, best_uid long, n long, pages long"
    done: DataFrame | None = None
    names: DataFrame | None = None  # of entries whose pages have merged: entry, rep
    left: tuple[int, int] | None = None
    while True:
        total = entries.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
        stuck = left is not None and total["n"] == left[1]  # chains of different texts under one key do not shrink: they go to one owner
        left = (total["b"] or 0, total["n"])
        room = max(capacity or CAPACITY, 0 if capacity else left[0] >> (MOST_BITS - 1))
        buckets = directory(entries.select("key", "size"), room, most_bits=most_bits)
        depth, table = slots([(d, p, 1 if stuck else pages) for d, p, pages in buckets])
        if report is not None:
            report.setdefault("passes", []).append({"depth": depth, "buckets": len(buckets), "pages": sum(b[2] for b in buckets)})
        slot, bucket, count = np.array(table, dtype=np.int64).reshape(-1, 3).T
        where = F.broadcast(spark.createDataFrame(pa.table({"slot": slot, "bucket": bucket, "pages": count})))
        page = F.pmod(F.xxhash64("entry"), F.col("pages")).cast("int")
        placed = entries.withColumn("slot", _prefix(depth)).join(where, "slot").select("bucket", page.alias("page"), "entry", "key", "sha", "text", "best_id", "best_uid", "n", "pages")
        owned = saved(placed.groupBy("bucket", "page").applyInArrow(_owner(arrow), found), "owned")
        final = owned.where("pages = 1").drop("pages", "rep")
        if all(pages == 1 for _, _, pages in table):
            break
        # what the pages of too full buckets have left meets in another pass
        open_ = owned.where("pages > 1")
        firsts = open_.where("entry = rep").select("entry", "best_id", "best_uid", "n")
        texts = entries.select("entry", "key", "sha", "size", "text")
        merged = open_.select("entry", "rep")
        done = final if done is None else done.unionByName(final)
        names = merged if names is None else names.unionByName(merged)
        entries = saved(texts.join(firsts, "entry"), "entries")
    done = final if done is None else done.unionByName(final)
    if names is not None:
        # an entry that was merged on a page follows to the entry that stands for it, once for each pass
        follow = names.where("entry <> rep")
        at, moved = follow, True
        while moved:
            step = at.select("entry", "rep").join(follow.select(F.col("entry").alias("rep"), F.col("rep").alias("next")), "rep", "left")
            at = saved(step.select("entry", F.coalesce("next", "rep").alias("rep"), F.col("next").isNotNull().alias("moved")), "names")
            moved = not at.where("moved").isEmpty()
        done = done.unionByName(at.select("entry", "rep").join(done.withColumnRenamed("entry", "rep"), "rep").drop("rep"))
    return rows, done


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: its id, keep_id, group_size, kept and text_sha256. Options as of ``classes``."""
    rows, found = classes(docs, id_col, text_col, **options)
    out = rows.join(found, rows["of"] == found["entry"])
    return out.select(F.col("id").alias(id_col), F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("uid") == F.col("best_uid")).alias("kept"), F.col("sha").alias("text_sha256"))


def op11_exact_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
