import hashlib
import random
import struct

import duckdb
import pytest
from pyspark.sql import types as T

from keepsake.llm.exact_dedup import OP11_SQL, directory, exact_duplicates, leading_bits, op11_exact_dedup, slots

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, keep_id string, kept long"


def brute(rows):
    """doc_id, keep_id, group_size, kept and sha256 of every row, as a sorted list."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best, sha = max(known, default=None), hashlib.sha256(t.encode()).hexdigest()
        once = True
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, best, len(ids), once, sha))
            once = False
    return sorted(out, key=str)


def case():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 6)))) for i in range(600)]
    rows += [(1000 + i, "one hot text") for i in range(400)]  # a third of all rows
    rows += [(None, "one hot text"), (None, "nobody's"), (None, "nobody's"), (5, None), (6, ""), (7, None), (3000, "again"), (3000, "again"), (3000, "other"), (8, "é" * 3000), (9, "é" * 3000), (10, "é")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"capacity": 3000}, {"capacity": 900, "held": 2000}, {"capacity": 2000, "held": 1, "most_bits": 10, "key_of": lambda d: leading_bits(d) % 3}, {"capacity": 4000, "key_of": lambda d: -(d[0] % 2)}])
def test_equals_brute_force(spark, options):
    rows = case()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(6)
    report = {}
    got = exact_duplicates(df, report=report, **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    if options.get("held") == 2000:
        assert report["passes"][0]["depth"] > 3  # buckets were split, the directory doubled
    if options.get("held") == 1:
        assert len(report["passes"]) > 1 and report["passes"][0]["pages"] > report["passes"][0]["buckets"]  # overflow pages


def test_empty_table_and_text_ids(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", "y")], "name string, body string")
    got = sorted((tuple(r)[:4] for r in exact_duplicates(df, "name", "body").collect()), key=str)
    assert got == [("a", "b", 3, False), ("b", "b", 3, True), ("c", "c", 1, True), (None, "b", 3, False)]


def test_directory_doubles_where_it_must(spark):
    keys = [struct.unpack(">q", struct.pack(">Q", k << 56))[0] for k in range(8)]  # all under prefix 00000
    far = struct.unpack(">q", struct.pack(">Q", 1 << 63))[0]
    entries = spark.createDataFrame([(k, 10) for k in keys] + [(far, 10)] * 9, "key long, size long")
    buckets = directory(entries, 20)
    assert [b for b in buckets if b[2] > 1] == [(1, 1, 5)] or [b for b in buckets if b[2] > 1][0][2] == 5  # one key, never split
    depth, table = slots(buckets)
    assert depth == 7 and [s for s, _, _ in table] == list(range(128))
    assert sum(1 for d, _, _ in buckets if d == 7) == 4  # two keys of ten bytes each
    assert directory(entries.limit(0), 20) == [(0, 0, 1)]


def test_very_long_and_odd_types(spark):
    schema = T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("text", T.StringType())])
    long = "word " * 400_000
    rows = [(1, long), (2, long), (3, long + "x")]
    got = sorted(tuple(r) for r in exact_duplicates(spark.createDataFrame(rows, schema), capacity=1000).collect())
    assert got == sorted(brute(rows), key=lambda r: r[0])


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = op11_exact_dedup(spark, SF)
    want = con.execute(OP11_SQL).fetchall()
    assert [d[0] for d in con.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
