"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from keepsake.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    assert canon(tuple(r) for r in df.select(*columns).collect()) == canon(want)


def test_queries_without_sql(spark):
    rows = Q.QUERIES["consolidate_survivors"](spark, SF).collect()
    kept = {r["id"] for r in rows if r["superseded_by"] is None}
    assert all(r["superseded_by"] in kept for r in rows if r["superseded_by"] is not None)


@pytest.mark.parametrize("name", ["recall_hybrid", "extract_entities", "scan_report", "redact_all", "digest_summary", "export_lines", "export_markdown", "import_validate"])
def test_runs_over_the_tables(spark, name):
    """The rest of the queries without SQL; their operators are held against loops in the other tests."""
    df = Q.QUERIES[name](spark, SF)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
