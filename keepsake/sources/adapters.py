"""The engine's tables as views over the provided ones; every rule is a pure expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.ranking import initial_confidence

#: The moment that all decay is measured at.
NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from documents and labels."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trust = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0).otherwise(2)
    status = F.when(F.col("trust") == 3, "quarantined").when(F.col("id") % 10 == 0, "superseded").when(F.col("id") % 10 == 1, "tombstoned").when((F.col("id") % 10).isin(2, 3), "aging").otherwise("active")
    kinds = F.array(*[F.lit(x) for x in ("fact", "preference", "decision", "event", "note")])
    rows = d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("type"),
        (1 + F.col("doc_id") % 5).cast("int").alias("importance"),
        trust.cast("int").alias("trust"),
        F.col("source").alias("scope"),
        (F.lit("2024-01-30 00:00:00").cast("timestamp") - F.make_dt_interval(((F.col("doc_id") * 7) % 700).cast("int"))).alias("updated_at"),
    )
    return (
        rows.withColumn("status", status)
        .withColumn("confidence", initial_confidence(F.col("trust")))
        .withColumn("last_confirmed_at", F.col("updated_at") + F.make_dt_interval((F.col("id") % 30).cast("int")))
        .withColumn("superseded_by", F.when(F.col("status") == "superseded", F.col("id") + 10))
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and content of ``memories``: as many rows, but only labels that a document has twice are joined with the texts, so these cross no shuffle."""
    again = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    rows = table(spark, sf_dir, "documents").join(F.broadcast(again), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.explode(F.array_repeat(F.lit(1), F.coalesce("n", F.lit(1)))).alias("n")).drop("n")


#: The same table in SQL.
MEMORIES_SQL = """
m0 AS (
  SELECT d.doc_id AS id, d.text AS content, ['fact','preference','decision','event','note'][CAST(d.doc_id % 5 + 1 AS INT)] AS type,
    CAST(1 + d.doc_id % 5 AS INT) AS importance,
    CASE WHEN l.toxic = 1 THEN 3 WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 THEN 0 ELSE 2 END AS trust,
    d.source AS scope, TIMESTAMP '2024-01-30' - to_days(CAST((d.doc_id * 7) % 700 AS INT)) AS updated_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m1 AS (
  SELECT *, CASE WHEN trust = 3 THEN 'quarantined' WHEN id % 10 = 0 THEN 'superseded' WHEN id % 10 = 1 THEN 'tombstoned'
      WHEN id % 10 IN (2, 3) THEN 'aging' ELSE 'active' END AS status,
    CASE trust WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
    updated_at + to_days(CAST(id % 30 AS INT)) AS last_confirmed_at FROM m0),
memories AS (SELECT *, CASE WHEN status = 'superseded' THEN id + 10 END AS superseded_by FROM m1)
"""

OPS = {"view": "inject", "click": "reconfirm", "signup": "create", "purchase": "approve", "error": "reject"}


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal from events."""
    kinds = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("op_id"), "ts", F.coalesce(kinds[F.col("event_type")], F.col("event_type")).alias("op"), F.col("user_id").alias("memory_id"), F.col("value"), F.col("props").alias("payload"))


OPS_SQL = """
ops AS (
  SELECT event_id AS op_id, ts, CASE event_type WHEN 'view' THEN 'inject' WHEN 'click' THEN 'reconfirm' WHEN 'signup' THEN 'create'
    WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE event_type END AS op, user_id AS memory_id, value, props AS payload FROM events)
"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``memories`` with created_at."""
    return memories(spark, sf_dir).withColumn("created_at", F.col("updated_at") - F.make_dt_interval((F.col("id") % 20).cast("int")))


CLAIMS_SQL = MEMORIES_SQL.rstrip() + ",\nclaims AS (SELECT *, updated_at - to_days(CAST(id % 20 AS INT)) AS created_at FROM memories)\n"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, type and aliases: an entity a source and one a language; the latter's alias is its upper case."""
    d = table(spark, sf_dir, "documents")
    sources = d.where("source is not null").select(F.col("source").alias("name"), F.lit("project").alias("type"), F.array(F.concat(F.lit("the "), F.upper("source"))).alias("aliases")).distinct()
    langs = d.where("lang is not null").select(F.col("lang").alias("name"), F.lit("other").alias("type"), F.array(F.upper("lang")).alias("aliases")).distinct()
    return sources.unionByName(langs)


ENTITIES_SQL = """
entities AS (SELECT DISTINCT source AS name, 'project' AS type, ['the ' || upper(source)] AS aliases FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT DISTINCT lang, 'other', [upper(lang)] FROM documents WHERE lang IS NOT NULL)
"""


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id and name: every claim to its source, every third to its language."""
    d = table(spark, sf_dir, "documents")
    a = d.where("source is not null").select(F.col("doc_id").alias("memory_id"), F.col("source").alias("name"))
    return a.unionByName(d.where("lang is not null and doc_id % 3 = 0").select(F.col("doc_id").alias("memory_id"), F.col("lang").alias("name")))


LINKS_SQL = """
links AS (SELECT doc_id AS memory_id, source AS name FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND doc_id % 3 = 0)
"""


def tag_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id and tag: lower-cased and trimmed as they are written, each once."""
    d = table(spark, sf_dir, "documents")
    said = F.array(F.concat(F.lit(" "), F.upper("lang")), F.when(F.col("n_chars") > 2000, "Long").otherwise("Short "), F.lit("long"))
    rows = d.select(F.col("doc_id").alias("memory_id"), F.explode(said).alias("tag"))
    return rows.select("memory_id", F.lower(F.trim("tag")).alias("tag")).where("tag is not null and tag <> ''").distinct()


TAGS_SQL = """
tags AS (SELECT DISTINCT memory_id, lower(trim(tag)) AS tag FROM (SELECT doc_id AS memory_id, unnest([' ' || upper(lang), CASE WHEN n_chars > 2000 THEN 'Long' ELSE 'Short ' END, 'long']) AS tag FROM documents) WHERE tag IS NOT NULL AND trim(tag) <> '')
"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flag_id, memory_id, kind, detail, created_at and resolved_at (null: open) from labels."""
    rows = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0")
    kind = F.when(F.col("toxic") == 1, "tainted").when(F.col("doc_id") % 2 == 0, "ambiguity").otherwise("needs-review")
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return rows.select(F.col("doc_id").alias("flag_id"), F.col("doc_id").alias("memory_id"), kind.alias("kind"), F.concat(F.lit("label of "), F.col("doc_id").cast("string")).alias("detail"), day.alias("created_at"), F.when(F.col("doc_id") % 5 == 0, day).alias("resolved_at"))


FLAGS_SQL = """
flags AS (SELECT doc_id AS flag_id, doc_id AS memory_id, CASE WHEN toxic = 1 THEN 'tainted' WHEN doc_id % 2 = 0 THEN 'ambiguity' ELSE 'needs-review' END AS kind, 'label of ' || CAST(doc_id AS VARCHAR) AS detail,
  CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-01' END AS resolved_at FROM labels WHERE toxic = 1 OR quality = 0)
"""


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and query: the passages of ``benchmark`` as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
