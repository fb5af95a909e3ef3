"""Claims as JSON lines and Markdown: export, validation and all-or-nothing import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.operators import scan
from keepsake.schema import STATUSES, TYPES
from keepsake.sources.scratch import saved

SCHEMA_NAME = "keepsake.v1"
RECORD = (
    "schema string, id string, content string, type string, importance int, trust int, confidence double, status string, scope string, source string, session_id string, "
    "created_at string, updated_at string, last_confirmed_at string, superseded_by string, entities array<struct<name:string,type:string,aliases:array<string>>>, tags array<string>, content_hash string"
)
TYPE_ORDER = ("decision", "preference", "fact", "event", "note")
_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def time_text(t: Column) -> Column:
    return F.date_format(t, _TIME)


def _parsed_time(text: Column) -> Column:
    """RFC 3339 with its offset; null if it is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"), F.try_to_timestamp(text))


def exported(claims: DataFrame, names: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """The record of each claim as one JSON line, with created_at and id to order them by; secrets are masked in every export.

    ``names`` has id and entities, ``tags`` has id and tags, both arrays.
    """
    rows = scan.redacted_claims(claims)
    rows = rows.join(names, "id", "left") if names is not None else rows.withColumn("entities", F.lit(None).cast("array<struct<name:string,type:string,aliases:array<string>>>"))
    rows = rows.join(tags, "id", "left") if tags is not None else rows.withColumn("tags", F.lit(None).cast("array<string>"))
    have = set(rows.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    blank = lambda c: F.when(c != "", c)
    fields = {
        "schema": F.lit(SCHEMA_NAME), "id": F.col("id").cast("string"), "content": F.col("content"), "type": F.col("type"), "importance": F.col("importance"), "trust": F.col("trust"), "confidence": F.col("confidence"), "status": F.col("status"),
        "scope": blank(col("scope").cast("string")), "source": blank(col("source").cast("string")), "session_id": blank(col("session_id").cast("string")), "created_at": time_text(F.col("created_at")), "updated_at": time_text(F.col("updated_at")),
        "last_confirmed_at": time_text(F.col("last_confirmed_at")), "superseded_by": F.col("superseded_by").cast("string"), "entities": F.when(F.size("entities") > 0, F.col("entities")), "tags": F.when(F.size("tags") > 0, F.col("tags")), "content_hash": X.content_hash(F.col("content")),
    }
    return rows.select("id", "created_at", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Oldest first over all files, so that a replay keeps the order in which claims replaced each other."""
    lines.repartitionByRange(F.col("created_at"), F.col("id")).sortWithinPartitions("created_at", "id").select("line").write.text(path)


def markdown(claims: DataFrame) -> DataFrame:
    """place of the type, created_at, id and line: a readable list by type, oldest first in each."""
    rows = scan.redacted_claims(claims)
    place = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type")).cast("int")
    asof = F.when(F.col("type").isin("event", "note") & F.col("last_confirmed_at").isNotNull(), F.concat(F.lit("as of "), F.date_format("last_confirmed_at", "yyyy-MM-dd")))
    meta = F.concat_ws(", ", X.short_id(F.col("id")), F.concat(F.lit("T"), F.col("trust").cast("string")), F.when(F.col("status") != "active", F.col("status")), asof)
    return rows.select(place.alias("place"), "type", "created_at", "id", F.concat(F.lit("- "), F.col("content"), F.lit(" _("), meta, F.lit(")_")).alias("line")).where("place > 0")


def decision_entries(claims: DataFrame, chain: DataFrame) -> DataFrame:
    """id, hop and line of live decisions: hop 0 the decision, then what it replaced (``chain`` has start, hop, id)."""
    rows = scan.redacted_claims(claims)
    now = rows.where((F.col("type") == "decision") & F.col("status").isin("active", "aging"))
    head = F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit(" — "), X.title_line(F.col("content")))
    older = chain.join(now.select(F.col("id").alias("start")), "start", "left_semi").join(rows.select("id", "content", "updated_at"), "id")
    return now.select("id", F.lit(0).alias("hop"), head.alias("line")).unionByName(older.select(F.col("start").alias("id"), "hop", F.concat(F.lit("- supersedes ("), F.date_format("updated_at", "yyyy-MM-dd"), F.lit("): "), F.col("content")).alias("line")))


def read_lines(lines: DataFrame) -> DataFrame:
    """Records from rows (line_no, text): blank lines and comments are left out; ``bad`` tells what does not parse."""
    kept = lines.withColumn("text", X.trim_space(F.col("text"))).where("text <> '' and not startswith(text, '#')")
    record = F.from_json("text", RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return kept.select("line_no", record.alias("r")).select("line_no", "r.*").withColumnRenamed("_bad", "bad")


def validated(records: DataFrame, held: DataFrame) -> DataFrame:
    """``records`` with ``error`` (the first fault, null if none), content hash ``h`` and the claim ``twin`` that already has this content.

    ``held`` are the store's claims (id as text, content_hash). Duplicate ids and contents are found
    over the whole input: the first line of each stands.
    """
    records = saved(records, "records")
    first = records.where("bad is null and id is not null").groupBy("id").agg(F.min("line_no").alias("first_line"))
    r = records.join(first, "id", "left").withColumn("h", X.content_hash(F.col("content")))
    blank = lambda c: F.coalesce(X.trim_space(c), F.lit("")) == ""
    fails = lambda c, needed: (F.lit(needed) & blank(c)) | (~blank(c) & _parsed_time(c).isNull())
    bad_entity = F.exists(F.coalesce("entities", F.array()), lambda e: blank(e["name"]) | ~F.coalesce(F.when(e["type"] != "", e["type"]), F.lit("other")).isin("person", "project", "org", "other"))
    importance = F.when(F.coalesce("importance", F.lit(0)) == 0, 3).otherwise(F.col("importance"))
    confidence = F.coalesce("confidence", F.lit(0.0))
    faults = [
        (F.col("bad").isNotNull(), "no JSON record"),
        (F.coalesce("schema", F.lit("")) != SCHEMA_NAME, "unsupported schema"),
        (blank(F.col("id")), "empty id"),
        (F.col("line_no") > F.col("first_line"), "duplicate id"),
        (blank(F.col("content")), "empty content"),
        (~F.coalesce("type", F.lit("")).isin(*TYPES), "bad type"),
        (~F.coalesce("trust", F.lit(0)).isin(0, 1, 2, 3), "bad trust tier"),
        (~F.coalesce("scope", F.lit("")).isin("", "global", "project"), "bad scope"),
        (~F.coalesce("status", F.lit("")).isin(*STATUSES), "bad status"),
        (fails(F.col("created_at"), True), "bad created_at"),
        (fails(F.col("updated_at"), True), "bad updated_at"),
        (fails(F.col("last_confirmed_at"), False), "bad last_confirmed_at"),
        (bad_entity, "invalid entity name or type"),
        (F.coalesce("content_hash", F.lit("")) != F.col("h"), "content_hash does not match content"),
        (~importance.between(1, 5) | ~confidence.between(0, 1), "importance or confidence out of range"),
    ]
    error = F.lit(None).cast("string")
    for fault, name in reversed(faults):
        error = F.when(fault, name).otherwise(error)
    r = saved(r.withColumns({"error": error, "importance": importance, "confidence": confidence}), "checked")
    earlier = r.where("error is null").groupBy("h").agg(F.min_by("id", "line_no").alias("first_id"))
    twins = held.groupBy(F.col("content_hash").alias("h")).agg(F.min("id").alias("held_id"))
    r = r.join(earlier, "h", "left").join(twins, "h", "left")
    twin = F.when(F.col("error").isNull(), F.coalesce("held_id", F.when(F.col("first_id") != F.col("id"), F.col("first_id"))))
    r = r.withColumn("twin", twin)
    # what a claim is replaced by must be in the input or in the store
    known = r.where("error is null").select(F.col("id").alias("superseded_by")).unionByName(held.select(F.col("id").alias("superseded_by"))).distinct().withColumn("known", F.lit(True))
    r = r.join(known, "superseded_by", "left")
    dangling = F.col("error").isNull() & F.col("twin").isNull() & ~blank(F.col("superseded_by")) & F.col("known").isNull()
    return r.withColumn("error", F.when(dangling, "superseded_by references unknown id").otherwise(F.col("error"))).drop("first_line", "first_id", "held_id", "known")


def imported(checked: DataFrame, held: DataFrame) -> DataFrame:
    """The claims to append; none at all if any record has a fault.

    Records whose content is there already are skipped and stand for it; an id that the store has
    gets a new one from its content. Tier 3 never becomes live.
    """
    faulty = checked.agg(F.count_if(F.col("error").isNotNull()).alias("faults"))
    taken = held.select("id", F.lit(True).alias("taken")).distinct()
    rows = checked.join(taken, "id", "left")
    final = rows.withColumn("new_id", F.coalesce("twin", F.when(F.col("taken"), F.substring("h", 1, 26)), F.col("id")))
    ids = final.where("error is null").select(F.col("id").alias("superseded_by"), F.col("new_id").alias("target"))
    status = F.when((F.coalesce("trust", F.lit(0)) == 3) & F.col("status").isin("active", "aging"), "quarantined").otherwise(F.col("status"))
    out = final.where("twin is null").join(ids, "superseded_by", "left").join(F.broadcast(faulty), F.lit(True)).where("faults = 0")
    times = [_parsed_time(F.col(c)).alias(c) for c in ("created_at", "updated_at", "last_confirmed_at")]
    return out.select(F.col("new_id").alias("id"), "content", "type", "importance", F.coalesce("trust", F.lit(0)).alias("trust"), "confidence", status.alias("status"), "scope", "source", "session_id", *times, F.coalesce("target", F.when(F.col("superseded_by") != "", F.col("superseded_by"))).alias("superseded_by"), "entities", "tags", F.col("h").alias("content_hash"))
