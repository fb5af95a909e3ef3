"""The store as snapshots and a journal, and every change of state as a transformation of both.

A commit writes the changed tables and the journal's new rows to folders of their own and then publishes
one small entry that names them: a second writer of the same version fails and changes nothing, and without the
entry nothing of a commit is visible. Rows are never deleted. A change takes a table and the ids to
change and gives the new table and journal rows (op, memory_id, payload as JSON, ts).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import text as X
from keepsake.functions.ranking import initial_confidence
from keepsake.operators import belief, scan
from keepsake.schema import STATUSES, TYPES
from keepsake.sources import publish
from keepsake.sources.scratch import saved

OPS_SCHEMA = "op string, memory_id long, payload string, ts timestamp, undo string"
Change = tuple[DataFrame, DataFrame]


class Ledger:
    """The published versions of some tables in a folder that all executors share; each is plain Parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        return publish.last(self.spark, f"{self.path}/commits")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the last one); readers of a version are not disturbed by later commits."""
        tables = publish.entry(self.spark, f"{self.path}/commits", version).get("tables", {})
        return self.spark.read.parquet(f"{self.path}/{name}/{tables[name]}")

    def journal(self, version: int | None = None) -> DataFrame:
        """The rows of all commits (up to ``version``); what a failed commit wrote has no entry and so no rows."""
        commits = publish.entries(self.spark, f"{self.path}/commits", "version int, ops string")
        if not self.version():
            return self.spark.createDataFrame([], OPS_SCHEMA + ", version int")
        commits = commits if version is None else commits.where(F.col("version") <= version)
        rows = self.spark.read.schema(OPS_SCHEMA + ", token string").parquet(f"{self.path}/ops")
        return rows.join(commits.select("version", F.col("ops").alias("token")), "token").drop("token")

    def commit(self, tables: dict[str, DataFrame], ops: DataFrame | None = None, seen: int | None = None) -> int:
        """Publishes new contents of some tables with the journal's rows; the others stay as they are.

        ``seen`` is the version that the contents were made from (the last one); where another
        writer has published since, ``publish.Taken`` is raised and nothing changes.
        """
        seen = self.version() if seen is None else seen
        held, token = publish.entry(self.spark, f"{self.path}/commits", seen).get("tables", {}) if seen else {}, uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{token}")
        rows = ops if ops is not None else self.spark.createDataFrame([], OPS_SCHEMA)
        rows.select("op", "memory_id", "payload", "ts", F.col("undo") if "undo" in rows.columns else F.lit(None).cast("string").alias("undo")).write.parquet(f"{self.path}/ops/token={token}")
        publish.publish(self.spark, f"{self.path}/commits", seen + 1, {"version": seen + 1, "tables": held | dict.fromkeys(tables, token), "ops": token})
        return seen + 1


# --- changes of state ----------------------------------------------------------------------------


_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _plain(memories: DataFrame, name: str) -> Column:
    """A column as the journal writes it: times to the microsecond."""
    return F.date_format(name, _TIME) if memories.schema[name].dataType.typeName() == "timestamp" else F.col(name)


def changed(memories: DataFrame, ids: DataFrame, sets: dict[str, Column], op: str, payload: dict[str, Column], now: Column, touch: bool = True) -> Change:
    """Sets columns of the claims that ``ids`` names; its other columns can be used as ``x.name``.

    ``payload`` columns are of the rows as they were. The journal rows' ``undo`` has every column that the change
    sets with its value before it (JSON, nulls included), so that the journal alone can undo it.
    """
    x = ids.dropDuplicates(["id"])
    x = x.select(F.col("id"), F.struct(F.lit(True).alias("hit"), *[F.col(c) for c in x.columns if c != "id"]).alias("x"))
    both = memories.join(x, "id", "left")
    hit = F.col("x").isNotNull()
    cols = dict(sets) | ({"updated_at": now} if touch else {})
    was = [_plain(memories, k).alias(k) for k in cols if k not in ("embedding", "content_hash")]
    out = both.withColumns({k: F.when(hit, v.cast(memories.schema[k].dataType)).otherwise(F.col(k)) for k, v in cols.items()}).select(*memories.columns)
    ops = both.where(hit).select(F.lit(op).alias("op"), F.col("id").alias("memory_id"), F.to_json(F.struct(*[v.alias(k) for k, v in payload.items()])).alias("payload"), now.alias("ts"), F.to_json(F.struct(*was), {"ignoreNullFields": "false"}).alias("undo"))
    return out, ops


def set_status(memories: DataFrame, ids: DataFrame, status: str, op: str, now: Column) -> Change:
    return changed(memories, ids, {"status": F.lit(status)}, op, {"prev": F.col("status"), "next": F.lit(status)}, now)


def supersede(memories: DataFrame, pairs: DataFrame, now: Column) -> Change:
    """``pairs``: id and by, the claim that takes its place."""
    by = F.col("x.by")
    return changed(memories, pairs, {"status": F.lit("superseded"), "superseded_by": by}, "supersede", {"prev": F.col("status"), "prev_superseded_by": F.col("superseded_by"), "superseded_by": by}, now)


def reconfirm(memories: DataFrame, ids: DataFrame, now: Column) -> Change:
    """``ids``: id, times and importance (the highest said). A tenth more confidence each time, to 1; aging claims are active again."""
    confidence = F.least(F.lit(1.0), F.col("confidence") + 0.1 * F.col("x.times"))
    sets = {"confidence": confidence, "importance": F.greatest("importance", F.col("x.importance")), "status": F.when(F.col("status") == "aging", "active").otherwise(F.col("status")), "last_confirmed_at": now}
    return changed(memories, ids, sets, "reconfirm", {"confidence": confidence, "prev_confidence": F.col("confidence"), "prev_status": F.col("status")}, now)


def set_trust(memories: DataFrame, ids: DataFrame, trust: int, now: Column) -> Change:
    return changed(memories, ids, {"trust": F.lit(trust)}, "edit", {"prev_trust": F.col("trust"), "trust": F.lit(trust)}, now)


def set_confidence(memories: DataFrame, ids: DataFrame, confidence: float, now: Column) -> Change:
    """Does not count as an update of the claim."""
    return changed(memories, ids, {"confidence": F.lit(confidence)}, "edit", {"prev_confidence": F.col("confidence"), "confidence": F.lit(confidence)}, now, touch=False)


def update_content(memories: DataFrame, texts: DataFrame, reason: str, now: Column) -> Change:
    """``texts``: id and content. The vector is dropped, the old text kept in the journal."""
    sets = {"content": F.col("x.content")}
    if "content_hash" in memories.columns:
        sets["content_hash"] = X.content_hash(F.col("x.content"))
    if "embedding" in memories.columns:
        sets["embedding"] = F.lit(None)
    return changed(memories, texts, sets, "edit", {"prev_content": F.col("content"), "reason": F.lit(reason)}, now)


def approve(memories: DataFrame, flags: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tier 1, confidence 0.95; quarantined claims become active, aging ones stay so; their flags are resolved."""
    status = F.when(F.col("status") == "quarantined", "active").otherwise(F.col("status"))
    out, ops = changed(memories, ids, {"trust": F.lit(1), "confidence": F.lit(0.95), "status": status}, "approve", {"prev_status": F.col("status"), "prev_trust": F.col("trust"), "prev_confidence": F.col("confidence")}, now)
    return out, resolve_flags(flags, ids, now), ops


def reject(memories: DataFrame, flags: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    out, ops = set_status(memories, ids, "tombstoned", "reject", now)
    return out, resolve_flags(flags, ids, now), ops


def forget(memories: DataFrame, ids: DataFrame, now: Column) -> Change:
    """Tombstones; texts stay in rows and journal. What is tombstoned already stays as it is."""
    live = memories.where(F.col("status").isin("active", "aging", "quarantined", "superseded")).select("id")
    return set_status(memories, ids.join(live, "id", "left_semi"), "tombstoned", "tombstone", now)


def restore(memories: DataFrame, ids: DataFrame, now: Column) -> Change:
    """Tombstoned and quarantined claims become active, tier 3 quarantined; superseded and active ones stay."""
    able = memories.where(~F.col("status").isin("active", "superseded")).select("id")
    target = F.when(F.col("trust") == 3, "quarantined").otherwise("active")
    return changed(memories, ids.join(able, "id", "left_semi"), {"status": target}, "restore", {"prev": F.col("status"), "next": target}, now)


def replace_vectors(memories: DataFrame, vectors: DataFrame, model: str, now: Column) -> Change:
    """All vectors away, then those of ``vectors`` (id, v) for live claims; one row of the journal for all."""
    x = vectors.select("id", F.col("v").alias("__v"))
    v = F.when(F.col("status").isin("active", "aging"), F.col("__v"))
    out = memories.drop("embedding").join(x, "id", "left").withColumn("embedding", v).select(*[c for c in memories.columns if c != "embedding"], "embedding")
    ops = out.agg(F.count("embedding").alias("n")).select(F.lit("reembed").alias("op"), F.lit(None).cast("long").alias("memory_id"), F.to_json(F.struct(F.lit(model).alias("model"), F.col("n").alias("rows"))).alias("payload"), now.alias("ts"))
    return out, ops


def missing_vectors(memories: DataFrame, column: Callable[[Column], Column]) -> DataFrame:
    """id and v of live claims without a vector, by an embedder's ``column``."""
    return memories.where(F.col("status").isin("active", "aging") & F.col("embedding").isNull()).select("id", column(F.col("content")).alias("v"))


# --- flags, entities, tags -----------------------------------------------------------------------


def open_flags(flags: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    out = flags.where("resolved_at is null")
    return out if ids is None else out.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")


def resolve_flags(flags: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    x = ids.select(F.col("id").alias("memory_id"), F.lit(True).alias("__x")).distinct()
    return flags.join(x, "memory_id", "left").withColumn("resolved_at", F.when(F.col("__x") & F.col("resolved_at").isNull(), now).otherwise(F.col("resolved_at"))).select(*flags.columns)


def pending(memories: DataFrame, flags: DataFrame, everything: bool = False) -> DataFrame:
    """id and reasons of what waits for review: all that is quarantined, and live claims with an open flag.

    Flags that only ask for review count for live claims only with ``everything``. Reasons come in
    order: the quarantine, then flags by their id, each once.
    """
    quarantined = memories.where("status = 'quarantined'").select("id", F.lit(-1).cast("long").alias("o"), F.concat(F.lit("quarantined (T"), F.col("trust").cast("string"), F.lit(")")).alias("reason"))
    said = F.concat("kind", F.lit(": "), "detail")
    opened = open_flags(flags).join(memories.select(F.col("id").alias("memory_id"), "status"), "memory_id")
    counts = (F.col("status") == "quarantined") | (F.col("status").isin("active", "aging") & (F.lit(everything) | (F.col("kind") != "needs-review")))
    waiting = quarantined.select("id").unionByName(opened.where(counts).select(F.col("memory_id").alias("id"))).distinct()
    reasons = quarantined.unionByName(opened.select(F.col("memory_id").alias("id"), F.col("flag_id").cast("long").alias("o"), said.alias("reason"))).groupBy("id", "reason").agg(F.min("o").alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "reason"))), lambda x: x["reason"])
    return reasons.join(waiting, "id", "left_semi").groupBy("id").agg(F.array_join(listed, "; ").alias("reasons"))


def upsert_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``entities`` (name, type, aliases) with the names of ``mentions`` (name, type, aliases) that no name or alias has yet.

    A known entity of type other takes a better type and new aliases; names are equal whatever their case.
    """
    keys = entities.select(F.col("name").alias("canonical"), F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), F.transform("aliases", F.lower)))).alias("key"), F.lower("name").alias("own"))
    best = keys.groupBy("key").agg(F.min(F.struct((F.col("own") != F.col("key")).alias("by"), "canonical")).alias("k")).select("key", F.col("k.canonical").alias("canonical"))
    m = mentions.withColumn("key", F.lower(F.trim("name"))).where("key <> ''").join(best, "key", "left")
    news = m.withColumn("canonical", F.coalesce("canonical", F.trim("name"))).withColumn("k", F.lower("canonical"))
    grouped = news.groupBy("k").agg(F.min("canonical").alias("said"), F.min(F.when(F.col("type") != "other", F.col("type"))).alias("better"), F.flatten(F.collect_set(F.coalesce("aliases", F.array().cast("array<string>")))).alias("more"))
    both = entities.withColumn("k", F.lower("name")).join(grouped, "k", "full_outer")
    name = F.coalesce("name", "said")
    kind = F.when(F.coalesce("type", F.lit("other")) == "other", F.coalesce("better", F.lit("other"))).otherwise(F.col("type"))
    aliases = X.clean_aliases(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))), name)
    return both.select(name.alias("name"), kind.alias("type"), aliases.alias("aliases"))


def add_links(links: DataFrame, more: DataFrame) -> DataFrame:
    """Links with new ones, each once: only what is new is appended."""
    return links.unionByName(more.select(*links.columns).distinct().join(links, links.columns, "left_anti"))


def attached(memories: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """``memories`` with entities: array<struct<name, type>> by name."""
    listed = links.join(entities.select("name", "type"), "name").groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("entities"))
    return memories.join(listed, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<struct<name:string,type:string>>")))


# --- the write path ------------------------------------------------------------------------------

LONGEST, POOL = 4000, 5000


def prepared(batch: DataFrame, force: bool = False, block: bool = False, keep: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """Each write (id, place, content, type, importance, trust, quarantine) screened on its own: action so far (null: goes on), reason, and its columns made good.

    Validation comes first; then texts shaped like instructions (a user's own become preferences,
    others are quarantined at tier 3); then the scan, which refuses, or masks secrets where forced.
    ``keep`` holds the rows once they are scanned; a stream, which cannot, passes them on.
    """
    b = batch.withColumn("content", F.coalesce(X.trim_space(F.col("content")), F.lit("")))
    known = F.coalesce("type", F.lit("")).isin("", *TYPES)
    invalid = (
        F.when(F.col("content") == "", "empty content").when(F.octet_length("content") > LONGEST, "content too long").when(~known, "unknown type")
        .when(~F.coalesce("importance", F.lit(0)).between(0, 5), "importance must be 1..5").when(~F.coalesce("trust", F.lit(-1)).isin(0, 1, 2, 3), "invalid trust tier")
    )
    b = b.withColumns({"reason": invalid, "__shaped": belief.imperative(F.col("content")) != ""})
    own = F.col("__shaped") & (F.col("trust") == 0)
    other = F.col("__shaped") & (F.col("trust") != 0)
    b = b.withColumns(
        {
            "content": F.when(own, X.normalised_imperative(F.col("content"))).otherwise(F.col("content")),
            "type": F.when(F.coalesce("type", F.lit("")) != "", F.col("type")).when(own, "preference").otherwise("fact"),
            "quarantine": F.coalesce("quarantine", F.lit(False)) | other,
            "trust": F.when(other, 3).otherwise(F.col("trust")),
            "importance": F.when(F.coalesce("importance", F.lit(0)) == 0, 3).otherwise(F.col("importance")),
            "why": F.when(other, "instruction-shaped content from non-user source"),
        }
    )
    b = keep(b.withColumn("__found", scan.findings(F.col("content"), random=True)), "scanned")
    found, secrets = F.size("__found") > 0, scan.secrets_of(F.col("__found"))
    refused = found & F.lit(block or not force)
    line = F.concat(F.lit("scan.mode=block: " if block else "detected "), scan.summary_line(F.col("__found")))
    b = b.withColumns(
        {
            "action": F.when(F.col("reason").isNotNull(), "invalid").when(refused, "refused"),
            "reason": F.coalesce("reason", F.when(refused, line), "why"),
            "content": F.when(~refused & (F.size(secrets) > 0), scan.masked(F.col("content"), secrets)).otherwise(F.col("content")),
        }
    )
    return b.drop("__found", "__shaped", "why").withColumns({"content_hash": X.content_hash(F.col("content")), "status": F.when(F.col("quarantine"), "quarantined").otherwise("active"), "confidence": initial_confidence(F.col("trust"))})


def dispositions(batch: DataFrame, memories: DataFrame, names: DataFrame, force: bool = False, block: bool = False, pool: int = POOL) -> DataFrame:
    """``prepared`` with action (created, reconfirmed, superseded, quarantined, refused, invalid), existing (the claim it meets) and ambiguous.

    Writes are judged against the newest ``pool`` live claims. Within a batch the first write of a content
    stands for the others, which reconfirm it. Quarantined and tier 3 writes are not judged.
    """
    b = saved(prepared(batch, force, block), "writes")  # the screens are run once
    judged = b.where("action is null and not quarantine and trust < 3")
    first = judged.groupBy("content_hash").agg(F.min_by("id", F.struct("place", "id")).alias("first_id"))
    held = memories.where(F.col("status").isin("active", "aging")).orderBy(F.desc("updated_at"), "id").limit(pool)
    found = belief.adjudicated(judged.join(first.select(F.col("first_id").alias("id")), "id", "left_semi").select("id", "content"), held, names)
    found = found.select(F.col("new_id").alias("first_id"), "old_id", "verdict")
    rows = b.join(judged.select("id", "content_hash").join(first, "content_hash").join(found, "first_id", "left").drop("content_hash"), "id", "left")
    twin = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("id"))
    action = (
        F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("quarantine"), "quarantined").when(twin | (F.col("verdict") == "duplicate"), "reconfirmed")
        .when(F.col("verdict") == "supersedes", "superseded").otherwise("created")
    )
    existing = F.when(F.col("verdict").isin("duplicate", "supersedes") & (~twin | (F.col("verdict") == "duplicate")), F.col("old_id")).when(twin, F.col("first_id"))
    return rows.withColumns({"action": action, "existing": existing, "ambiguous": F.when((F.col("verdict") == "ambiguous") & ~twin, F.col("old_id"))}).drop("first_id", "old_id", "verdict")


def applied(done: DataFrame, memories: DataFrame, flags: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """memories, flags and journal rows after the writes of ``dispositions``."""
    new = done.where(F.col("action").isin("created", "superseded", "quarantined"))
    have = set(new.columns)
    stamps = {"created_at": now, "updated_at": now, "last_confirmed_at": now}
    row = [(stamps[c] if c in stamps else F.col(c) if c in have and c != "superseded_by" else F.lit(None)).cast(memories.schema[c].dataType).alias(c) for c in memories.columns]
    out = memories.unionByName(new.select(*row))
    again = done.where("action = 'reconfirmed'").groupBy(F.col("existing").alias("id")).agg(F.count("*").alias("times"), F.max("importance").alias("importance"))
    out, op1 = reconfirm(out, again, now)
    out, op2 = supersede(out, done.where("action = 'superseded'").groupBy(F.col("existing").alias("id")).agg(F.max("id").alias("by")), now)
    made = new.select(F.lit("create").alias("op"), F.col("id").alias("memory_id"), F.to_json(F.struct("type", "trust", "status")).alias("payload"), now.alias("ts"))
    held = new.where("quarantine").select(F.lit("quarantine").alias("op"), F.col("id").alias("memory_id"), F.to_json(F.struct("reason")).alias("payload"), now.alias("ts"))
    doubts = done.where("ambiguous is not null").select("id", F.lit("ambiguity").alias("kind"), F.concat(F.lit("similar to "), F.col("ambiguous").cast("string")).alias("detail"))
    kind = F.when(F.col("reason").contains("instruction-shaped"), "instruction-shape").otherwise("tainted")
    marks = doubts.unionByName(new.where("quarantine").select("id", kind.alias("kind"), F.coalesce("reason", F.lit("")).alias("detail")))
    more = marks.select(F.xxhash64("id", "kind").alias("flag_id"), F.col("id").alias("memory_id"), "kind", "detail", now.alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"))
    return out, flags.unionByName(more.select(*flags.columns)), made.unionByName(held).unionByName(op1, allowMissingColumns=True).unionByName(op2)


def valid_statuses(col: Column) -> Column:
    return col.isin(*STATUSES)
