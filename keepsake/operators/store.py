"""Reads and folds over the store: filters, counts, entities, chains and the journal.

State changes are folds over an append-only journal, so history is never rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keepsake.functions import text as X
from keepsake.sources.scratch import saved

#: The longest chain of superseded claims that is followed.
MAX_HOPS = 32


def listed(memories: DataFrame, statuses=None, types=None, trusts=None, since=None, limit=None, order=True) -> DataFrame:
    """Claims that pass all given filters, newest first."""
    out = memories
    for col, wanted in (("status", statuses), ("type", types), ("trust", trusts)):
        if wanted:
            out = out.where(F.col(col).isin(*wanted))
    if since:
        out = out.where(F.col("updated_at") >= F.lit(since).cast("timestamp"))
    if order:
        out = out.orderBy(F.desc("updated_at"), "id")
    return out.limit(limit) if limit else out


def by_prefix(memories: DataFrame, prefix: str) -> DataFrame:
    return memories.where(F.col("id").cast("string").startswith(prefix))


#: Characters that a prefix must have to stand for an id.
SHORTEST_PREFIX = 6


def found(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, id and fault of every text that is looked up (column asked): an exact id, else the one id that begins with it.

    A fault is ``not found`` (also for prefixes of fewer than six characters) or ``ambiguous``. Texts are trimmed and lower-cased; %
    and _ stand for themselves. Ids and prefixes meet on their first six characters, so neither side is crossed with the other.
    """
    ids = memories.select("id", F.col("id").cast("string").alias("key"))
    want = asked.select("asked").distinct().withColumn("key", F.lower(F.trim("asked")))
    exact = want.join(ids, "key").select("asked", "id", F.lit(0).alias("place"))
    head = lambda c: F.substring(c, 1, SHORTEST_PREFIX)
    near = want.where(F.length("key") >= SHORTEST_PREFIX).select("asked", F.col("key").alias("prefix"), head("key").alias("head")).join(ids.withColumn("head", head("key")), "head").where(F.startswith("key", "prefix")).select("asked", "id", F.lit(1).alias("place"))
    hits = exact.unionByName(near).groupBy("asked", "place").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    best = hits.groupBy("asked").agg(F.min(F.struct("place", "n", "id")).alias("b"))
    fault = F.when(F.col("b").isNull(), "not found").when((F.col("b.place") == 1) & (F.col("b.n") > 1), "ambiguous")
    return want.select("asked").join(best, "asked", "left").select("asked", F.when(fault.isNull(), F.col("b.id")).alias("id"), fault.alias("fault"))


def checks(memories: DataFrame, links: DataFrame, wanted: dict[str, str], vectors: DataFrame, model: str | None, stored_model: str | None, indexed: int | None = None) -> DataFrame:
    """What a doctor looks at, a row a check: name, ok and detail.

    The schema (``wanted``: column and type), index parity (``indexed``: claims in the kept postings; null: no index), the model that
    made the vectors against the one in use (null: none), live claims without a vector, equal contents, links without a claim.
    """
    have = {f.name: f.dataType.simpleString() for f in memories.schema}
    wrong = sorted(c for c, t in wanted.items() if have.get(c) != t)
    live = memories.where(F.col("status").isin("active", "aging")).select("id")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    missing = one(live.join(vectors.select("id"), "id", "left_anti"), "missing")
    orphans = one(links.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_anti"), "orphans")
    rows = memories.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(X.content_hash(F.col("content")))).alias("equal"))
    c, text = F.col, lambda x: x.cast("string")
    same = F.lit(model is None or stored_model in (None, model))
    named = F.lit("no model is set" if model is None else f"made by {stored_model}, {model} is set" if stored_model not in (None, model) else model)
    whole = F.lit(model is None) | (same & ((c("missing") == 0) | (F.lit(stored_model is None) & (c("missing") == c("n")))))
    parity = F.lit(True) if indexed is None else c("n") == indexed
    detail = F.lit("no index") if indexed is None else F.concat(text(c("n")), F.lit(f" claims, {indexed} indexed"))
    row = lambda name, ok, said: F.struct(F.lit(name).alias("name"), ok.alias("ok"), said.alias("detail"))
    listed = F.array(
        row("schema", F.lit(not wrong), F.lit(", ".join(wrong) or "as it should be")), row("index", parity, detail), row("model", same, named), row("vectors", whole, F.concat(text(c("missing")), F.lit(" live claims without a vector"))),
        row("contents", c("equal") == 0, F.concat(text(c("equal")), F.lit(" equal contents"))), row("links", c("orphans") == 0, F.concat(text(c("orphans")), F.lit(" links without a claim"))),
    )
    return rows.join(F.broadcast(missing)).join(F.broadcast(orphans)).select(F.inline(listed))


def aliases_text(aliases: Column) -> Column:
    """A list of aliases as the JSON text that is stored; an empty list where there is none."""
    return F.to_json(F.coalesce(aliases, F.array().cast("array<string>")))


def aliases_list(text: Column) -> Column:
    """The aliases that a stored text holds; none where it is empty, null or no JSON list of strings."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def count_by(memories: DataFrame, col: str) -> DataFrame:
    if col not in ("status", "type", "trust", "scope"):
        raise ValueError(f"cannot count by {col}")
    return memories.groupBy(col).agg(F.count("*").alias("n"))


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key: a minimum that tasks fold before anything moves, so a hot key is no hot task."""
    others = [c for c in rows.columns if c not in (key, position)]
    best = rows.groupBy(key).agg(F.min_by(F.struct(position, *others), F.struct(position)).alias("r"))
    return best.select(key, "r.*").select(*rows.columns)


def lower_percentiles(rows: DataFrame, points: dict[str, float]) -> DataFrame:
    """n and, for each name, the value at place floor(p * (n - 1)) in order, of rows (label, value).

    Values are counted first, so that no task sorts all rows of a label, only its distinct values.
    """
    counts = rows.groupBy("label", "value").agg(F.count("*").alias("c"))
    totals = counts.groupBy("label").agg(F.sum("c").alias("n"))
    w = Window.partitionBy("label").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = counts.withColumn("upto", F.sum("c").over(w)).join(F.broadcast(totals), "label")
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(p * (F.col("n") - 1)), F.col("value")))
    return held.groupBy("label").agg(F.first("n").alias("n"), *[F.round(at(p).cast("double"), 6).alias(k) for k, p in points.items()])


def recent_ops(ops: DataFrame, op: str, n: int) -> DataFrame:
    return ops.where(F.col("op") == op).orderBy(F.desc("op_id")).limit(n)


def epoch(ops: DataFrame) -> DataFrame:
    """The last op that can change a vector."""
    return ops.where(~F.col("op").isin("inject", "export", "counter")).agg(F.coalesce(F.max("op_id"), F.lit(0)).alias("epoch"))


def last_op(ops: DataFrame, kinds: list[str]) -> DataFrame:
    return ops.where(F.col("op").isin(*kinds)).groupBy("memory_id").agg(F.max_by("op", "op_id").alias("last_op"), F.max("op_id").alias("op_id"))


def reconfirmed(ops: DataFrame, start: float) -> DataFrame:
    """Confidence after every reconfirmation: a tenth more each, at most 1."""
    r = ops.where("op = 'reconfirm'").groupBy("memory_id").agg(F.count("*").alias("n"), F.max("op_id").alias("last_op"))
    return r.select("memory_id", "n", F.round(F.least(F.lit(1.0), start + 0.1 * F.col("n")), 6).alias("confidence"), "last_op")


def entity_counts(entities: DataFrame, links: DataFrame, memories: DataFrame) -> DataFrame:
    """Live claims of each entity, 0 included; most first, then by name."""
    live = links.join(memories.where(F.col("status").isin("active", "aging")).select("id"), "id", "left_semi").groupBy("name").agg(F.count("*").alias("n"))
    return entities.join(live, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "name")


def resolve(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mention and the entity it names, by name first, else by alias, whatever the case."""
    keys = entities.select("name", F.explode(F.concat(F.array(F.struct(F.lower("name").alias("key"), F.lit(0).alias("by"))), F.transform("aliases", lambda a: F.struct(F.lower(a).alias("key"), F.lit(1).alias("by"))))).alias("k")).select("name", "k.key", "k.by")
    hits = mentions.join(keys, F.lower("mention") == F.col("key"))
    return hits.groupBy("mention").agg(F.min(F.struct("by", "name")).alias("best")).select("mention", F.col("best.name").alias("name"))


def newest_in_chain(memories: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """start, depth and newest: the last existing claim on each superseded claim's chain, by doubling the hops of every step.

    A step joins the links with themselves, so five of them follow 32 hops; a dangling link ends a chain before it.
    """
    slim = memories.select("id", "superseded_by")
    ids = slim.select(F.col("id").alias("to"))
    links = slim.where("superseded_by is not null").select(F.col("id").alias("start"), F.col("superseded_by").alias("to"), F.lit(1).alias("depth"))
    hops, out = 1, saved(links.join(ids, "to", "left_semi").select("start", "to", "depth"), "chain")
    while hops < max_hops:
        onward = out.select(F.col("start").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        # saved, or each step would hold all scans and joins of the ones before it twice
        out = saved(out.join(onward, "to", "left").select("start", F.coalesce("next", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "chain")
        hops *= 2
        if not out.where("moved").limit(1).count():
            break
        out = out.drop("moved")
    return out.select("start", F.least("depth", F.lit(max_hops)).alias("depth"), F.col("to").alias("newest"))


def older_chain(memories: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """start, hop and id: what each claim replaced, hop by hop, and what that replaced; of several only the newest by created_at goes on.

    A hop costs a join; it ends when no chain goes on.
    """
    back = memories.where("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.max_by("id", F.struct("created_at", "id")).alias("older"))
    back = saved(back, "older")
    frontier = saved(back.select(F.col("id").alias("start"), F.lit(1).alias("hop"), F.col("older").alias("id")), "older")
    out = frontier
    for hop in range(2, max_hops + 1):
        frontier = saved(frontier.join(back, "id").select("start", F.lit(hop).alias("hop"), F.col("older").alias("id")), "older")
        if not frontier.limit(1).count():
            break
        out = out.unionByName(frontier)
    return out


def restore_target(status: Column, trust: Column) -> Column:
    return F.when(status == "active", "active").when(status == "superseded", "refused").when(trust == 3, "quarantined").otherwise("active")


def origin(kind: Column) -> Column:
    """Tier and status of a claim by where it comes from; an unknown origin is an error."""
    return (
        F.when(kind == "user_stated", "T0:active")
        .when(kind == "dialogue", "T2:quarantined")
        .when(kind.isin("tool_output", "web", "") | kind.isNull(), "T3:quarantined")
        .otherwise(F.raise_error(F.concat(F.lit("unknown origin "), kind)))
    )


def rendered(turns: DataFrame) -> DataFrame:
    """One text a conversation: the turns of user and assistant in order."""
    kept = turns.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return kept.groupBy("conv_id").agg(F.array_join(lines, "\n\n").alias("rendered"))


def new_claims(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Incoming claims whose content is new, the first of each: an anti-join on the content hash."""
    return first_seen(incoming, "content_hash", "doc_id").join(held.select("content_hash").distinct(), "content_hash", "left_anti")


def review(memories: DataFrame, flagged: Column) -> DataFrame:
    """What waits for review: everything quarantined, and live claims with an open flag."""
    return memories.where((F.col("status") == "quarantined") | (F.col("status").isin("active", "aging") & flagged))


def approved(memories: DataFrame, which: Column) -> DataFrame:
    """Approval: tier 1, active, confidence 0.95."""
    return memories.withColumns({"trust": F.when(which, 1).otherwise(F.col("trust")), "confidence": F.when(which, 0.95).otherwise(F.col("confidence")), "status": F.when(which, "active").otherwise(F.col("status"))})


def ids_of(memories: DataFrame, statuses=None, types=None, trusts=None, since=None) -> DataFrame:
    """Ids alone of the claims that pass the filters; the scan reads no other column than those."""
    return listed(memories, statuses, types, trusts, since, order=False).select("id")


def with_entity(memories: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Claims linked with an entity, whatever the case of its name; none if there is no such entity."""
    ids = links.where(F.lower("name") == name.lower()).select(F.col("memory_id").alias("id")).distinct()
    return memories.join(ids, "id", "left_semi")


def browse(memories: DataFrame, status: str = "live", text: str | None = None, limit: int = 500) -> DataFrame:
    """Newest first: live (active and aging), all, or one status; of those that hold a text."""
    rows = memories
    if status == "live":
        rows = rows.where(F.col("status").isin("active", "aging"))
    elif status != "all":
        rows = rows.where(F.col("status") == status)
    if text:
        rows = rows.where(F.contains(F.lower("content"), F.lit(text.lower())))
    return rows.orderBy(F.desc("updated_at"), "id").limit(limit)


def placed(rows: DataFrame, key: str, slices: int = 64) -> DataFrame:
    """``rows`` with place: their number within the key, newest first, ties by memory_id.

    A key's rows are numbered in slices of time that are sorted apart, so that a key with a third of
    all rows does not go to one task whole; the slices before one are added from their counts.
    """
    span = rows.groupBy(key).agg(F.min("updated_at").alias("__lo"), F.max("updated_at").alias("__hi"))
    width = F.greatest((F.unix_micros("__hi") - F.unix_micros("__lo")) / slices, F.lit(1.0))
    cut = rows.join(span, key).withColumn("__s", F.floor((F.unix_micros("__hi") - F.unix_micros("updated_at")) / width)).drop("__lo", "__hi")
    before = Window.partitionBy(key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(key, "__s").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(key, "__s").orderBy(F.desc("updated_at"), "memory_id")
    return cut.withColumn("__r", F.row_number().over(within)).join(counts, [key, "__s"]).withColumn("place", (F.col("__r") + F.col("__before")).cast("int")).drop("__r", "__s", "__before")


def newest_of_hash(claims: DataFrame) -> DataFrame:
    """content_hash and id of the newest claim of each content, of any status."""
    return claims.select("id", "created_at", X.content_hash(F.col("content")).alias("content_hash")).groupBy("content_hash").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
