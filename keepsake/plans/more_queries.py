"""Further registered queries: batch recall, entities, tags, flags, review, screens, exports, writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import embed, entities
from keepsake.functions import ranking as R
from keepsake.functions import text as X
from keepsake.operators import batch_recall, belief, consolidate, digest, history, ledger, scan, store
from keepsake.operators.cells import Cells
from keepsake.operators.postings import Postings
from keepsake.plans.queries import EFF, FILLERS_SQL, _q, norm, query, toks
from keepsake.sources import adapters as A
from keepsake.sources import interchange, transcripts
from keepsake.sources.adapters import CLAIMS_SQL, ENTITIES_SQL, FLAGS_SQL, LINKS_SQL, MEMORIES_SQL, OPS_SQL, TAGS_SQL, now, table
from keepsake.sources.scratch import scratch

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

# --- recall for a batch of queries -------------------------------------------------------------------

TERMS_SQL = f"""
qa AS (SELECT item_id AS query_id, {toks('text')} AS w FROM benchmark),
qb AS (SELECT query_id, w, list_filter(w, lambda x: NOT list_contains({_list(batch_recall.STOPWORDS)}, x)) AS k FROM qa),
terms AS (SELECT query_id, t AS term, count(*) AS times FROM (SELECT query_id, unnest((CASE WHEN len(k) > 0 THEN k ELSE w END)[1:12]) AS t FROM qb) GROUP BY ALL)"""
BATCH_SQL = f"""{TERMS_SQL},
w AS MATERIALIZED (SELECT id, {toks('content')} AS w FROM memories), st AS MATERIALIZED (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM w),
tf AS MATERIALIZED (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) SEMI JOIN (SELECT DISTINCT term FROM terms) USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, tf.id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN terms USING (term) JOIN df USING (term), st GROUP BY ALL),
b1 AS (SELECT bm.*, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS r FROM bm JOIN memories m USING (id) WHERE m.status IN ('active', 'aging'))"""


def _recall_sql(allowed: str, columns: str) -> str:
    return f"""WITH {MEMORIES_SQL}, {EFF}, {BATCH_SQL},
b2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS lx FROM b1 WHERE r <= 100 AND {allowed}),
sc AS (SELECT query_id, s.*, bm25, lx, round(1.0::DOUBLE / (60 + lx) * m, 9) AS score FROM b2 JOIN s USING (id) WHERE lx <= 50),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, id) AS place FROM sc)
SELECT query_id, CAST(place AS INT) AS place, id, {columns} FROM pl WHERE place <= 8"""


@query(f"WITH {TERMS_SQL} SELECT query_id, term, times FROM terms")
def fts_terms(spark, sf):
    return batch_recall.query_terms(A.query_table(spark, sf))


_INDEXES: dict[str, Postings] = {}


def kept_postings(spark, sf) -> Postings:
    """The index of the claims of ``sf``: made by the first query that asks, kept for those that follow."""
    if sf not in _INDEXES:
        _INDEXES[sf] = Postings(spark, scratch(spark, "postings")).build(A.contents(spark, sf))
    return _INDEXES[sf]


_CELLS: dict[str, Cells] = {}


def kept_cells(spark, sf) -> Cells:
    """The vectors of ``sf`` in cells, kept likewise."""
    if sf not in _CELLS:
        _CELLS[sf] = Cells(spark, scratch(spark, "cells")).build(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return _CELLS[sf]


@query(f"WITH {MEMORIES_SQL}, t AS (SELECT id, unnest({toks('content')}) AS term FROM memories) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM t GROUP BY 1")
def postings_terms(spark, sf):
    """Claims and occurrences of every term, from the kept index."""
    return kept_postings(spark, sf).term_statistics()


@query(_recall_sql("TRUE", "score"))
def recall_batch(spark, sf):
    """All queries at once from the kept index; no text is read."""
    return batch_recall.recall(A.memories(spark, sf).drop("content"), A.query_table(spark, sf), now(), postings=kept_postings(spark, sf)).select("query_id", "place", "id", "score")


@query(_recall_sql("TRUE", "score"))
def recall_unindexed(spark, sf):
    """The same without an index, from the texts."""
    return batch_recall.recall(A.memories(spark, sf), A.query_table(spark, sf), now()).select("query_id", "place", "id", "score")


@query(_recall_sql("id IN (SELECT id FROM memories WHERE type IN ('fact', 'decision') AND updated_at >= TIMESTAMP '2023-01-01')", "score"))
def recall_filtered(spark, sf):
    m = A.memories(spark, sf)
    allowed = store.ids_of(m, types=["fact", "decision"], since="2023-01-01")
    return batch_recall.recall(m.drop("content"), A.query_table(spark, sf), now(), allowed=allowed, postings=kept_postings(spark, sf)).select("query_id", "place", "id", "score")


def _d(x: str, places: int) -> str:
    return f"printf('%.{places}f', floor(({x}) * 1e{places} + 0.5) / 1e{places})"


@query(_recall_sql("TRUE", f"""'lexical #' || lx || ' (bm25 ' || {_d('bm25', 2)} || '), rrf ' || {_d('1.0::DOUBLE / (60 + lx)', 4)} || ', ×imp ' || {_d('0.6 + 0.1 * importance', 2)} || ' ×trust ' ||
  {_d('CASE trust WHEN 0 THEN 1.0 WHEN 1 THEN 0.97 WHEN 2 THEN 0.9 WHEN 3 THEN 0.75 ELSE 0.5 END', 2)} || ' ×recency ' || {_d('rec', 2)} || ' ×conf ' || {_d("(0.5 + 0.5 * eff) * CASE status WHEN 'aging' THEN 0.6 ELSE 1.0 END", 2)} || CASE status WHEN 'aging' THEN ' — aging: excluded from auto-injection, still recallable' ELSE '' END AS why"""))
def why_line(spark, sf):
    hits = batch_recall.recall(A.memories(spark, sf).drop("content"), A.query_table(spark, sf), now(), postings=kept_postings(spark, sf))
    return hits.select("query_id", "place", "id", batch_recall.why().alias("why"))


@query()
def recall_hybrid(spark, sf):
    """Words and hash vectors of the claims themselves, fused."""
    m, q, e = A.memories(spark, sf), A.query_table(spark, sf), embed.HashEmbedder(256)
    vectors = m.where(F.col("status").isin("active", "aging")).select("id", e.column(F.col("content")).alias("v"))
    hits = batch_recall.recall(m, q, now(), vectors=vectors, query_vectors=q.select("query_id", e.column(F.col("query")).alias("v")), postings=kept_postings(spark, sf))
    return hits.select("query_id", "place", "id", "score", "lexical", "semantic")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS l1, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def normalize_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", embed.normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query(f"""WITH {MEMORIES_SQL}, {TERMS_SQL}, q AS (SELECT query_id, w FROM qa), m AS (SELECT id, status, list_distinct({toks('content')}) AS s FROM memories WHERE status = 'active'), mt AS (SELECT id, unnest(s) AS t FROM m), qt AS (SELECT query_id, len(w) AS n, unnest(w) AS t FROM q)
SELECT query_id, id, round(count(*) / any_value(n)::DOUBLE, 6) AS share FROM qt JOIN mt USING (t) GROUP BY 1, 2""")
def hint_overlap(spark, sf):
    """Hints against all active claims, joined on the words they share."""
    hint = A.query_table(spark, sf).select("query_id", X.tokens(F.col("query")).alias("w")).select("query_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    m = A.memories(spark, sf).where("status = 'active'").select("id", F.explode(X.token_set(F.col("content"))).alias("t"))
    return hint.join(m, "t").groupBy("query_id", "id").agg(F.round(F.count("*") / F.first("n"), 6).alias("share"))


@query(f"""WITH {MEMORIES_SQL}, f AS (SELECT list_distinct(flatten(list({toks('text')}))) AS s FROM benchmark)
SELECT id, len({toks('content')}) > 0 AND len(list_filter({toks('content')}, lambda x: list_contains(s, x))) / greatest(len({toks('content')}), 1)::DOUBLE >= 0.8 AS covered FROM memories, f""")
def covered_by(spark, sf):
    """Whether a claim's words stand in the instruction text already (here: all of ``benchmark``, one bounded file)."""
    file = table(spark, sf, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("t")).distinct()
    return A.memories(spark, sf).select("id", X.covered_by(F.col("content"), [r["t"] for r in file.collect()]).alias("covered"))


# --- scans and joins over the store's tables ----------------------------------------------------------


@query(f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE status = 'aging' AND updated_at >= TIMESTAMP '2023-06-01'")
def filtered_ids(spark, sf):
    return store.ids_of(A.memories(spark, sf), statuses=["aging"], since="2023-06-01")


@query(f"WITH {MEMORIES_SQL} SELECT vec_id AS id, len(embedding) AS dims FROM embeddings JOIN memories ON id = vec_id WHERE status = 'active' AND embedding IS NOT NULL")
def vector_scan(spark, sf):
    v = table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), "embedding")
    live = A.memories(spark, sf).where("status = 'active'").select("id")
    return v.join(live, "id", "left_semi").select("id", F.size("embedding").cast("long").alias("dims"))


@query(f"WITH {MEMORIES_SQL} SELECT id, status FROM memories WHERE status IN ('active', 'aging') AND content ILIKE '%que%' ORDER BY updated_at DESC, id LIMIT 500")
def browse_live(spark, sf):
    return store.browse(A.memories(spark, sf), "live", "que").select("id", "status")


@query(f"WITH {ENTITIES_SQL}, {LINKS_SQL} SELECT memory_id, string_agg(name || ':' || type, ',' ORDER BY name) AS entities FROM links JOIN entities USING (name) GROUP BY 1")
def entities_for_memory(spark, sf):
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "name", "type")))
    return A.entity_links(spark, sf).join(A.entities(spark, sf), "name").groupBy("memory_id").agg(F.array_join(listed, ",").alias("entities"))


@query(f"WITH {TAGS_SQL} SELECT memory_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY 1")
def tags_for_memory(spark, sf):
    return A.tag_links(spark, sf).groupBy("memory_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


@query(f"""WITH {MEMORIES_SQL}, {ENTITIES_SQL}, {LINKS_SQL} SELECT id, coalesce(names, '') AS names FROM memories LEFT JOIN (SELECT memory_id, string_agg(name, ',' ORDER BY name, type) AS names FROM links JOIN entities USING (name) GROUP BY 1) ON memory_id = id""")
def attach_entities(spark, sf):
    m = ledger.attached(A.memories(spark, sf), A.entity_links(spark, sf), A.entities(spark, sf))
    return m.select("id", F.array_join(F.transform("entities", lambda e: e["name"]), ",").alias("names"))


@query(f"WITH {MEMORIES_SQL}, {LINKS_SQL} SELECT id FROM memories WHERE id IN (SELECT memory_id FROM links WHERE lower(name) = 'src3') AND status IN ('active', 'aging')")
def filter_by_entity(spark, sf):
    m = A.memories(spark, sf).where(F.col("status").isin("active", "aging"))
    return store.with_entity(m, A.entity_links(spark, sf), "SRC3").select("id")


@query(f"""WITH {ENTITIES_SQL}, mentions AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN upper(source) WHEN doc_id % 3 = 1 THEN 'THE ' || source ELSE coalesce(lang, 'nobody') END AS mention FROM documents WHERE source IS NOT NULL),
k AS (SELECT name, lower(name) AS key, 0 AS b FROM entities UNION ALL SELECT name, lower(unnest(aliases)), 1 FROM entities)
SELECT mention, arg_min(name, struct_pack(b := b, n := name)) AS name FROM mentions JOIN k ON lower(mention) = key GROUP BY 1""")
def alias_resolve(spark, sf):
    d = table(spark, sf, "documents").where("source is not null")
    said = F.when(F.col("doc_id") % 3 == 0, F.upper("source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("THE "), F.col("source"))).otherwise(F.coalesce("lang", F.lit("nobody")))
    return store.resolve(d.select(said.alias("mention")).distinct(), A.entities(spark, sf))


@query(f"WITH {ENTITIES_SQL} SELECT name, array_to_string(list_sort(list_distinct(list_filter(aliases || ['x' || name || 'x'], lambda a: lower(a) <> lower(name)))), ',') AS aliases FROM entities")
def alias_clean(spark, sf):
    said = F.concat("aliases", F.transform("aliases", F.upper), F.array(F.concat(F.lit("  x"), F.col("name"), F.lit("x ")), F.upper("name"), F.lit(" ")))
    # of spellings that differ in case only the first stays
    return A.entities(spark, sf).select("name", F.array_join(X.clean_aliases(said, F.col("name")), ",").alias("aliases"))


@query(f"""WITH {MEMORIES_SQL}, {LINKS_SQL} SELECT name, id, CAST(row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, id) AS INT) AS place FROM links JOIN memories ON memory_id = id WHERE status <> 'tombstoned'""")
def entity_timeline(spark, sf):
    """The claims of each entity as ordered rows, so that no entity is gathered into one array."""
    m = A.memories(spark, sf).where("status <> 'tombstoned'").select(F.col("id").alias("memory_id"), "updated_at")
    return store.placed(A.entity_links(spark, sf).join(m, "memory_id"), "name").select("name", F.col("memory_id").alias("id"), "place")


@query(f"""WITH {CLAIMS_SQL}, x AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN NULL ELSE last_confirmed_at END AS last_confirmed_at, CASE WHEN id % 9 = 0 THEN NULL ELSE updated_at END AS updated_at) FROM claims),
a AS (SELECT *, CASE type WHEN 'event' THEN 90.0 WHEN 'note' THEN 180.0 WHEN 'fact' THEN 540.0 END AS hl, date_diff('second', coalesce(last_confirmed_at, updated_at, created_at), TIMESTAMP '2024-02-01') / 86400.0 AS ea, date_diff('second', coalesce(last_confirmed_at, updated_at), TIMESTAMP '2024-02-01') / 86400.0 AS ra FROM x)
SELECT id, round(CASE WHEN hl IS NULL OR ea <= 0 THEN confidence ELSE confidence * pow(2, -ea / hl) END, 6) AS eff, round(CASE WHEN hl IS NULL OR ra IS NULL OR ra <= 0 THEN 1.0 ELSE 0.3 + 0.7 * pow(2, -floor(ra / hl)) * (1 - 0.5 * (ra / hl - floor(ra / hl))) END, 6) AS recency FROM a""")
def confidence_anchors(spark, sf):
    """Decay of claims of which some were never confirmed and some never updated either."""
    m = A.claims(spark, sf).withColumn("last_confirmed_at", F.when(F.col("id") % 3 != 0, F.col("last_confirmed_at"))).withColumn("updated_at", F.when(F.col("id") % 9 != 0, F.col("updated_at")))
    anchor, recent = R.anchors(m.columns)
    return m.select("id", F.round(R.effective_confidence(F.col("confidence"), F.col("type"), anchor, now()), 6).alias("eff"), F.round(R.recency(F.col("type"), recent, now()), 6).alias("recency"))


@query(f"""WITH {MEMORIES_SQL}, k AS (SELECT id, substr(sha256(id::VARCHAR), 1, 10) AS key FROM memories), q AS (SELECT DISTINCT CASE WHEN id % 4 = 0 THEN upper(key) || ' ' WHEN id % 4 = 1 THEN substr(key, 1, 6) WHEN id % 4 = 2 THEN substr(key, 1, 5) ELSE 'x' || key END AS asked FROM k),
h AS (SELECT asked, key = lower(trim(asked)) AS exact, key AS id FROM q JOIN k ON key = lower(trim(asked)) OR (len(trim(asked)) >= 6 AND starts_with(key, lower(trim(asked))))),
b AS (SELECT asked, CASE WHEN bool_or(exact) THEN max(CASE WHEN exact THEN id END) WHEN count(*) = 1 THEN max(id) END AS id, CASE WHEN NOT bool_or(exact) AND count(*) > 1 THEN 'ambiguous' END AS fault FROM h GROUP BY 1)
SELECT asked, b.id, CASE WHEN b.asked IS NULL THEN 'not found' ELSE fault END AS fault FROM q LEFT JOIN b USING (asked)""")
def claim_lookup(spark, sf):
    """Whole ids, prefixes of six characters, shorter ones and unknown ones, each looked up (by ids of letters and digits)."""
    k = A.memories(spark, sf).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 10).alias("id"))
    said = table(spark, sf, "documents").select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 10).alias("key"))
    r = F.col("doc_id") % 4
    asked = said.select(F.when(r == 0, F.concat(F.upper("key"), F.lit(" "))).when(r == 1, F.substring("key", 1, 6)).when(r == 2, F.substring("key", 1, 5)).otherwise(F.concat(F.lit("x"), "key")).alias("asked"))
    return store.found(k, asked)


@query(f"WITH {ENTITIES_SQL}, t AS (SELECT name, to_json(aliases)::VARCHAR AS aliases_json FROM entities) SELECT name, aliases_json, unnest(from_json(aliases_json, '[\"VARCHAR\"]')) AS alias FROM t")
def aliases_json(spark, sf):
    """Aliases as the stored JSON text and read back."""
    t = A.entities(spark, sf).select("name", store.aliases_text(F.col("aliases")).alias("aliases_json"))
    return t.select("name", "aliases_json", F.explode(store.aliases_list(F.col("aliases_json"))).alias("alias"))


@query(f"""WITH {CLAIMS_SQL}, {LINKS_SQL}, c AS (SELECT (SELECT count(*) FROM claims) AS n, (SELECT count(*) FROM claims WHERE status IN ('active', 'aging') AND id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)) AS missing,
  (SELECT count(*) - count(DISTINCT sha256({norm('content')})) FROM claims) AS equal, (SELECT count(*) FROM links WHERE memory_id NOT IN (SELECT id FROM claims)) AS orphans)
SELECT 'schema' AS name, FALSE AS ok, 'importance, source' AS detail UNION ALL SELECT 'index', TRUE, n || ' claims, ' || n || ' indexed' FROM c UNION ALL SELECT 'model', FALSE, 'made by hash-64, hash-256 is set'
UNION ALL SELECT 'vectors', FALSE, missing || ' live claims without a vector' FROM c UNION ALL SELECT 'contents', equal = 0, equal || ' equal contents' FROM c UNION ALL SELECT 'links', orphans = 0, orphans || ' links without a claim' FROM c""")
def doctor_checks(spark, sf):
    """All checks, of a store with two columns that are not as wanted and vectors of another model."""
    m = A.claims(spark, sf)
    vectors = table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"))
    wanted = {"id": "bigint", "content": "string", "status": "string", "importance": "bigint", "source": "string"}
    return store.checks(m, A.entity_links(spark, sf), wanted, vectors, "hash-256", "hash-64", kept_postings(spark, sf).totals()[0])


@query(_recall_sql("TRUE", "type, 'T' || trust AS trust, status, CAST(importance AS INT) AS importance, sha256(content) AS content, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, (SELECT string_agg(l.name, ',' ORDER BY l.name) FROM links l WHERE l.memory_id = pl.id) AS entities").replace("WITH ", f"WITH {LINKS_SQL}, ", 1))
def recall_records(spark, sf):
    """The stable record of every hit."""
    m = A.memories(spark, sf)
    hits = batch_recall.recall(m.drop("content"), A.query_table(spark, sf), now(), postings=kept_postings(spark, sf))
    r = batch_recall.records(hits, m, entities=A.entity_links(spark, sf)).select("query_id", "place", "record.*")
    return r.select("query_id", "place", F.col("id").cast("long").alias("id"), "type", "trust", "status", "importance", F.sha2(F.col("content").cast("binary"), 256).alias("content"), "updated_at", F.array_join("entities", ",").alias("entities"))


@query(f"WITH {FLAGS_SQL} SELECT flag_id, memory_id, kind FROM flags WHERE resolved_at IS NULL")
def open_flags(spark, sf):
    return ledger.open_flags(A.flags(spark, sf)).select("flag_id", "memory_id", "kind")


PENDING_SQL = f"""{MEMORIES_SQL}, {FLAGS_SQL},
o AS (SELECT f.*, m.status FROM flags f JOIN memories m ON m.id = f.memory_id WHERE resolved_at IS NULL),
r AS (SELECT id, -1 AS o, 'quarantined (T' || trust || ')' AS reason FROM memories WHERE status = 'quarantined' UNION ALL SELECT memory_id, flag_id, kind || ': ' || detail FROM o),
pend AS (SELECT id FROM memories WHERE status = 'quarantined' UNION SELECT memory_id FROM o WHERE status IN ('active', 'aging') AND kind <> 'needs-review')"""


@query(f"WITH {PENDING_SQL} SELECT id, string_agg(reason, '; ' ORDER BY o, reason) AS reasons FROM r WHERE id IN (SELECT id FROM pend) GROUP BY 1")
def review_inbox(spark, sf):
    return ledger.pending(A.memories(spark, sf), A.flags(spark, sf))


@query(f"""WITH {PENDING_SQL}, {ENTITIES_SQL}, {OPS_SQL}
SELECT 'status' AS section, status AS name, count(*) AS n FROM memories GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM memories GROUP BY 2 UNION ALL SELECT 'trust', CAST(trust AS VARCHAR), count(*) FROM memories GROUP BY 2
UNION ALL SELECT 'entities', '', count(*) FROM entities UNION ALL SELECT 'pending', '', count(*) FROM pend UNION ALL (SELECT 'injection', CAST(op_id AS VARCHAR), memory_id FROM ops WHERE op = 'inject' ORDER BY op_id DESC LIMIT 5)""")
def status_overview(spark, sf):
    m = A.memories(spark, sf)
    counts = [m.groupBy(F.lit(c).alias("section"), F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n")) for c in ("status", "type", "trust")]
    totals = [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("section"), F.lit("").alias("name"), "n") for s, df in (("entities", A.entities(spark, sf)), ("pending", ledger.pending(m, A.flags(spark, sf))))]
    last = store.recent_ops(A.ops(spark, sf), "inject", 5).select(F.lit("injection").alias("section"), F.col("op_id").cast("string").alias("name"), F.col("memory_id").alias("n"))
    out = counts[0]
    for df in [*counts[1:], *totals, last]:
        out = out.unionByName(df)
    return out


@query(f"""WITH {CLAIMS_SQL}, {LINKS_SQL} SELECT (SELECT count(*) FROM memories) AS n_rows, (SELECT count(*) FROM memories WHERE status IN ('active', 'aging') AND id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)) AS missing_vectors,
(SELECT count(*) FROM links WHERE memory_id NOT IN (SELECT id FROM memories WHERE id % 7 > 0)) AS orphan_links""")
def doctor_links(spark, sf):
    """Live claims without a vector, and links whose claim is missing (here: every seventh claim is)."""
    m = A.memories(spark, sf)
    missing = m.where(F.col("status").isin("active", "aging")).select("id").join(table(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id")), "id", "left_anti")
    orphans = A.entity_links(spark, sf).join(m.where("id % 7 > 0").select(F.col("id").alias("memory_id")), "memory_id", "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(m, "n_rows").join(F.broadcast(one(missing, "missing_vectors"))).join(F.broadcast(one(orphans, "orphan_links")))


@query(f"WITH {OPS_SQL} SELECT op_id, json_extract_string(payload, '$.' || json_keys(payload)[1]) AS first_value, CAST(len(json_keys(payload)) AS INT) AS n_keys FROM ops WHERE payload IS NOT NULL")
def journal_payload(spark, sf):
    o = A.ops(spark, sf).where("payload is not null")
    keys = F.json_object_keys("payload")
    return o.select("op_id", F.get(F.map_values(F.from_json("payload", "map<string,string>")), F.lit(0)).alias("first_value"), F.size(keys).alias("n_keys"))


@query(f"""WITH RECURSIVE {CLAIMS_SQL}, back AS (SELECT superseded_by AS id, arg_max(id, struct_pack(c := created_at, i := id)) AS older FROM claims WHERE superseded_by IS NOT NULL GROUP BY 1),
c(start, hop, id) AS (SELECT id, 1, older FROM back UNION ALL SELECT c.start, c.hop + 1, b.older FROM c JOIN back b ON b.id = c.id WHERE c.hop < 32) SELECT start, hop, id FROM c""")
def chain_older(spark, sf):
    return store.older_chain(A.claims(spark, sf))


@query(f"WITH {CLAIMS_SQL} SELECT sha256({norm('content')}) AS content_hash, arg_max(id, struct_pack(c := created_at, i := id)) AS id FROM claims GROUP BY 1")
def hash_lookup_created(spark, sf):
    return store.newest_of_hash(A.claims(spark, sf))


# --- folds ------------------------------------------------------------------------------------------------


@query(f"""WITH {MEMORIES_SQL}, {OPS_SQL}, r AS (SELECT memory_id, count(*) AS times, CAST(max(1 + CAST(floor(abs(value) + 0.5) AS BIGINT) % 5) AS INT) AS most FROM ops WHERE op = 'reconfirm' GROUP BY 1)
SELECT id, round(CASE WHEN times IS NULL THEN confidence ELSE least(1.0, confidence + 0.1 * times) END, 6) AS confidence, CASE WHEN times IS NULL THEN importance ELSE greatest(importance, most) END AS importance, CASE WHEN times IS NOT NULL AND status = 'aging' THEN 'active' ELSE status END AS status
FROM memories LEFT JOIN r ON memory_id = id""")
def reconfirm_claims(spark, sf):
    r = A.ops(spark, sf).where("op = 'reconfirm'").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("times"), F.max(1 + F.floor(F.abs("value") + 0.5) % 5).cast("int").alias("importance"))
    out, _ = ledger.reconfirm(A.memories(spark, sf), r, now())
    return out.select("id", F.round("confidence", 6).alias("confidence"), "importance", "status")


@query(f"""WITH {MEMORIES_SQL}, {OPS_SQL}, x AS (SELECT memory_id AS id, arg_max(op, op_id) AS op FROM ops WHERE op IN ('approve', 'reject') GROUP BY 1)
SELECT m.id, CASE WHEN op = 'reject' THEN 'tombstoned' WHEN op = 'approve' AND status = 'quarantined' THEN 'active' ELSE status END AS status, CAST(CASE WHEN op = 'approve' THEN 1 ELSE trust END AS INT) AS trust, CASE WHEN op = 'approve' THEN 0.95::DOUBLE ELSE confidence END AS confidence FROM memories m LEFT JOIN x USING (id)""")
def review_fold(spark, sf):
    """The last decision of the journal on each claim, applied."""
    last = store.last_op(A.ops(spark, sf), ["approve", "reject"]).select(F.col("memory_id").alias("id"), "last_op")
    flags = A.flags(spark, sf)
    m, flags, _ = ledger.approve(A.memories(spark, sf), flags, last.where("last_op = 'approve'").select("id"), now())
    m, _, _ = ledger.reject(m, flags, last.where("last_op = 'reject'").select("id"), now())
    return m.select("id", "status", "trust", "confidence")


@query(f"""WITH {MEMORIES_SQL}, {LINKS_SQL} SELECT id AS memory_id, 'tombstone' AS op, '{{"prev":"' || status || '","next":"tombstoned"}}' AS payload FROM memories WHERE id IN (SELECT memory_id FROM links WHERE name = 'src7') AND status <> 'tombstoned'""")
def forget_entity(spark, sf):
    """The journal of forgetting all claims of an entity."""
    m = A.memories(spark, sf)
    _, ops = ledger.forget(m, store.with_entity(m, A.entity_links(spark, sf), "src7").select("id"), now())
    return ops.select("memory_id", "op", "payload")


@query(f"""WITH {MEMORIES_SQL}, r AS (SELECT id, superseded_by, status FROM memories WHERE status = 'tombstoned' OR status = 'quarantined' OR status = 'aging')
SELECT id AS memory_id, '{{"prev":"' || r.status || '","next":"' || CASE WHEN trust = 3 THEN 'quarantined' ELSE 'active' END || '"}}' AS payload FROM r JOIN memories USING (id)""")
def restore_fold(spark, sf):
    m = A.memories(spark, sf)
    _, ops = ledger.restore(m, m.select("id"), now())
    return ops.select("memory_id", "payload")


def _changed_twice(spark, sf):
    """The claims after the journal's clicks reconfirmed some (version 1) and an entity was forgotten (version 2), and the journal of both."""
    m = A.memories(spark, sf)
    r = A.ops(spark, sf).where("op = 'reconfirm'").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("times"), F.max(1 + F.floor(F.abs("value") + 0.5) % 5).cast("int").alias("importance"))
    m1, o1 = ledger.reconfirm(m, r, now())
    m2, o2 = ledger.forget(m1, store.with_entity(m1, A.entity_links(spark, sf), "src7").select("id"), now())
    return m2, o1.withColumn("version", F.lit(1)).unionByName(o2.withColumn("version", F.lit(2)))


_FOLDED = f"""{MEMORIES_SQL}, {OPS_SQL}, {LINKS_SQL}, r AS (SELECT memory_id, count(*) AS times, CAST(max(1 + CAST(floor(abs(value) + 0.5) AS BIGINT) % 5) AS INT) AS most FROM ops WHERE op = 'reconfirm' GROUP BY 1),
s1 AS (SELECT id, round(CASE WHEN times IS NULL THEN confidence ELSE least(1.0, confidence + 0.1 * times) END, 6) AS confidence, CASE WHEN times IS NULL THEN importance ELSE greatest(importance, most) END AS importance,
  CASE WHEN times IS NOT NULL AND status = 'aging' THEN 'active' ELSE status END AS status, CASE WHEN times IS NULL THEN updated_at ELSE TIMESTAMP '2024-02-01' END AS updated_at FROM memories LEFT JOIN r ON memory_id = id)"""


@query(f"""WITH {_FOLDED} SELECT 0 AS version, id, status, round(confidence, 6) AS confidence, importance, updated_at FROM memories UNION ALL SELECT 1, id, status, confidence, importance, updated_at FROM s1""")
def state_as_of(spark, sf):
    """Every claim as it was before two changes and between them, from the rows after both and the journal."""
    m, ops = _changed_twice(spark, sf)
    points = m.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("version"))
    return history.as_of(m, ops, points).select("version", "id", "status", F.round("confidence", 6).alias("confidence"), "importance", "updated_at")


@query(f"""WITH {_FOLDED}, h AS (SELECT id, 'reconfirm' AS op, 1 AS version FROM memories WHERE id IN (SELECT memory_id FROM r) UNION ALL SELECT s1.id, 'tombstone', 2 FROM s1 WHERE id IN (SELECT memory_id FROM links WHERE lower(name) = 'src7') AND status IN ('active', 'aging', 'quarantined', 'superseded'))
SELECT id, op, CAST(row_number() OVER (PARTITION BY id ORDER BY version) AS INT) AS place FROM h""")
def ops_for_claims(spark, sf):
    """The journal of every claim in its order."""
    m, ops = _changed_twice(spark, sf)
    return history.ops_for(ops, m.select("id")).select(F.col("memory_id").alias("id"), "op", "place")


# --- texts ----------------------------------------------------------------------------------------------

_FLAT = r"trim(regexp_replace(content, '\s+', ' ', 'g'))"
_HEAD = f"CASE WHEN len(regexp_extract({_FLAT}, '^[^.;]*')) < len({_FLAT}) AND strlen(regexp_extract({_FLAT}, '^[^.;]*')) > 12 THEN regexp_extract({_FLAT}, '^[^.;]*') ELSE {_FLAT} END"


@query(f"""WITH {MEMORIES_SQL}, h AS (SELECT id, trim({_HEAD}) AS h FROM memories), p AS (SELECT id, h, list_max(list_filter(range(0, least(72, len(h)) + 1), lambda k: strlen(h[1:k]) <= 71)) AS k FROM h)
SELECT id, CASE WHEN strlen(h) <= 72 THEN h ELSE h[1:k] || '…' END AS title FROM p""")
def title_line(spark, sf):
    return A.memories(spark, sf).select("id", X.title_line(F.col("content")).alias("title"))


@query(rf"SELECT conv_id, turn, 'Preference (user-stated): ' || regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\.$', ''), '^\s+|\s+$', '', 'g') || '.' AS content FROM conversations WHERE role = 'user' AND text IS NOT NULL")
def imperative_normalized(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user' and text is not null")
    return c.select("conv_id", "turn", X.normalised_imperative(F.col("text")).alias("content"))


_FOUND = " UNION ALL ".join(f"SELECT doc_id, {i} AS rule, generate_subscripts(m, 1) AS place, {before} || unnest(m) AS raw, '{kind}' AS type FROM (SELECT doc_id, regexp_extract_all(text, '{_q(p)}', {g}) AS m FROM documents)" for i, (p, g, kind) in enumerate(entities.RULES) for before in ["'@'" if p == entities.HANDLE else "''"])
_OPEN = r"[.!?\n:\-][ \t]*$"
NAMES_SQL = rf"""f AS (SELECT doc_id, rule, place, trim(trim(raw, '.,;:!?'), ' ' || chr(9) || chr(10) || chr(13)) AS name, type FROM ({_FOUND})),
p AS (SELECT doc_id, generate_subscripts(m, 1) AS place, unnest(m) AS name, unnest(g[1:len(m)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, '{_q(entities.PROPER)}') AS m, string_split_regex(text, '{_q(entities.PROPER)}') AS g FROM documents)),
r AS (SELECT doc_id, {len(entities.RULES)} AS rule, place, name, CASE WHEN regexp_matches(name, '{_q(entities.TITLES)}') OR (n = 2 AND NOT regexp_matches(name, '[0-9]')) THEN 'person' ELSE 'other' END AS type FROM (SELECT *, len(string_split_regex(name, '\s')) AS n FROM p)
  WHERE CASE WHEN n > 1 THEN NOT list_contains({_list(entities.STOPWORDS)}, lower(string_split_regex(name, '\s')[1])) ELSE NOT (regexp_matches(gap, '{_OPEN}') OR (place = 1 AND regexp_matches(gap, '^[ \t]*$'))) END),
names AS (SELECT doc_id, lower(name) AS low, arg_min(struct_pack(name := name, type := type, rule := rule), struct_pack(r := rule, p := place)) AS x FROM (SELECT * FROM f UNION ALL SELECT * FROM r) WHERE name <> '' AND NOT list_contains({_list(entities.STOPWORDS)}, lower(name)) GROUP BY 1, 2)"""


@query(f"WITH {NAMES_SQL} SELECT doc_id, x.name AS name, x.type AS type FROM names")
def extract_entities(spark, sf):
    """All names of all texts."""
    return entities.names(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "name", "type")


@query(f"WITH {NAMES_SQL} SELECT x.type AS type, x.rule AS rule, count(*) AS n, count(DISTINCT low) AS n_names FROM names GROUP BY 1, 2")
def entities_by_rule(spark, sf):
    found = entities.names(table(spark, sf, "documents"), "doc_id", "text")
    return found.groupBy("type", "rule").agg(F.count("*").alias("n"), F.count_distinct(F.lower("name")).alias("n_names"))


@query(r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9/+_-]{20,}')) AS token FROM documents), c AS (SELECT token, ch, count(*) / any_value(len(token))::DOUBLE AS p FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM t) WHERE ch <> '' GROUP BY token, ch)
SELECT token, round(-sum(p * log2(p)), 6) AS entropy FROM c GROUP BY 1""")
def entropy_tokens(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9/+_-]{20,}"), F.lit(0))).alias("token")).distinct()
    return t.select("token", F.round(X.entropy(F.col("token")), 6).alias("entropy"))


@query(f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:\\d[ \\-]?){{13,19}}\\b')) AS m FROM documents), d AS (SELECT doc_id, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM c),
x AS (SELECT doc_id, list_sum(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(g)[i] AS INT) ELSE 2 * CAST(reverse(g)[i] AS INT) - CASE WHEN CAST(reverse(g)[i] AS INT) > 4 THEN 9 ELSE 0 END END)) AS total FROM d WHERE len(g) BETWEEN 13 AND 19)
SELECT doc_id, count(*) AS n FROM x WHERE total % 10 = 0 GROUP BY 1""")
def scan_card(spark, sf):
    pattern = dict((k, p) for _, k, p in scan.CATALOGUE)["credit-card"]
    c = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(X.as_re2(pattern)), F.lit(0))).alias("m"))
    return c.where(scan.VERIFY["credit-card"](F.col("m"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def scan_report(spark, sf):
    return scan.report(table(spark, sf, "documents").select(F.col("text").alias("content")))


@query()
def redact_all(spark, sf):
    """Digest of every text with all findings masked."""
    d = scan.redacted_claims(table(spark, sf, "documents"), "text", everything=True)
    return d.select("doc_id", F.size("findings").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("redacted"))


# --- verdicts, consolidation -------------------------------------------------------------------------------


def _names(spark, sf):
    """The names of each claim's entities and the aliases of these."""
    links = A.entity_links(spark, sf).join(A.entities(spark, sf), "name")
    return links.groupBy(F.col("memory_id").alias("id")).agg(F.collect_set("name").alias("names"), F.flatten(F.collect_set("aliases")).alias("aliases"))


def _verdicts_sql(live: str, pair: str) -> str:
    """v: i, j, sim and verdict of the claims of ``live`` (SQL over claims) that meet ``pair``, from the overlap of all token sets."""
    verb = r"list_transform(regexp_extract_all(lower({0}), '\b" + _q(belief.RELATION) + r"\b'), lambda x: regexp_replace(regexp_replace(x, '^(\S+?)es(\s|$)', '\1\2'), '^(\S+?)s(\s|$)', '\1\2'))"
    denies = r"regexp_matches({0}, '(?i)\b" + _q(belief.NEGATION) + r"\b')"
    value = r"(regexp_matches(x, '^[a-z0-9][a-z0-9.\-_/+]*$') OR regexp_matches(x, '[0-9]'))"
    return f"""c AS MATERIALIZED (SELECT id, content, scope, id % 3 = 0 AS third, updated_at, list_distinct({toks('content')}) AS s, sha256({norm('content')}) AS h FROM claims WHERE {live}),
k AS MATERIALIZED (SELECT *, list_filter(s, lambda x: NOT list_contains({FILLERS_SQL}, x)) AS f FROM c), lang AS (SELECT doc_id AS id, lang FROM documents WHERE doc_id % 3 = 0),
tk AS MATERIALIZED (SELECT id, unnest(s) AS t FROM k),
o AS MATERIALIZED (SELECT a.id AS i, b.id AS j, count(*) AS n FROM tk a JOIN tk b USING (t) WHERE {pair.format("a.id", "b.id")} GROUP BY 1, 2),
near AS MATERIALIZED (SELECT i, j, round(n / (len(x.s) + len(y.s) - n)::DOUBLE, 9) AS sim FROM o JOIN k x ON x.id = i JOIN k y ON y.id = j WHERE n / (len(x.s) + len(y.s) - n)::DOUBLE >= 0.379),
w AS MATERIALIZED (SELECT i, j, sim, x.h = y.h AS same, coalesce(x.scope = y.scope, FALSE) OR coalesce(lx.lang = ly.lang, FALSE) AS named,
  least(len(x.f), len(y.f)) > 0 AND len(list_intersect(x.f, y.f)) / greatest(least(len(x.f), len(y.f)), 1)::DOUBLE >= 0.5 AS subject,
  {denies.format('x.content')} <> {denies.format('y.content')} OR (list_has_any({verb.format('x.content')}, {verb.format('y.content')})
    AND len(list_filter(x.f, lambda x: NOT list_contains(y.s, x) AND {value})) > 0 AND len(list_filter(y.f, lambda x: NOT list_contains(k2.s, x) AND {value})) > 0) AS clash
  FROM near JOIN k x ON x.id = i JOIN k y ON y.id = j JOIN k k2 ON k2.id = i LEFT JOIN lang lx ON lx.id = i LEFT JOIN lang ly ON ly.id = j),
v AS (SELECT i, j, sim, CASE WHEN same OR sim >= 0.93 THEN 'duplicate' WHEN NOT ((subject OR named) AND sim >= CASE WHEN subject THEN 0.38 ELSE 0.55 END) THEN 'none' WHEN clash THEN 'supersedes' WHEN sim >= 0.82 THEN 'ambiguous' ELSE 'none' END AS verdict FROM w)"""


@query(f"""WITH {CLAIMS_SQL}, {_verdicts_sql("id % 2 = 1 OR status IN ('active', 'aging')", "{0} % 2 = 1 AND {1} % 2 = 0")},
e AS (SELECT a.id AS i, b.id AS j, 1.0::DOUBLE AS sim, 'duplicate' AS verdict, 0 AS place FROM c a JOIN c b USING (h) WHERE a.id % 2 = 1 AND b.id % 2 = 0 UNION ALL SELECT i, j, sim, verdict, CASE WHEN verdict = 'ambiguous' THEN 2 ELSE 1 END FROM v WHERE verdict <> 'none')
SELECT i AS new_id, arg_min(j, k) AS old_id, arg_min(verdict, k) AS verdict, arg_min(sim, k) AS sim FROM (SELECT *, struct_pack(p := place, s := -sim, j := j, v := verdict) AS k FROM e) GROUP BY 1""")
def adjudicate_candidates(spark, sf):
    """Every odd claim as a new one, judged against the live even ones."""
    m = A.claims(spark, sf)
    return belief.adjudicated(m.where("id % 2 = 1"), m.where((F.col("id") % 2 == 0) & F.col("status").isin("active", "aging")), _names(spark, sf))


@query(f"""WITH {CLAIMS_SQL}, {_verdicts_sql("status IN ('active', 'aging')", "{0} < {1}")},
d AS (SELECT CASE WHEN x.updated_at > y.updated_at OR (x.updated_at = y.updated_at AND i < j) THEN i ELSE j END AS newer, CASE WHEN x.updated_at > y.updated_at OR (x.updated_at = y.updated_at AND i < j) THEN j ELSE i END AS older, verdict FROM v JOIN c x ON x.id = i JOIN c y ON y.id = j WHERE verdict IN ('duplicate', 'supersedes')),
z AS (SELECT h, arg_max(id, struct_pack(u := updated_at, i := -id)) AS newer FROM c WHERE len(s) = 0 GROUP BY 1)
SELECT newer, older, verdict FROM d UNION ALL SELECT newer, id, 'duplicate' FROM c JOIN z USING (h) WHERE len(s) = 0 AND id <> newer""")
def consolidate_edges(spark, sf):
    return consolidate.edges(A.claims(spark, sf), _names(spark, sf))


@query()
def consolidate_counts(spark, sf):
    """What a whole pass merges, resolves, dates and demotes."""
    return consolidate.report(consolidate.consolidated(A.claims(spark, sf), _names(spark, sf), now())[1])


@query(f"""WITH {MEMORIES_SQL}, e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 6) AS cosine FROM e q JOIN e c ON len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS r FROM s WHERE cosine > 0) WHERE r <= 10""")
def vector_cells(spark, sf):
    """The ten nearest vectors of a stated set of queries, from the cells; those that cannot hold any are not read."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = e.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return kept_cells(spark, sf).nearest(queries, 10).select("query_id", "id", F.round("cosine", 6).alias("cosine"))


@query()
def consolidate_pass(spark, sf):
    """The actions of a whole pass."""
    return consolidate.consolidated(A.claims(spark, sf), _names(spark, sf), now())[1]


# --- transcripts, digest, writes, interchange ------------------------------------------------------------------


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN '[untrusted-output]' || text || '[/untrusted-output]' ELSE text END AS text FROM conversations WHERE text IS NOT NULL""")
def transcript_marks(spark, sf):
    """Turns with what stands for tool output marked."""
    c = table(spark, sf, "conversations").where("text is not null")
    return c.select("conv_id", "turn", transcripts.plain(F.col("text"), F.col("role") == "system")["text"].alias("text"))


def _screened(spark, sf, review_first=False):
    """Turns as candidates; the texts of system turns and the benchmark passages are untrusted spans."""
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("candidate_id"), "role", F.col("text").alias("content"), F.lit("fact").alias("type"), (F.col("turn") % 6).cast("int").alias("importance"), F.lit(False).alias("tainted"))
    spans = c.where("role = 'system'").select(transcripts.span_of(F.col("content")).alias("span")).unionByName(table(spark, sf, "benchmark").select(F.col("text").alias("span")))
    own = c.where("role <> 'system'")
    return digest.screened(own, digest.lifted(own, spans), floor=1, review_first=review_first)


@query()
def digest_screen(spark, sf):
    return _screened(spark, sf).select("candidate_id", "disposition", "reason", "trust")


@query()
def digest_summary(spark, sf):
    return digest.summary(_screened(spark, sf, review_first=True))


@query()
def ingest_dispositions(spark, sf):
    """Every third document as a write against the claims that the others are."""
    m = A.claims(spark, sf)
    batch = m.where("id % 3 = 0").select("id", F.col("id").alias("place"), "content", "type", "importance", "trust", F.lit(False).alias("quarantine"))
    return ledger.dispositions(batch, m.where("id % 3 > 0"), _names(spark, sf)).select("id", "action", "existing", "status", "trust")


@query()
def export_lines(spark, sf):
    """The JSON line of every live claim, as a digest."""
    m = A.claims(spark, sf).where(F.col("status").isin("active", "aging"))
    out = interchange.exported(m, tags=A.tag_links(spark, sf).groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_list("tag")).alias("tags")))
    return out.select("id", F.sha2(F.col("line").cast("binary"), 256).alias("line"))


@query()
def export_markdown(spark, sf):
    m = A.claims(spark, sf).where(F.col("status").isin("active", "aging"))
    return interchange.markdown(m).select("place", "id", F.sha2(F.col("line").cast("binary"), 256).alias("line"))


@query()
def export_decisions(spark, sf):
    m = A.claims(spark, sf)
    return interchange.decision_entries(m, store.older_chain(m)).select("id", "hop", F.sha2(F.col("line").cast("binary"), 256).alias("line"))


@query()
def import_validate(spark, sf):
    """All claims exported and read back against a store that holds every fourth; every tenth line is damaged."""
    m = A.claims(spark, sf)
    line = F.when(F.col("id") % 10 == 7, F.replace(F.col("line"), F.lit('"status":"'), F.lit('"status":"un'))).otherwise(F.col("line"))
    lines = interchange.exported(m.withColumn("scope", F.lit("project"))).select(F.col("id").alias("line_no"), line.alias("text"))
    held = m.where("id % 4 = 0").select(F.col("id").cast("string").alias("id"), X.content_hash(F.col("content")).alias("content_hash"))
    out = interchange.validated(interchange.read_lines(lines), held)
    return out.select("line_no", "error", "twin")
