"""Registered queries over the provided tables, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions import ranking as R
from keepsake.functions import text as X
from keepsake.operators import belief, consolidate, recall, scan, store
from keepsake.schema import RECALL_LIMIT
from keepsake.sources.adapters import MEMORIES_SQL, OPS_SQL, memories, now, ops, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: SQL of the functions of ``keepsake.functions.text``.
NORM = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = "list_filter(string_split(" + NORM + ", ' '), lambda x: x <> '')"
NOW_SQL = "TIMESTAMP '2024-02-01'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def norm(col: str) -> str:
    return NORM.format(col)


def toks(col: str) -> str:
    return TOKENS.format(col)


# --- text -----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalize_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalised(F.col("text")).alias("norm"))


@query(f"SELECT sha256({norm('text')}) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"""
WITH t AS (SELECT doc_id, {toks('text')} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(CASE WHEN len(w) < 3 THEN 0
  ELSE len(list_distinct(list_transform(range(1, greatest(len(w) - 4, 2)), lambda i: array_to_string(w[i:i+5], ' ')))) END AS BIGINT) AS n_shingles FROM t""")
def shingles(spark, sf):
    words = X.tokens(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(X.shingles(F.col("w"))).cast("long").alias("n_shingles"))


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS n_tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("n_tokens"))


@query(f"""
WITH t AS (SELECT doc_id, list_distinct({toks('text')}) AS s FROM documents)
SELECT a.doc_id, CAST(len(list_intersect(a.s, b.s)) AS BIGINT) AS n_both, CAST(len(list_distinct(list_concat(a.s, b.s))) AS BIGINT) AS n_any,
  CAST(len(a.s) - len(list_intersect(a.s, b.s)) AS BIGINT) AS n_only FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def token_set_ops(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", X.token_set(F.col("text")).alias("s"))
    a, b = t.alias("a"), t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("r"))
    both = a.join(b, "doc_id")
    return both.select("doc_id", F.size(F.array_intersect("s", "r")).cast("long").alias("n_both"), F.size(F.array_union("s", "r")).cast("long").alias("n_any"), F.size(F.array_except("s", "r")).cast("long").alias("n_only"))


@query(f"""
WITH t AS (SELECT doc_id, list_distinct({toks('text')}) AS s FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE END, 9) AS sim
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def jaccard_pairs(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", X.token_set(F.col("text")).alias("s"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("r"))
    return t.join(b, "doc_id").select("doc_id", F.round(X.jaccard(F.col("s"), F.col("r")), 9).alias("sim"))


@query(f"""
WITH s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 2)), lambda i: array_to_string(w[i:i+5], ' '))) AS g
  FROM (SELECT item_id, {toks('text')} AS w FROM benchmark) WHERE len(w) >= 3),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 2)), lambda i: array_to_string(w[i:i+5], ' '))) AS g
  FROM (SELECT doc_id, {toks('text')} AS w FROM documents) WHERE len(w) >= 3)
SELECT doc_id, count(DISTINCT item_id) AS n_spans FROM d JOIN s USING (g) GROUP BY doc_id""")
def taint_overlap(spark, sf):
    return belief.taint_overlap(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# --- scans, counts ----------------------------------------------------------------------------------


@query(f"WITH {MEMORIES_SQL} SELECT status, count(*) AS n FROM memories GROUP BY 1")
def count_by_status(spark, sf):
    return store.count_by(memories(spark, sf), "status")


@query(f"WITH {MEMORIES_SQL} SELECT type, count(*) AS n FROM memories GROUP BY 1")
def count_by_type(spark, sf):
    return store.count_by(memories(spark, sf), "type")


@query(f"WITH {MEMORIES_SQL} SELECT trust, count(*) AS n FROM memories GROUP BY 1")
def count_by_trust(spark, sf):
    return store.count_by(memories(spark, sf), "trust")


@query(f"""WITH {MEMORIES_SQL} SELECT id, type, trust, status FROM memories WHERE status IN ('active', 'aging') AND type IN ('fact', 'decision')
  AND updated_at >= TIMESTAMP '2023-01-01' ORDER BY updated_at DESC, id LIMIT 50""")
def list_filtered(spark, sf):
    return store.listed(memories(spark, sf), statuses=["active", "aging"], types=["fact", "decision"], since="2023-01-01", limit=50).select("id", "type", "trust", "status")


@query(f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE status = 'active' AND trust IN (0, 1, 2)")
def injectable(spark, sf):
    return memories(spark, sf).where((F.col("status") == "active") & F.col("trust").isin(0, 1, 2)).select("id")


@query(f"WITH {MEMORIES_SQL} SELECT id, status FROM memories WHERE CAST(id AS VARCHAR) LIKE '12%'")
def prefix_lookup(spark, sf):
    return store.by_prefix(memories(spark, sf), "12").select("id", "status")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%the%tion%'")
def content_like(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").ilike("%the%tion%")).select("doc_id")


@query(f"WITH {OPS_SQL} SELECT op_id, memory_id FROM ops WHERE op = 'reconfirm' ORDER BY op_id DESC LIMIT 20")
def recent_ops(spark, sf):
    return store.recent_ops(ops(spark, sf), "reconfirm", 20).select("op_id", "memory_id")


@query(f"WITH {OPS_SQL} SELECT coalesce(max(op_id), 0) AS epoch FROM ops WHERE op NOT IN ('inject', 'export', 'counter')")
def vector_epoch(spark, sf):
    return store.epoch(ops(spark, sf))


@query(f"WITH {OPS_SQL} SELECT op, count(*) AS n, count(DISTINCT memory_id) AS n_memories FROM ops GROUP BY 1")
def counters(spark, sf):
    return ops(spark, sf).groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("memory_id").alias("n_memories"))


@query(f"""WITH {MEMORIES_SQL} SELECT count(*) AS n_rows, count(content) AS n_indexed, count(*) FILTER (status IN ('active', 'aging')) AS n_live,
  count(*) - count(DISTINCT sha256({norm('content')})) AS n_collisions FROM memories""")
def doctor_counts(spark, sf):
    m = memories(spark, sf).withColumn("h", X.content_hash(F.col("content")))
    return m.agg(F.count("*").alias("n_rows"), F.count("content").alias("n_indexed"), F.count_if(F.col("status").isin("active", "aging")).alias("n_live"), (F.count("*") - F.count_distinct("h")).alias("n_collisions"))


@query(f"""WITH {MEMORIES_SQL} SELECT sha256({norm('content')}) AS content_hash, arg_max(id, struct_pack(u := updated_at, i := id)) AS id FROM memories GROUP BY 1""")
def hash_lookup_newest(spark, sf):
    m = memories(spark, sf).withColumn("content_hash", X.content_hash(F.col("content")))
    return m.groupBy("content_hash").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"))


@query(f"""WITH {MEMORIES_SQL} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY sha256({norm('content')}) ORDER BY id) AS r FROM memories) WHERE r = 1""")
def dedupe_first(spark, sf):
    return store.first_seen(memories(spark, sf).withColumn("h", X.content_hash(F.col("content"))), "h", "id").select("id")


@query("SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE octet_length(encode(text)) >= 2000 GROUP BY 1")
def session_gate(spark, sf):
    return table(spark, sf, "documents").where(F.octet_length("text") >= 2000).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


# --- entities -------------------------------------------------------------------------------------------


@query(f"WITH {MEMORIES_SQL} SELECT scope AS name, count(*) FILTER (status IN ('active', 'aging')) AS n FROM memories GROUP BY 1")
def entity_counts(spark, sf):
    m = memories(spark, sf)
    return store.entity_counts(m.select(F.col("scope").alias("name")).distinct(), m.select("id", F.col("scope").alias("name")), m)


@query(f"WITH {MEMORIES_SQL} SELECT scope AS name, count(*) AS n, max(updated_at) AS newest, string_agg(CAST(id AS VARCHAR), ',' ORDER BY updated_at DESC, id) AS ids FROM memories WHERE status <> 'tombstoned' GROUP BY 1")
def entity_dossier(spark, sf):
    m = memories(spark, sf).where("status <> 'tombstoned'")
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("updated_at")).alias("t"), "id"))), lambda x: x["id"].cast("string"))
    return m.groupBy(F.col("scope").alias("name")).agg(F.count("*").alias("n"), F.max("updated_at").alias("newest"), F.array_join(order, ",").alias("ids"))


@query(f"WITH {MEMORIES_SQL} SELECT m.id, m.superseded_by FROM memories m WHERE m.superseded_by IS NOT NULL AND NOT EXISTS (SELECT 1 FROM memories n WHERE n.id = m.superseded_by)")
def orphan_links(spark, sf):
    m = memories(spark, sf)
    links = m.where("superseded_by is not null").select("id", "superseded_by")
    return links.join(m.select(F.col("id").alias("superseded_by")), "superseded_by", "left_anti").select("id", "superseded_by")


# --- ranking -------------------------------------------------------------------------------------------


@query(f"""WITH {MEMORIES_SQL} SELECT id, round(CASE type WHEN 'event' THEN confidence * pow(2, -greatest(date_diff('second', last_confirmed_at, {NOW_SQL}) / 86400.0, 0) / 90)
  WHEN 'note' THEN confidence * pow(2, -greatest(date_diff('second', last_confirmed_at, {NOW_SQL}) / 86400.0, 0) / 180)
  WHEN 'fact' THEN confidence * pow(2, -greatest(date_diff('second', last_confirmed_at, {NOW_SQL}) / 86400.0, 0) / 540) ELSE confidence END, 6) AS eff FROM memories""")
def effective_confidence(spark, sf):
    return memories(spark, sf).select("id", F.round(R.effective_confidence(F.col("confidence"), F.col("type"), F.col("last_confirmed_at"), now()), 6).alias("eff"))


EFF = f"""e AS (SELECT *, date_diff('second', last_confirmed_at, {NOW_SQL}) / 86400.0 AS age, CASE type WHEN 'event' THEN 90.0 WHEN 'note' THEN 180.0 WHEN 'fact' THEN 540.0 END AS hl FROM memories),
f AS (SELECT *, CASE WHEN hl IS NULL OR age <= 0 THEN confidence ELSE confidence * pow(2, -age / hl) END AS eff,
  CASE WHEN hl IS NULL OR age <= 0 THEN 1.0 ELSE 0.3 + 0.7 * pow(2, -floor(age / hl)) * (1 - 0.5 * (age / hl - floor(age / hl))) END AS rec FROM e),
s AS (SELECT *, (0.6 + 0.1 * importance) * CASE trust WHEN 0 THEN 1.0 WHEN 1 THEN 0.97 WHEN 2 THEN 0.9 WHEN 3 THEN 0.75 ELSE 0.5 END * rec * (0.5 + 0.5 * eff)
  * CASE status WHEN 'aging' THEN 0.6 WHEN 'superseded' THEN 0.4 WHEN 'quarantined' THEN 0.4 WHEN 'tombstoned' THEN 0.25 ELSE 1.0 END AS m FROM f)"""


@query(f"WITH {MEMORIES_SQL}, {EFF} SELECT id, round(rec, 6) AS recency FROM s")
def recency_factor(spark, sf):
    return memories(spark, sf).select("id", F.round(R.recency(F.col("type"), F.col("last_confirmed_at"), now()), 6).alias("recency"))


@query(f"WITH {MEMORIES_SQL}, {EFF} SELECT id, round(m, 6) AS score FROM s")
def modulated_score(spark, sf):
    return recall.with_modulation(memories(spark, sf), F.lit(1.0), now()).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {MEMORIES_SQL}, {EFF} SELECT id, round(eff, 6) AS eff FROM s WHERE status = 'active' AND eff < 0.35")
def stale_preview(spark, sf):
    return consolidate.stale(memories(spark, sf), now()).select("id", F.round("eff", 6).alias("eff"))


@query(f"""WITH {MEMORIES_SQL}, {EFF}, p AS (SELECT * FROM s WHERE status = 'active' AND trust IN (0, 1, 2) ORDER BY updated_at DESC, id LIMIT 600)
SELECT id, round(m * CASE WHEN type IN ('preference', 'decision') THEN 1.3 WHEN type = 'fact' THEN 1.15 ELSE 1.0 END, 6) AS score FROM p ORDER BY 2 DESC, updated_at DESC, id LIMIT 8""")
def briefing(spark, sf):
    return recall.briefing(memories(spark, sf), now(), RECALL_LIMIT)


TERMS = ("the", "thtion", "que")
BM25_SQL = f"""
w AS (SELECT id, unnest({toks('content')}) AS t FROM memories),
dl AS (SELECT id, count(*) AS dl FROM w GROUP BY 1), st AS (SELECT (SELECT count(*) FROM memories) AS n_docs, (SELECT count(*) FROM w)::DOUBLE / (SELECT count(*) FROM memories) AS avgdl),
tf AS (SELECT id, t, count(*) AS tf FROM w WHERE t IN ('the', 'thtion', 'que') GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT tf.id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM tf JOIN df USING (t) JOIN dl ON dl.id = tf.id, st GROUP BY 1)"""


@query(f"WITH {MEMORIES_SQL}, {BM25_SQL} SELECT (SELECT n_docs FROM st) AS n_docs, round((SELECT avgdl FROM st), 6) AS avgdl, t AS term, df FROM df")
def bm25_stats(spark, sf):
    p = recall.postings(memories(spark, sf))
    return recall.term_statistics(p, memories(spark, sf), TERMS).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "term", "df")


@query(f"WITH {MEMORIES_SQL}, {BM25_SQL} SELECT id, round(bm25, 6) AS bm25 FROM b ORDER BY 2 DESC, id LIMIT 50")
def bm25_topk(spark, sf):
    return recall.bm25(memories(spark, sf), TERMS).select("id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(50)


COSINE_SQL = """
q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q.v) AS cosine FROM embeddings, q)"""


@query(f"WITH {COSINE_SQL} SELECT vec_id, round(cosine, 6) AS cosine FROM c WHERE cosine > 0 ORDER BY 2 DESC, vec_id LIMIT 50")
def cosine_topk(spark, sf):
    return recall.cosine_topk(table(spark, sf, "embeddings"), 0, 50).select("vec_id", F.round("cosine", 6).alias("cosine"))


RRF_SQL = f"""{BM25_SQL}, {COSINE_SQL},
live AS (SELECT id FROM memories WHERE status IN ('active', 'aging')),
lx AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 6) DESC, id) AS r FROM b JOIN live USING (id) QUALIFY r <= 50),
sx AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(cosine, 6) DESC, vec_id) AS r FROM c JOIN live ON live.id = vec_id WHERE cosine > 0 QUALIFY r <= 50),
rr AS (SELECT coalesce(lx.id, sx.id) AS id, coalesce(1.0::DOUBLE / (60 + lx.r), 0) + coalesce(1.0::DOUBLE / (60 + sx.r), 0) AS rrf FROM lx FULL JOIN sx ON lx.id = sx.id)"""


@query(f"WITH {MEMORIES_SQL}, {RRF_SQL} SELECT id, round(rrf, 9) AS rrf FROM rr")
def rrf_fusion(spark, sf):
    return recall.fused(memories(spark, sf), table(spark, sf, "embeddings"), TERMS, 0).select("id", F.round("rrf", 9).alias("rrf"))


@query(f"WITH {MEMORIES_SQL}, {EFF}, {RRF_SQL} SELECT id, round(rrf * m, 9) AS score FROM rr JOIN s USING (id) ORDER BY 2 DESC, updated_at DESC, id LIMIT 8")
def recall_query(spark, sf):
    return recall.recall(memories(spark, sf), table(spark, sf, "embeddings"), TERMS, 0, now(), RECALL_LIMIT)


QUERIES["recall"] = QUERIES.pop("recall_query")
ORACLE_SQL["recall"] = ORACLE_SQL.pop("recall_query")


# --- scan ------------------------------------------------------------------------------------------------


def _count_sql(pattern: str) -> str:
    return f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{pattern}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{pattern}')"


@query(_count_sql(scan.RULES["email"]))
def scan_email(spark, sf):
    return scan.counted(table(spark, sf, "documents"), "email")


@query(_count_sql(scan.RULES["phone"]))
def scan_phone(spark, sf):
    return scan.counted(table(spark, sf, "documents"), "phone")


@query(_count_sql(scan.RULES["assigned-credential"].replace("'", "''")))
def scan_assigned(spark, sf):
    return scan.counted(table(spark, sf, "documents"), "assigned-credential")


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{scan.RULES['email']}', '[REDACTED:email]', 'g')) AS redacted FROM documents WHERE regexp_matches(text, '{scan.RULES['email']}')")
def redact_email(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike(scan.RULES["email"]))
    return d.select("doc_id", F.sha2(scan.redacted(F.col("text"), "email").cast("binary"), 256).alias("redacted"))


@query("""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{13,19}')) AS digits FROM documents),
x AS (SELECT *, list_sum(list_transform(range(1, len(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INT)
  ELSE 2 * CAST(reverse(digits)[i] AS INT) - CASE WHEN CAST(reverse(digits)[i] AS INT) > 4 THEN 9 ELSE 0 END END)) AS total FROM c)
SELECT doc_id, count(*) AS n, count(*) FILTER (total % 10 = 0) AS n_valid FROM x GROUP BY 1""")
def luhn_valid(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("digits"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(X.luhn_valid(F.col("digits"))).alias("n_valid"))


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{scan.CLASS[k]}' AS class, '{k}' AS kind, len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS n FROM documents" for k, p in scan.RULES.items()) + ") SELECT class, kind, CAST(sum(n) AS BIGINT) AS n FROM s WHERE n > 0 GROUP BY ALL")
def scan_summary(spark, sf):
    return scan.summary(table(spark, sf, "documents"))


@query("SELECT doc_id, CASE WHEN " + " OR ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for k, p in scan.RULES.items() if scan.CLASS[k] == "secret") + " THEN 'refuse' ELSE 'store' END AS policy FROM documents")
def write_policy(spark, sf):
    return scan.policy(table(spark, sf, "documents")).select("doc_id", "policy")


def _findings_sql() -> str:
    """f: doc_id, class, kind, pos (where it starts) and stop of all findings of the catalogue, those that an earlier one holds left out."""
    digits = "regexp_replace(m[i], '[^0-9]', '', 'g')"
    verify = {
        "assigned-credential": "NOT (" + " OR ".join(f"contains(lower(m[i]), '{x}')" for x in scan.PLACEHOLDERS) + ")",
        "credit-card": f"len({digits}) BETWEEN 13 AND 19 AND list_sum([CASE WHEN k % 2 = 1 THEN reverse({digits})[k]::INT ELSE 2 * reverse({digits})[k]::INT - CASE WHEN reverse({digits})[k]::INT > 4 THEN 9 ELSE 0 END END for k in range(1, len({digits}) + 1)]) % 10 = 0",
        "iban": "m[i][1:2] IN (" + ", ".join(f"'{x}'" for x in scan.IBAN_COUNTRIES) + ")",
    }
    rules = []
    for r, (cls, kind, pattern) in enumerate(scan.CATALOGUE):
        p = pattern.replace("'", "''")
        rules.append(f"""SELECT doc_id, {r} AS rule, i, '{cls}' AS class, '{kind}' AS kind, list_sum([len(x) for x in g[1:i]]) + coalesce(list_sum([len(x) for x in m[1:i - 1]]), 0) AS pos, len(m[i]) AS n
  FROM (SELECT doc_id, m, string_split_regex(text, '{p}') AS g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m FROM documents) WHERE len(m) > 0) WHERE {verify.get(kind, 'TRUE')}""")
    return "ruled AS MATERIALIZED (" + " UNION ALL ".join(rules) + """),
f AS (SELECT doc_id, class, kind, pos, pos + n AS stop FROM ruled a WHERE NOT EXISTS (SELECT 1 FROM ruled b WHERE b.doc_id = a.doc_id AND (b.rule < a.rule OR (b.rule = a.rule AND b.i < a.i)) AND b.pos <= a.pos AND a.pos + a.n <= b.pos + b.n))"""


@query(f"WITH {_findings_sql()} SELECT class, kind, count(*) AS n FROM f GROUP BY 1, 2")
def scan_catalogue(spark, sf):
    return scan.catalogue_summary(table(spark, sf, "documents"))


@query(f"WITH {_findings_sql()} SELECT doc_id, class, kind, CAST(pos AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM f")
def scan_places(spark, sf):
    """Every finding of the catalogue with its place."""
    d = table(spark, sf, "documents").select("doc_id", F.inline(scan.findings(F.col("text"))))
    return d.select("doc_id", "class", "kind", "start", F.col("end").alias("stop"))


@query(f"WITH {_findings_sql()} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM f) THEN 'refuse' ELSE 'store' END AS policy FROM documents")
def write_policy_catalogue(spark, sf):
    return scan.catalogue_policy(table(spark, sf, "documents")).select("doc_id", "policy")


# --- lifecycle -------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {MEMORIES_SQL}, c(start, id, depth) AS (
  SELECT id, superseded_by, 1 FROM memories WHERE superseded_by IS NOT NULL
  UNION ALL SELECT c.start, m.superseded_by, c.depth + 1 FROM c JOIN memories m ON m.id = c.id WHERE m.superseded_by IS NOT NULL AND c.depth < 32)
SELECT c.start, max(c.depth) AS depth, arg_max(c.id, c.depth) AS newest FROM c JOIN memories m ON m.id = c.id GROUP BY 1""".replace("max(c.depth)", "CAST(max(c.depth) AS INT)"))
def chain_newer(spark, sf):
    return store.newest_in_chain(memories(spark, sf))


@query(f"WITH {OPS_SQL} SELECT memory_id, arg_max(op, op_id) AS last_op, max(op_id) AS op_id FROM ops WHERE op IN ('create', 'approve', 'reject') GROUP BY 1")
def status_fold(spark, sf):
    return store.last_op(ops(spark, sf), ["create", "approve", "reject"])


@query(f"WITH {OPS_SQL} SELECT memory_id, count(*) AS n, round(least(1.0, 0.5 + 0.1 * count(*)), 6)::DOUBLE AS confidence, max(op_id) AS last_op FROM ops WHERE op = 'reconfirm' GROUP BY 1")
def reconfirm_fold(spark, sf):
    return store.reconfirmed(ops(spark, sf), 0.5)


@query(f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN status = 'active' THEN 'active' WHEN status = 'superseded' THEN 'refused' WHEN trust = 3 THEN 'quarantined' ELSE 'active' END AS target FROM memories")
def restore_target(spark, sf):
    return memories(spark, sf).select("id", store.restore_target(F.col("status"), F.col("trust")).alias("target"))


@query(f"WITH {MEMORIES_SQL}, {EFF} SELECT id, CASE WHEN status = 'active' AND eff < 0.35 THEN 'aging' ELSE status END AS status FROM s")
def consolidate_demote(spark, sf):
    return consolidate.demoted(memories(spark, sf), now()).select("id", "status")


@query(f"WITH {MEMORIES_SQL} SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(list_position(['decision', 'preference', 'fact', 'event', 'note'], type) AS INT) AS place FROM memories WHERE status = 'active' GROUP BY type")
def export_by_type(spark, sf):
    order = F.array(*map(F.lit, ("decision", "preference", "fact", "event", "note")))
    return memories(spark, sf).where("status = 'active'").groupBy("type").agg(F.count("*").alias("n")).withColumn("place", F.array_position(order, F.col("type")).cast("int"))


@query(f"WITH {MEMORIES_SQL} SELECT id, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM memories")
def time_codec(spark, sf):
    return memories(spark, sf).select("id", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))


@query(f"""WITH {MEMORIES_SQL}, a AS (SELECT id, CAST(updated_at AS DATE) AS d FROM memories)
SELECT id, CAST(d + CAST((8 - dayofweek(d)) % 7 + CASE WHEN dayofweek(d) = 1 THEN 7 ELSE 0 END AS INT) AS DATE) AS next_monday FROM a""")
def weekday_shift(spark, sf):
    return memories(spark, sf).select("id", F.next_day("updated_at", "Mon").alias("next_monday"))


@query("SELECT conv_id, role, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM conversations GROUP BY ALL")
def turn_counts(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, role, text)) AS rendered FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY 1")
def transcript_render(spark, sf):
    return store.rendered(table(spark, sf, "conversations")).select("conv_id", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'T0:active' WHEN 'view' THEN 'T2:quarantined' ELSE 'T3:quarantined' END AS origin FROM events")
def classify_origin(spark, sf):
    origin = F.when(F.col("event_type") == "click", "user_stated").when(F.col("event_type") == "view", "dialogue").otherwise("tool_output")
    return table(spark, sf, "events").select("event_id", store.origin(origin).alias("origin"))


@query("""SELECT l_returnflag AS label, count(*) AS n, round(max(CASE WHEN r = floor(0.5 * (c - 1)) + 1 THEN l_quantity END)::DOUBLE, 6) AS p50, round(max(CASE WHEN r = floor(0.9 * (c - 1)) + 1 THEN l_quantity END)::DOUBLE, 6) AS p90
FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) GROUP BY 1""")
def latency_pct(spark, sf):
    return store.lower_percentiles(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("value")), {"p50": 0.5, "p90": 0.9})


@query("SELECT lang AS label, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_right, round(avg(quality)::DOUBLE, 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def accuracy_by_label(spark, sf):
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return x.groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("n_right"), F.round(F.avg("quality"), 6).alias("accuracy"))


TRIM_SQL = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
LINE_SQL = f"""'- [' || type || '] ' || {TRIM_SQL} || CASE WHEN type IN ('event', 'note') THEN ' (as of ' || strftime(last_confirmed_at, '%Y-%m-%d') || ')' ELSE '' END || ' [' || left(CAST(id AS VARCHAR), 8) || ']'"""
CONTEXT_SQL = f"""o AS (SELECT scope, id, round(m, 6) AS score, CAST(ceil(octet_length(encode({LINE_SQL})) / 4.0) AS BIGINT) + 1 AS cost FROM s WHERE status = 'active' AND trust IN (0, 1, 2))"""


@query(f"WITH {MEMORIES_SQL}, {EFF}, {CONTEXT_SQL} SELECT scope, id, score, cost FROM o")
def context_candidates(spark, sf):
    return recall.context_candidates(memories(spark, sf), now())


@query(f"""WITH RECURSIVE {MEMORIES_SQL}, {EFF}, {CONTEXT_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS r FROM o WHERE cost <= 700 - {recall.FRAME_TOKENS}),
pk(scope, r, used, k, ids) AS (
  SELECT DISTINCT scope, CAST(0 AS BIGINT), CAST({recall.FRAME_TOKENS} AS BIGINT), 0, '' FROM n
  UNION ALL SELECT pk.scope, n.r, CASE WHEN used + cost <= 700 AND k < 12 THEN used + cost ELSE used END, CASE WHEN used + cost <= 700 AND k < 12 THEN k + 1 ELSE k END,
    CASE WHEN used + cost <= 700 AND k < 12 THEN ids || CASE WHEN k = 0 THEN '' ELSE ',' END || CAST(id AS VARCHAR) ELSE ids END FROM pk JOIN n ON n.scope = pk.scope AND n.r = pk.r + 1)
SELECT scope, arg_max(used, r) AS used, arg_max(ids, r) AS ids FROM pk GROUP BY scope""")
def context_pack(spark, sf):
    return recall.context_pack(recall.context_candidates(memories(spark, sf), now()), 12, 700)


@query(f"""WITH {MEMORIES_SQL}, h AS (SELECT id, updated_at, sha256({norm('content')}) AS h FROM memories WHERE status IN ('active', 'aging')), n AS (SELECT h, arg_max(id, struct_pack(u := updated_at, i := id)) AS newest FROM h GROUP BY 1)
SELECT id, CASE WHEN id <> newest THEN newest END AS superseded_by FROM h JOIN n USING (h)""")
def consolidate_survivors(spark, sf):
    return consolidate.survivors(memories(spark, sf).where(F.col("status").isin("active", "aging")))


# --- interchange, rendering, review ---------------------------------------------------------------


@query(f"WITH {MEMORIES_SQL} SELECT id, {LINE_SQL} AS line FROM memories")
def context_lines(spark, sf):
    return memories(spark, sf).select("id", recall.context_line(F.col("type"), F.col("content"), F.col("last_confirmed_at"), F.col("id")).alias("line"))


@query(r"SELECT doc_id, e AS email, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')) AS e FROM documents) GROUP BY ALL")
def extract_emails(spark, sf):
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("email")).groupBy("doc_id", "email").agg(F.count("*").alias("n"))


@query(f"""WITH h AS (SELECT doc_id, sha256({norm('text')}) AS content_hash FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS r FROM h WHERE doc_id % 2 = 1)
SELECT doc_id, content_hash FROM n WHERE r = 1 AND content_hash NOT IN (SELECT content_hash FROM h WHERE doc_id % 2 = 0)""")
def import_dedupe(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return store.new_claims(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("doc_id", "content_hash")


@query(f"""WITH {MEMORIES_SQL}, {EFF}, r AS (SELECT id, sha256({norm('content')}) AS h, CAST(id % 2 AS INT) AS list, round(m, 6) AS score FROM s WHERE status = 'active'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY list, score DESC, id) AS k FROM r) SELECT id, score FROM firsts WHERE k = 1 ORDER BY score DESC, id LIMIT 100""")
def merge_scopes(spark, sf):
    m = recall.with_modulation(memories(spark, sf).where("status = 'active'"), F.lit(1.0), now())
    rows = m.select("id", X.content_hash(F.col("content")).alias("h"), (F.col("id") % 2).alias("list"), F.round("score", 6).alias("score"))
    return recall.merged(rows.where("list = 0"), rows.where("list = 1")).orderBy(F.desc("score"), "id").limit(100).select("id", "score")


@query(f"WITH {MEMORIES_SQL} SELECT id, type, sha256({norm('content')}) AS content_hash, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM memories WHERE status IN ('active', 'aging')")
def export_select(spark, sf):
    m = memories(spark, sf).where(F.col("status").isin("active", "aging"))
    return m.select("id", "type", X.content_hash(F.col("content")).alias("content_hash"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"))


@query(f"WITH {MEMORIES_SQL} SELECT m.id, count(o.id) AS n_older, min(o.id) AS first_older FROM memories m LEFT JOIN memories o ON o.superseded_by = m.id WHERE m.type = 'decision' AND m.status IN ('active', 'aging') GROUP BY 1")
def decisions_log(spark, sf):
    m = memories(spark, sf)
    older = m.where("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("first_older"))
    return m.where("type = 'decision' and status in ('active', 'aging')").join(older, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_older"), "first_older")


@query(f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN status = 'quarantined' THEN 'active' ELSE status END AS status, CASE WHEN status = 'quarantined' THEN 1 ELSE trust END AS trust, CASE WHEN status = 'quarantined' THEN 0.95::DOUBLE ELSE confidence END AS confidence FROM memories")
def approve_fold(spark, sf):
    return store.approved(memories(spark, sf), F.col("status") == "quarantined").select("id", "status", "trust", "confidence")


@query(f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE scope = 'src7' AND status <> 'tombstoned'")
def forget_targets(spark, sf):
    return memories(spark, sf).where((F.col("scope") == "src7") & (F.col("status") != "tombstoned")).select("id")


@query(f"""WITH {MEMORIES_SQL} SELECT id, 'met on ' || strftime(updated_at - INTERVAL 1 DAY, '%Y-%m-%d') || ', on ' || strftime(updated_at, '%Y-%m-%d') || ' and on ' || strftime(updated_at + INTERVAL 1 DAY, '%Y-%m-%d') || ', 3 of ' || CAST(id AS VARCHAR) AS content FROM memories""")
def absolutize_dates(spark, sf):
    m = memories(spark, sf)
    text = F.concat(F.lit("met Yesterday, today and on tomorrow, 3 of "), F.col("id").cast("string"))
    return m.select("id", consolidate.absolute_dates(text, F.col("updated_at")).alias("content"))


def _dated_sql() -> str:
    """The phrases of ``consolidate.absolute_dates``, one replacement after the other, over d: id, text and day."""
    on = lambda d: f"'on ' || strftime({d}, '%Y-%m-%d')"
    steps = [("yesterday", on("day - 1")), ("today|this (?:morning|afternoon|evening)", on("day")), ("tomorrow", on("day + 1"))]
    for i, name in enumerate(consolidate.WEEKDAYS):
        steps.append((f"last {name}", on(f"day - ((dayofweek(day) - {i} + 6) % 7 + 1)::INT")))
        steps.append((f"next {name}", on(f"day + (({i} - dayofweek(day) + 6) % 7 + 1)::INT")))
    for which, k in (("last", -1), ("this", 0), ("next", 1)):
        steps.append((f"{which} week", f"'the week of ' || strftime(day + {7 * k}, '%Y-%m-%d')"))
        steps.append((f"{which} month", f"strftime(day + INTERVAL ({k}) MONTH, '%B %Y')"))
    ago = r"(?i)\b[0-9]+ days? ago\b"
    said = f"CASE WHEN try_cast(regexp_extract(m[i], '^[0-9]+') AS INT) <= day - DATE '0001-01-01' THEN 'on ' || strftime(day - try_cast(regexp_extract(m[i], '^[0-9]+') AS INT), '%Y-%m-%d') ELSE m[i] END"
    sql = [f"d0 AS (SELECT id, day, array_to_string([g[i] || coalesce({said}, '') for i in range(1, len(g) + 1)], '') AS text FROM (SELECT id, day, regexp_extract_all(text, '{ago}') AS m, string_split_regex(text, '{ago}') AS g FROM d))"]
    for n, (words, put) in enumerate(steps):
        sql.append(f"d{n + 1} AS (SELECT id, day, regexp_replace(text, '(?i)\\b(?:{words})\\b', {put}, 'g') AS text FROM d{n})")
    return ",\n".join(sql) + f",\nlast AS (SELECT id, replace(text, 'on on ', 'on ') AS content FROM d{len(steps)})"


@query(f"WITH {MEMORIES_SQL}, d AS (SELECT id, content AS text, updated_at::DATE AS day FROM memories), {_dated_sql()} SELECT id, content FROM last")
def absolutize_content(spark, sf):
    return memories(spark, sf).select("id", consolidate.absolute_dates(F.col("content"), F.col("updated_at")).alias("content"))


@query(f"WITH {MEMORIES_SQL}, {EFF} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN status = 'active' AND eff < 0.35 THEN 'demoted' WHEN status = 'superseded' THEN 'resolved' ELSE 'kept' END AS kind FROM s) GROUP BY 1")
def consolidate_report(spark, sf):
    was = memories(spark, sf)
    after = consolidate.demoted(was.withColumn("was", F.col("status")), now())
    kind = F.when(F.col("was") != F.col("status"), "demoted").when(F.col("status") == "superseded", "resolved").otherwise("kept")
    return after.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# --- verdicts ----------------------------------------------------------------------------------------

FILLERS_SQL = "[" + ", ".join(f"'{x}'" for x in belief.FILLERS) + "]"
_q = lambda s: s.replace("'", "''")
PAIRS_SQL = rf"""
t AS (SELECT doc_id, source, text, list_distinct({toks('text')}) AS s FROM documents),
p AS (SELECT n.doc_id, n.text AS new, o.text AS old, n.source = o.source AS shares_entity, n.s AS a, o.s AS b,
    list_filter(n.s, lambda x: NOT list_contains({FILLERS_SQL}, x)) AS fa, list_filter(o.s, lambda x: NOT list_contains({FILLERS_SQL}, x)) AS fb
  FROM t n JOIN t o ON o.doc_id = n.doc_id + 1),
v AS (SELECT *, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 9) AS sim,
    CASE WHEN least(len(fa), len(fb)) = 0 THEN FALSE ELSE len(list_intersect(fa, fb)) / least(len(fa), len(fb))::DOUBLE >= 0.5 END AS subject,
    regexp_matches(new, '(?i)\b{_q(belief.NEGATION)}\b') <> regexp_matches(old, '(?i)\b{_q(belief.NEGATION)}\b') AS denied,
    list_transform(regexp_extract_all(lower(new), '\b{_q(belief.RELATION)}\b'), lambda x: regexp_replace(regexp_replace(x, '^(\S+?)es(\s|$)', '\1\2'), '^(\S+?)s(\s|$)', '\1\2')) AS ra,
    list_transform(regexp_extract_all(lower(old), '\b{_q(belief.RELATION)}\b'), lambda x: regexp_replace(regexp_replace(x, '^(\S+?)es(\s|$)', '\1\2'), '^(\S+?)s(\s|$)', '\1\2')) AS rb,
    len(list_filter(fa, lambda x: NOT list_contains(b, x) AND (regexp_matches(x, '^[a-z0-9][a-z0-9.\-_/+]*$') OR regexp_matches(x, '[0-9]')))) > 0 AS va,
    len(list_filter(fb, lambda x: NOT list_contains(a, x) AND (regexp_matches(x, '^[a-z0-9][a-z0-9.\-_/+]*$') OR regexp_matches(x, '[0-9]')))) > 0 AS vb FROM p),
w AS (SELECT *, denied OR (list_has_any(ra, rb) AND va AND vb) AS clash FROM v)"""


def _pairs(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", "source", "text", X.token_set(F.col("text")).alias("s"))
    old = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("other"), F.col("text").alias("old"), F.col("s").alias("b"))
    return t.join(old, "doc_id").select("doc_id", F.col("text").alias("new"), "old", (F.col("source") == F.col("other")).alias("shares_entity"), F.col("s").alias("a"), "b")


@query(f"WITH {PAIRS_SQL} SELECT doc_id, subject FROM w")
def subject_overlap(spark, sf):
    return _pairs(spark, sf).select("doc_id", belief.subject_overlap(F.col("a"), F.col("b")).alias("subject"))


@query(f"WITH {PAIRS_SQL} SELECT doc_id, clash FROM w")
def incompatible_pairs(spark, sf):
    return _pairs(spark, sf).select("doc_id", belief.incompatible(F.col("new"), F.col("old"), F.col("a"), F.col("b")).alias("clash"))


@query(f"""WITH {PAIRS_SQL} SELECT doc_id, sim, CASE WHEN sha256({norm('new')}) = sha256({norm('old')}) OR sim >= 0.93 THEN 'duplicate'
  WHEN NOT ((subject OR shares_entity) AND sim >= CASE WHEN subject THEN 0.38 ELSE 0.55 END) THEN 'none' WHEN clash THEN 'supersedes' WHEN sim >= 0.82 THEN 'ambiguous' ELSE 'none' END AS verdict FROM w""")
def adjudicate_pairs(spark, sf):
    return belief.verdicts(_pairs(spark, sf)).select("doc_id", "sim", "verdict")


@query(rf"SELECT conv_id, turn, CASE WHEN regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '{_q(belief.DIRECTIVE)}') THEN 'directive marker' WHEN regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '{_q(belief.OPENING)}') THEN 'imperative opening' ELSE '' END AS why FROM conversations")
def imperative_screen(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", belief.imperative(F.col("text")).alias("why"))


# the queries of these modules register themselves here too
from keepsake.plans import more_queries  # noqa: E402, F401
