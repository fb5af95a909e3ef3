"""Secret scans with multipart credential linking.

Base findings, leftmost and non-overlapping per kind: ``assign`` (a credential word, an assignment,
a value of 12 or more characters), ``access`` (access identifiers) and ``hex`` (hexadecimal runs).
They are strong and always reported.

Weak candidates are parts of a credential that alone would be noise: ``id`` (a user or client name
that is assigned), ``key`` (a bare run of 20 or more letters and digits of mixed kinds that no base
finding holds) and ``endpoint`` (a URL or host with port). A weak part is reported only if a part
that complements it stands within ``scope`` code points of it: an identifier (access, id) needs a
secret (assign, hex, key), a key needs an identifier or endpoint, an endpoint needs a secret that is
strong or a key. The linking is an interval join: parts fall into bins as wide as the scope, and
every part is joined with what its own bin and the two beside it hold of each role: the first start
and the last end there, which is all that "is one within the scope" can depend on. So a hot document
never pairs all its parts.

Edge cases: null text counts as empty; an empty table gives an empty result. Rows that repeat are
each answered; a null doc_id is an id like any other. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import saved

#: The kinds in the order that breaks ties, and the base patterns.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
WEAK = {
    "id": re.compile(r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""),
    "key": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}"),
    "endpoint": re.compile(r"(?i:\b(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+)|\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}:[0-9]{2,5}\b"),
}
#: What a text must hold for any pattern above to match; it spares most texts the search. Hexadecimal runs shorter than 16 fail anyway.
_MAY = r"""(?i)passw(or)?d|secret|token|api_?key|user|login|account|client_?id|access_?key_?id|://""" + r"""|(?-i)AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z]:[0-9]{2}|[A-Za-z0-9+/_=-]{20}"""
ROLE = {"assign": "secret", "hex": "secret", "access": "identifier", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
SCOPE = 240


def base_findings(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, (pattern, group, least) in BASE.items():
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def weak_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts; a ``key`` that overlaps a base finding or an endpoint is left out."""
    found = [(kind, m.start(), m.end()) for kind in ("id", "endpoint") for m in WEAK[kind].finditer(text)]
    taken = [x for x in base + found if x[0] != "id"]
    # the ends of what starts before a place, as a running maximum: a key is free if all that starts before its end has ended
    taken.sort(key=lambda x: x[1])
    starts, ends = [x[1] for x in taken], list(itertools.accumulate((x[2] for x in taken), max))
    for m in WEAK["key"].finditer(text):
        before = bisect.bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            found.append(("key", m.start(), m.end()))
    return found


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a distinct document and part: id, text_hash, kind, weak, start, end."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text_hash, text in zip(pdf["id"], pdf["text_hash"], pdf["text"], strict=True):
                base = base_findings(text)
                rows += [(doc_id, text_hash, k, False, s, e) for k, s, e in base]
                rows += [(doc_id, text_hash, k, True, s, e) for k, s, e in weak_candidates(text, base)]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "text_hash", "kind", "weak", "start", "end"])

    some = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where(F.col("text").rlike(_MAY))
    found = some.mapInPandas(run, "id string, text_hash long, kind string, weak boolean, start long, end long").distinct()
    return found.withColumn("id", F.col("id").cast(kind))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts to report: all strong ones, and the weak ones with a complement within ``scope``."""
    roles = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    keyed = found.withColumn("role", roles[F.col("kind")]).withColumn("bin", F.floor(F.col("start") / scope))
    # complements by their last place as well: a part counts in the bin of its start and of its end
    ends = keyed.withColumn("bin", F.explode(F.sequence("bin", F.floor((F.col("end") - 1) / scope))))
    held = ends.groupBy("id", "text_hash", "bin", F.when(F.col("role") == "secret", F.when(F.col("weak"), F.lit("key")).otherwise(F.lit("secret"))).otherwise(F.col("role")).alias("other")).agg(
        F.min("start").alias("first"), F.max("end").alias("last")
    )
    weak = keyed.where("weak").withColumn("near", F.explode(F.sequence(F.col("bin") - 1, F.floor((F.col("end") - 1) / scope) + 1)))
    a, b = weak.alias("a"), held.alias("b")
    fits = (
        ((F.col("a.role") == "identifier") & F.col("b.other").isin("secret", "key"))
        | ((F.col("a.kind") == "key") & F.col("b.other").isin("identifier", "endpoint"))
        | ((F.col("a.role") == "endpoint") & F.col("b.other").isin("secret", "key"))
    )
    within = (F.col("b.first") <= F.col("a.end") + scope) & (F.col("b.last") >= F.col("a.start") - scope)
    kept = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.near") == F.col("b.bin")) & fits & within, "left_semi")
    strong = found.where("not weak")
    return strong.unionByName(kept.select(*found.columns).distinct())


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a distinct document with anything to report: id, text_hash, spans array<struct<start, order, kind, end, weak>> in order."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("order"), "kind", "end", "weak")
    # parts are few beside the texts they were found in; they are kept, so that the texts are searched once
    return linked(saved(parts(docs, id_col, text_col), "parts"), scope).groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def with_spans(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its ``spans`` (empty if there are none)."""
    found = scan(docs, scope, id_col, text_col).withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    rows = docs.withColumn("__text_hash", F.xxhash64(text_col))
    out = rows.join(found, rows[id_col].eqNullSafe(found["__id"]) & (rows["__text_hash"] == found["__hash"]), "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))).drop("__text_hash", "__id", "__hash")


def op4_secrets(spark, sf_dir):
    from keepsake.llm.common import documents

    docs = documents(spark, sf_dir)
    found = scan(docs)
    slim = docs.select("doc_id", F.xxhash64("text").alias("h"))
    rows = slim.join(found, slim["doc_id"].eqNullSafe(found["id"]) & (slim["h"] == found["text_hash"]), "left")
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    base = F.filter(spans, lambda s: ~s["weak"])
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(spans).alias("spans"))
