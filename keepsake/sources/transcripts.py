"""Session transcripts as rows: found, parsed, rendered with marked untrusted spans, and cut into chunks.

A transcript is a file of JSON lines. It is read whole, one row a session, because its lines are
ordered; sessions are spread over the tasks. Lines that do not parse are skipped. What tools
returned is wrapped in a pair of marks and kept apart as an untrusted span.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import text as X

#: Marks around untrusted text, the bytes a span keeps, and the size and overlap of chunks.
OPEN, CLOSE = "[untrusted-output]", "[/untrusted-output]"
SPAN_BYTES, CHUNK_BYTES, OVERLAP_BYTES = 1200, 24_000, 1500
_TRUNCATED = " …[truncated]"


def discovered(spark: SparkSession, folder: str, since: datetime | None = None) -> DataFrame:
    """path, modified and raw of the session files under ``folder``/projects, changed since then, newest first."""
    reader = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true")
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.text(f"{folder}/projects", wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("raw")).orderBy(F.desc("modified"), "path")


def instruction_files(spark: SparkSession, paths: list[str], most: int = 256 * 1024) -> DataFrame:
    """path and text of instruction files that are not empty and smaller than ``most`` bytes."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where((F.octet_length("text") < most) & (X.trim_space(F.col("text")) != ""))


def base_trust(path: Column, names: list[str]) -> Column:
    """Tier 1 for what users write themselves (files of the given names), else tier 2."""
    return F.when(F.upper(F.regexp_extract(path, r"[^/\\]*\z", 0)).isin(*[n.upper() for n in names]), 1).otherwise(2)


def _string(v: Column, path: str) -> Column:
    """The string at ``path``; null if there is something else."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def span_of(text: Column) -> Column:
    """An untrusted text as it is kept: the first 1200 bytes, in whole characters."""
    return X.let(text, lambda t: X.cut_bytes(t, SPAN_BYTES, _TRUNCATED))


def _tool_text(block: Column) -> Column:
    """What a tool returned: a string, the text blocks of a list, or else the JSON as it stands."""
    kind = F.schema_of_variant(F.try_variant_get(block, "$.content", "variant"))
    texts = F.filter(F.transform(_list(block, "$.content"), lambda b: F.when(_string(b, "$.type") == "text", _string(b, "$.text"))), lambda t: t.isNotNull() & (t != ""))
    return F.when(kind == "STRING", _string(block, "$.content")).when(kind.startswith("ARRAY"), F.array_join(texts, "\n")).when(kind.isNotNull() & (kind != "VOID"), F.try_variant_get(block, "$.content", "string"))


def turns(sessions: DataFrame) -> DataFrame:
    """path, line, session_id, role, text and spans of the turns of user and assistant that hold anything."""
    lines = sessions.select("path", F.posexplode(F.split("raw", "\r?\n")).alias("line", "json")).where("json <> ''")
    v = F.col("v")
    parsed = lines.withColumn("v", F.try_parse_json("json")).where("v is not null")

    def block_parts(b):
        kind = _string(b, "$.type")
        span = span_of(_tool_text(b))
        name = _string(b, "$.name")
        return (
            F.when(kind == "text", F.struct(F.concat(F.coalesce(_string(b, "$.text"), F.lit("")), F.lit("\n")).alias("text"), F.lit(None).cast("string").alias("span")))
            .when((kind == "tool_result") & (span != ""), F.struct(F.concat(F.lit(OPEN), span, F.lit(CLOSE + "\n")).alias("text"), span.alias("span")))
            .when((kind == "tool_use") & (name != ""), F.struct(F.concat(F.lit("[called tool: "), name, F.lit("]\n")).alias("text"), F.lit(None).cast("string").alias("span")))
        )

    plain = _string(v, "$.message.content")
    blocks = F.filter(F.transform(_list(v, "$.message.content"), block_parts), lambda p: p.isNotNull())
    said = F.coalesce(F.when(_string(v, "$.message.role") != "", _string(v, "$.message.role")), _string(v, "$.type"))
    rows = parsed.select("path", "line", _string(v, "$.sessionId").alias("session_id"), said.alias("role"), plain.alias("plain"), F.when(plain.isNull(), blocks).alias("parts"))
    text = F.coalesce("plain", F.array_join(F.transform("parts", lambda p: p["text"]), ""), F.lit(""))
    spans = F.coalesce(F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()), F.array().cast("array<string>"))
    return rows.select("path", "line", "session_id", "role", X.trim_space(text).alias("text"), spans.alias("spans"))


def rendered(sessions: DataFrame) -> DataFrame:
    """path, session_id, text, spans, turns and bytes of each session; the id is the file's name where no line has one."""
    all_turns = turns(sessions)
    own = all_turns.where(F.col("session_id") != "").groupBy("path").agg(F.min_by("session_id", "line").alias("session_id"))
    said = all_turns.where(F.col("role").isin("user", "assistant") & ((F.col("text") != "") | (F.size("spans") > 0)))
    listed = said.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "role", "text", "spans"))).alias("t"))
    out = sessions.select("path").join(listed, "path", "left").join(own, "path", "left")
    text = F.coalesce(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"], F.lit("\n\n"))), ""), F.lit(""))
    name = F.regexp_replace(F.regexp_extract("path", r"[^/\\]*\z", 0), r"\.jsonl\z", "")
    return out.select("path", F.coalesce("session_id", name).alias("session_id"), text.alias("text"), F.coalesce(F.flatten(F.transform("t", lambda x: x["spans"])), F.array().cast("array<string>")).alias("spans"), F.coalesce(F.size("t"), F.lit(0)).alias("turns"), F.octet_length(text).alias("bytes"))


def plain(text: Column, untrusted: Column) -> Column:
    """A text that is no transcript: all of it is one span if it is not trusted."""
    return F.struct(F.when(untrusted, F.concat(F.lit(OPEN), text, F.lit(CLOSE))).otherwise(text).alias("text"), F.when(untrusted, F.array(text)).otherwise(F.array().cast("array<string>")).alias("spans"))


def spans_in(text: Column) -> Column:
    """The spans between marks that stand in a text already."""
    return F.regexp_extract_all(text, F.lit(r"(?s)\[untrusted-output\](.*?)\[/untrusted-output\]"), F.lit(1))


def chunk_list(text: str, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[str]:
    """Pieces of at most ``size`` bytes that end after the last blank line they hold, each begun ``overlap`` bytes before the end of the one before.

    Every piece begins after the one before, also where its last blank line stands early, and cuts
    never part a character.
    """
    raw, out, at = text.encode(), [], 0
    while len(raw) - at > size:
        cut = raw.rfind(b"\n\n", at, at + size)
        end = cut if cut > at else at + size
        while end > at + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode())
        at = max(end - overlap, at + 1)
        while raw[at] & 0xC0 == 0x80:
            at += 1
    return [*out, raw[at:].decode()]


def chunks(sessions: DataFrame, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """Each session's columns with chunk (its place) and piece."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([chunk_list(t or "", size, overlap) for t in texts])

    return sessions.select("*", F.posexplode(run(F.col("text"))).alias("chunk", "piece"))
