"""A corpus-cleaning pipeline over ``documents`` built from the operators of ``keepsake.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of ``documents``; between stages the rows are written as Parquet in the
shared folder and read again, so a lost executor costs no earlier stage.

Decisions hold for a row, not for all rows of its id: rows are told apart by id and hash of text,
null ids included. Rows with a null id or text pass every stage that has no reason to drop them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.llm import bpe, decontaminate, jaccard, quality, secrets
from keepsake.llm.common import saved, table

#: Documents that score lower are rejected.
LEAST_QUALITY = 0.5
#: What stands for a secret.
MASK = "[secret]"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, score_col="__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __key, never null and equal only for rows of one id and text; keys sort by id, null ids last."""
    number = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    # the sign bit is turned, so that hexadecimal text sorts as the numbers do
    name = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0") if number else F.col("doc_id").cast("string")
    text = F.when(F.col("text").isNull(), "null").otherwise(F.hex(F.xxhash64("text")))
    return docs.withColumn("__key", F.concat_ws(":", F.coalesce(name, F.lit("~")), text))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest id, and one of its rows with a null id; of rows that share an id and text, one.

    Rows with a null id and no words have nothing to be compared by and stay.
    """
    rows = keyed(docs)
    groups = saved(jaccard.near_duplicates(rows, id_col="__key"), "groups")
    null = F.col("__key").startswith("~")
    nulls = groups.where(null)
    first = nulls.groupBy("component_id").agg(F.min("__key").alias("__key")).select("__key")
    lost = groups.where(~null & (F.col("__key") != F.col("component_id"))).select("__key").unionByName(nulls.select("__key").join(first, "__key", "left_anti")).distinct()
    kept = rows.join(lost, "__key", "left_anti")
    again = saved(groups.where(~null | (F.col("n_shingles") > 0)).groupBy("__key").count().where("count > 1").select("__key"), "again")
    once = kept.join(again, "__key", "left_anti")
    return once.unionByName(kept.join(again, "__key", "left_semi").dropDuplicates(["__key"])).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold enough of a benchmark item."""
    rows = keyed(docs)
    leaks = saved(decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="__key").select("__key").distinct(), "leaks")
    return rows.join(leaks, "__key", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span of a text becomes MASK; n_chars follows."""
    found = secrets.with_spans(docs)
    # overlapping spans are masked as one: a span that starts before the last end only moves that end on
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s, x):
        fresh = x["start"] >= s["at"]
        between = F.when(fresh, F.concat(F.substr("text", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(MASK))).otherwise(F.lit(""))
        return F.struct(F.concat(s["out"], between).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    masked = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substr("text", (s["at"] + 1).cast("int"))))
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether the ids decode to the very text."""
    import public_tokenizers

    pairs = bpe.BytePairs(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), pairs)
    same = pairs.decoded(F.col("ids")) == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("byte-level bpe", encode),
]

#: No stage but the fourth can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
