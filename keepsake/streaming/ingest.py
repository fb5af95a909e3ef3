"""Claims as a stream: screened, deduplicated by content against the store and appended to it.

Each micro-batch is compared with what the store holds, so a replayed batch adds nothing: the
result of a stream is that of one batch over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keepsake.functions import text as X
from keepsake.operators import digest, store

STORED = "doc_id long, text string, content_hash string, disposition string, bucket int"
#: The store is kept in so many folders by content hash; a batch reads only those that its own rows fall into.
BUCKETS = 64


def bucket(content_hash):
    return F.pmod(F.xxhash64(content_hash), F.lit(BUCKETS)).cast("int")


def screened(docs: DataFrame) -> DataFrame:
    """What a digest would keep of the documents as claims of their own."""
    rows = docs.select("doc_id", F.col("doc_id").alias("candidate_id"), F.col("text").alias("content"), F.lit("fact").alias("type"), F.lit(3).alias("importance"), F.lit(False).alias("tainted"))
    kept = digest.screened(rows).where("disposition <> 'drop'")
    return kept.select("doc_id", F.col("content").alias("text"), X.content_hash(F.col("content")).alias("content_hash"), "disposition").withColumn("bucket", bucket("content_hash"))


def append(batch: DataFrame, target: str) -> None:
    """Adds what is new: of equal contents the first, and nothing that the store holds."""
    spark = batch.sparkSession
    rows = store.first_seen(screened(batch), "content_hash", "doc_id").persist()
    try:
        buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        held = spark.read.schema(STORED).parquet(target).where(F.col("bucket").isin(*buckets)).select("content_hash")
        rows.join(held, "content_hash", "left_anti").select(*[c.split()[0] for c in STORED.split(", ")]).write.mode("append").partitionBy("bucket").parquet(target)
    finally:
        rows.unpersist()


def start(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str):
    """A query that takes in all files there are and stops; started again, it takes in the new ones."""
    spark.createDataFrame([], STORED).write.mode("append").parquet(target)
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, _: append(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_sessions(spark: SparkSession, source: str, target: str, checkpoint: str, backend, least_bytes: int = 2000):
    """Digests finished transcripts as their files arrive: rendered, cut into chunks, proposed by ``backend``, screened and appended.

    Sessions of fewer than ``least_bytes`` bytes are left out. Files are whole sessions, so a batch needs no state.
    A batch owns one folder of the target and replaces it, so one that is run again after a crash adds nothing.
    """
    from keepsake.sources import transcripts

    def take(batch: DataFrame, number: int) -> None:
        sessions = transcripts.rendered(batch.select("path", F.col("value").alias("raw"))).where(F.col("bytes") >= least_bytes)
        rows = digest.parsed(digest.answers(transcripts.chunks(sessions).select("path", "chunk", "piece"), backend))
        keyed = rows.withColumn("candidate_id", F.concat_ws(":", "path", "chunk", "place"))
        spans = sessions.select("path", F.explode("spans").alias("span"))
        done = digest.screened(keyed, digest.lifted(keyed, spans)).where("disposition <> 'drop'")
        done.select("candidate_id", "content", "type", "importance", "trust", "disposition", "reason").write.mode("overwrite").parquet(f"{target}/batch={number}")

    files = spark.readStream.option("pathGlobFilter", "*.jsonl").text(source, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_since(ops: DataFrame, version: int) -> DataFrame:
    """Ids whose claims changed after a version: what a derived table (postings, vectors) has to take in anew."""
    return ops.where((F.col("version") > version) & ~F.col("op").isin("inject", "export", "counter")).select(F.col("memory_id").alias("id")).where("id is not null").distinct()


def start_writes(spark: SparkSession, source: str, schema: StructType, store_path: str, checkpoint: str, now):
    """Applies files of writes to a ledger (tables memories, flags and names), a commit a batch.

    State is the ledger's snapshot: what a batch reconfirms or supersedes is judged against the last
    one. The number of the last batch is part of each commit, so a batch that is run again after a
    crash does nothing.
    """
    from keepsake.operators import ledger

    def take(batch: DataFrame, number: int) -> None:
        held = ledger.Ledger(spark, store_path)
        try:
            last = held.table("batches").agg(F.max("number").alias("n")).first()["n"]
        except KeyError:
            last = None
        if last is not None and last >= number:
            return
        seen = held.version()
        memories, flags = held.table("memories"), held.table("flags")
        done = ledger.saved(ledger.dispositions(batch, memories, held.table("names")), "done")
        memories, flags, ops = ledger.applied(done, memories, flags, now)
        held.commit({"memories": memories, "flags": flags, "batches": spark.createDataFrame([(number,)], "number long")}, ops, seen)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
