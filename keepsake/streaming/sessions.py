"""Sessions out of a stream of turns: event time, a watermark, and one row when a session is over.

Turns come in any order. A session is what has one conversation and no pause longer than ``gap``; it
is over, and rendered, once the watermark (the latest turn seen, less ``delay``) passes the end of its
pause. Turns may come as late as ``delay`` after later ones and still find their place. A turn that is
later than that is left out if its session was over, and Spark counts it (``numRowsDroppedByWatermark``);
turns that come twice are taken once. Within a session turns stand in the order of their number, then their time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keepsake.operators import digest
from keepsake.sources import transcripts


def grouped(turns: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """conv_id, started, ended, text, spans, turns and bytes of each session, from turns (conv_id, turn, ts, role, text).

    Turns of tools are untrusted spans; users' and assistants' turns are said as they stand; others are left out.
    """
    tool = F.col("role") == "tool"
    own = turns.where(F.col("role").isin("user", "assistant", "tool") & F.col("text").isNotNull() & F.col("ts").isNotNull())
    shown = transcripts.plain(F.when(tool, transcripts.span_of(F.col("text"))).otherwise(F.col("text")), tool)
    turn = F.struct("turn", "ts", "role", shown["text"].alias("text"), shown["spans"].alias("spans"))
    # a session is what one row has to hold, as a file of a transcript is; turns that are alike are one
    listed = own.groupBy("conv_id", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set(turn)).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"], F.lit("\n\n"))), "")
    return listed.select("conv_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), text.alias("text"), F.flatten(F.transform("t", lambda x: x["spans"])).alias("spans"), F.size("t").alias("turns"), F.octet_length(text).alias("bytes"))


def start(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, gap: str = "30 minutes", delay: str = "10 minutes", least_bytes: int = 0, files: int = 1):
    """Writes sessions of at least ``least_bytes`` bytes as they end; a batch owns its folder, so one that runs again adds nothing."""
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).withWatermark("ts", delay)

    def take(batch: DataFrame, number: int) -> None:
        batch.where(F.col("bytes") >= least_bytes).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return grouped(turns, gap).writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digested(sessions: DataFrame, backend) -> DataFrame:
    """What ``backend`` proposes of each session, screened; spans that a candidate was lifted from taint it."""
    own = sessions.withColumn("path", F.concat_ws("@", F.col("conv_id").cast("string"), F.col("started").cast("string")))
    rows = digest.parsed(digest.answers(transcripts.chunks(own).select("path", "chunk", "piece"), backend)).withColumn("candidate_id", F.concat_ws(":", "path", "chunk", "place"))
    return digest.screened(rows, digest.lifted(rows, own.select("path", F.explode("spans").alias("span"))))
