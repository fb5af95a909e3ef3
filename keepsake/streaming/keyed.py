"""Writes as a stream with state for each content: the first write of a content stands, later ones reconfirm it.

The state of a content hash is the claim that holds it, so a write finds its twin whichever batch that came
in, without a look at what was written before. What is new to its key is judged against the store's
claims in the batch it arrives in, and the verdict holds for all twins of that write.

Spark keeps the state by batch and a batch owns one folder of the target, so a batch that is run
again after a crash starts from the state before it and replaces its own rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from keepsake.operators import belief, ledger
from keepsake.sources.scratch import saved

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "id long, place long, first_id long, row string"


class FirstOfContent(StatefulProcessor):
    """For each row of a key the claim that holds the key's content: the first row itself, or the one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "id long")

    def handleInputRows(self, key, rows, timerValues):
        if key[0].startswith("row:"):  # not judged: no state
            for pdf in rows:
                yield pdf.assign(first_id=None)[["id", "place", "first_id", "row"]].astype({"first_id": "Int64"})
            return
        pdf = pd.concat(list(rows)).sort_values(["place", "id"])  # the writes of one content in one batch
        if not self.first.exists():
            self.first.update((int(pdf["id"].iloc[0]),))
        yield pdf.assign(first_id=int(self.first.get()[0]))[["id", "place", "first_id", "row"]]

    def close(self) -> None:
        pass


def firsts(writes: DataFrame) -> DataFrame:
    """A stream of writes, screened, with first_id: the write that its content was first seen in; null where it is not judged."""
    b = ledger.prepared(writes, keep=lambda df, _: df)
    judged = F.col("action").isNull() & ~F.col("quarantine") & (F.col("trust") < 3)
    key = F.when(judged, F.col("content_hash")).otherwise(F.concat(F.lit("row:"), F.col("id").cast("string")))
    rows = b.select(key.alias("key"), "id", "place", F.to_json(F.struct(*b.columns)).alias("row"))
    out = rows.groupBy("key").transformWithStateInPandas(FirstOfContent(), OUT, "Append", "None")
    return out.select("first_id", F.from_json("row", b.schema).alias("r")).select("r.*", "first_id")


def start(spark: SparkSession, source: str, schema: StructType, held: DataFrame, names: DataFrame, target: str, checkpoint: str, pool: int = ledger.POOL):
    """Takes in all files of writes there are and stops; started again, it takes in the new ones.

    ``held`` are the store's claims as they were when the stream was made first. The target has id,
    place, first_id, action and existing, as ``ledger.dispositions`` gives them for all writes together.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    live = held.where(F.col("status").isin("active", "aging")).orderBy(F.desc("updated_at"), "id").limit(pool)

    def take(batch: DataFrame, number: int) -> None:
        rows = saved(batch, "keyed")
        new = rows.where("first_id = id")
        found = belief.adjudicated(new.select("id", "content"), live, names).select(F.col("new_id").alias("first_id"), "old_id", "verdict")
        found.write.mode("overwrite").parquet(f"{target}/verdicts/batch={number}")
        known = spark.read.schema("first_id long, old_id long, verdict string").parquet(f"{target}/verdicts")
        all_rows = rows.join(known.select("first_id", "old_id", "verdict"), "first_id", "left")
        twin = F.col("first_id") != F.col("id")
        action = (
            F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("quarantine"), "quarantined").when(twin | (F.col("verdict") == "duplicate"), "reconfirmed")
            .when(F.col("verdict") == "supersedes", "superseded").otherwise("created")
        )
        existing = F.when((F.col("verdict") == "duplicate") | ((F.col("verdict") == "supersedes") & ~twin), F.col("old_id")).when(twin, F.col("first_id"))
        all_rows.select("id", "place", "first_id", action.alias("action"), existing.alias("existing"), "content").write.mode("overwrite").parquet(f"{target}/actions/batch={number}")

    stream = firsts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    return stream.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
