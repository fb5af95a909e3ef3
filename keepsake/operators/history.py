"""Claims as they were: the journal folded backwards.

Every change writes the values that it replaces into its journal row (``undo``). So the
state of a claim at a version is what it is now, with each column that changed since set back to the value that the first
change after that version found. Claims that were made later are not there. Nothing else is kept for it, and
any version can be asked for; vectors and hashes are derived and made anew from the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keepsake.functions import text as X
from keepsake.operators import ledger

#: Columns that a change can set, beside the derived ones.
FIELDS = ("status", "superseded_by", "content", "type", "importance", "trust", "confidence", "last_confirmed_at", "updated_at")
#: Journal rows that change no claim.
SILENT = ("inject", "export", "counter", "reembed", "consolidate")
#: Of changes in one version and at one time a claim is made first, then confirmed, then retired.
_ORDER = ("create", "import", "quarantine", "edit", "reconfirm", "supersede")


def ops_for(ops: DataFrame, ids: DataFrame) -> DataFrame:
    """The journal rows of some claims (id), with place: their order for each claim."""
    own = ops.join(ids.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("memory_id").orderBy("version", "ts", _rank(), "op", "payload")))


def _rank() -> Column:
    kinds = F.array(*map(F.lit, _ORDER))
    at = F.array_position(kinds, F.col("op"))
    return F.when(at > 0, at).otherwise(len(_ORDER) + 1)


def as_of(memories: DataFrame, ops: DataFrame, points: DataFrame) -> DataFrame:
    """The rows of ``memories`` as they were, one for each point (id, version) at which the claim was there, with the column version.

    ``ops`` is the journal (op, memory_id, payload, ts, undo, version). A point at or after the last version gives the row as it is.
    """
    later = ops.where(~F.col("op").isin(*SILENT) & F.col("memory_id").isNotNull()).select(F.col("memory_id").alias("id"), "op", "undo", "ts", F.col("version").alias("v"), _rank().alias("rank"))
    hit = points.select("id", "version").distinct().join(later, "id").where(F.col("v") > F.col("version"))
    made = hit.groupBy("id", "version").agg(F.bool_or(F.col("op").isin("create", "import")).alias("unborn"))
    said = hit.select("id", "version", F.struct("v", "ts", "rank", "op", "undo").alias("o"), F.explode(F.from_json("undo", "map<string,string>")).alias("field", "value"))
    first = said.select("id", "version", "field", "o", F.struct("value").alias("value")).groupBy("id", "version").pivot("field", list(FIELDS)).agg(F.min_by("value", "o"))
    back = first.select("id", "version", *[F.col(f).alias(f"was_{f}") for f in FIELDS])
    rows = points.select("id", "version").distinct().join(memories, "id").join(back, ["id", "version"], "left").join(made, ["id", "version"], "left").where(~F.coalesce("unborn", F.lit(False)))
    cols = {}
    for f in FIELDS:
        if f in memories.columns:
            was = F.col(f"was_{f}")
            cols[f] = F.when(was.isNotNull(), was["value"].cast(memories.schema[f].dataType)).otherwise(F.col(f))
    if "content_hash" in memories.columns:
        cols["content_hash"] = X.content_hash(cols["content"])
    if "embedding" in memories.columns:
        cols["embedding"] = F.when(F.col("was_content").isNotNull(), F.lit(None)).otherwise(F.col("embedding"))
    return rows.withColumns(cols).select("version", *memories.columns)


def snapshot(memories: DataFrame, ops: DataFrame, version: int) -> DataFrame:
    """All claims as they were at a version."""
    return as_of(memories, ops, memories.select("id", F.lit(version).alias("version"))).drop("version")


def undone(memories: DataFrame, ops: DataFrame, version: int, now: Column) -> ledger.Change:
    """Sets every claim that changed after ``version`` back to what it was; claims made since are tombstoned, for rows are never deleted.

    The change is journaled like any other, so it can be undone in turn.
    """
    touched = ops.where((F.col("version") > version) & ~F.col("op").isin(*SILENT) & F.col("memory_id").isNotNull()).select(F.col("memory_id").alias("id")).distinct()
    was = as_of(memories, ops, touched.withColumn("version", F.lit(version)))
    fields = [f for f in FIELDS if f in memories.columns]
    back = touched.join(was.select("id", F.lit(True).alias("there"), *[F.col(f).alias(f"to_{f}") for f in fields]), "id", "left")
    there = F.coalesce(F.col("x.there"), F.lit(False))
    sets = {f: F.when(there, F.col(f"x.to_{f}")).otherwise(F.lit("tombstoned") if f == "status" else F.col(f)) for f in fields}
    return ledger.changed(memories, back, sets, "restore", {"undone_to": F.lit(version)}, now, touch=False)


def dossier(memories: DataFrame, ops: DataFrame, flags: DataFrame, newer: DataFrame, older: DataFrame, ids: DataFrame) -> DataFrame:
    """All there is to show of some claims (id), as rows: id, part (record, newer, older, op, flag), place and value.

    ``newer`` and ``older`` are the chains (start, hop, id). Rows instead of arrays, so that no claim's journal must fit in one.
    """
    wanted = ids.select("id").distinct()
    shown = [c for c in ("content", "type", "status", "trust", "importance", "confidence", "updated_at", "superseded_by") if c in memories.columns]
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))).alias("value")) for i, c in enumerate(shown)])
    record = memories.join(wanted, "id", "left_semi").select("id", F.lit("record").alias("part"), F.inline(pairs))
    chain = lambda df, part: df.join(wanted.withColumnRenamed("id", "start"), "start", "left_semi").select(F.col("start").alias("id"), F.lit(part).alias("part"), F.col("hop").cast("int").alias("place"), F.col("id").cast("string").alias("value"))
    own = ops_for(ops, wanted).select(F.col("memory_id").alias("id"), F.lit("op").alias("part"), "place", F.col("op").alias("value"))
    marks = flags.join(wanted.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi")
    state = F.when(F.col("resolved_at").isNull(), "open").otherwise("resolved")
    marks = marks.select(F.col("memory_id").alias("id"), F.lit("flag").alias("part"), F.row_number().over(Window.partitionBy("memory_id").orderBy("flag_id")).alias("place"), F.concat_ws(": ", "kind", "detail", state).alias("value"))
    return record.unionByName(chain(newer, "newer")).unionByName(chain(older, "older")).unionByName(own).unionByName(marks)
