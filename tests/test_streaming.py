import glob
import json
import os
import random
import time
from datetime import datetime, timedelta

from keepsake.operators import ledger, store
from keepsake.streaming import ingest, keyed, sessions
from test_ledger import claims, no_names, writes


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for half in (0, 1):
        docs.where(f"doc_id % 2 = {half}").write.mode("append").parquet(source)
        ingest.start(spark, source, docs.schema, target, checkpoint).awaitTermination()
    got = {r["content_hash"] for r in spark.read.parquet(target).collect()}
    rows = spark.read.parquet(target).count()
    want = {r["content_hash"] for r in store.first_seen(ingest.screened(docs), "content_hash", "doc_id").collect()}
    assert got == want and rows == len(want)


def test_keyed_writes_equal_the_batch_and_survive_a_replay(spark, tmp_path):
    held = claims(spark, [(1, "The build cache expires after 12 hours", "active", 2), (2, "Team lunch is on Tuesday", "aging", 2)]).cache()
    rows = [
        (11, "The build cache expires after 48 hours.", "fact", 2, False), (12, "team lunch is on tuesday!", "", 2, False), (13, "The office has a garden", "fact", 2, False),
        (14, "the office has a GARDEN", "fact", 2, False), (15, "Always run the linter", "", 2, False), (16, "  ", "fact", 2, False), (17, "Team LUNCH is on Tuesday", "fact", 2, False),
        (18, "The office has a garden.", "fact", 2, False), (19, "the build cache expires after 48 hours", "fact", 2, False), (20, "The office has a garden", "fact", 3, True), (21, None, "fact", 2, False),
    ]
    whole = writes(spark, rows)
    want = sorted((r["id"], r["action"], r["existing"]) for r in ledger.dispositions(whole, held, no_names(spark)).collect())
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    got = lambda: sorted((r["id"], r["action"], r["existing"]) for r in spark.read.parquet(f"{target}/actions").collect())
    for part in (rows[:4], rows[4:]):
        writes(spark, part).coalesce(1).write.mode("append").parquet(source)
        keyed.start(spark, source, whole.schema, held, no_names(spark), target, checkpoint).awaitTermination()
    assert got() == want
    forget_commit(checkpoint)  # a crash after the batch was written, before it was noted
    keyed.start(spark, source, whole.schema, held, no_names(spark), target, checkpoint).awaitTermination()
    assert got() == want


def forget_commit(checkpoint):
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for f in glob.glob(f"{checkpoint}/commits/{last}") + glob.glob(f"{checkpoint}/commits/.{last}.*"):
        os.remove(f)


def test_sessions_from_turns_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    day = datetime(2024, 1, 5, 9)
    turns = []
    for conv in range(6):
        at = day + timedelta(minutes=7 * conv)
        for n in range(14):
            at += timedelta(minutes=45 if n == 8 else rng.randint(0, 6))  # one pause parts each conversation in two
            turns.append((conv, n, at, rng.choice(["user", "assistant", "tool", "system"]), f"turn {n} of {conv}"))
    schema = "conv_id long, turn long, ts timestamp, role string, text string"
    whole = spark.createDataFrame(turns, schema)
    key = lambda df: sorted((r["conv_id"], r["started"], r["ended"], r["text"], tuple(r["spans"]), r["turns"]) for r in df.collect())
    want = key(sessions.grouped(whole))
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    late = sorted(turns, key=lambda t: (t[2] + timedelta(minutes=rng.randint(0, 19)), rng.random()))  # up to 19 minutes after its time
    files = [late[i : i + 12] for i in range(0, len(late), 12)]
    files.append(late[5:9])  # some come twice
    files.append([(99, 0, day + timedelta(days=1), "user", "the end")])
    files.append([(3, 99, day, "user", "far too late")])
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    ran = sessions.start(spark, source, whole.schema, target, checkpoint, delay="20 minutes")
    ran.awaitTermination()
    got = lambda: key(spark.read.parquet(target).where("conv_id <> 99"))
    assert got() == want and len(want) >= 12
    assert sum(op.get("numRowsDroppedByWatermark", 0) for p in ran.recentProgress for op in json.loads(p.json)["stateOperators"]) >= 1
    forget_commit(checkpoint)
    sessions.start(spark, source, whole.schema, target, checkpoint, delay="20 minutes").awaitTermination()
    assert got() == want
