"""The file sources against the files, and the import sink with its two ends."""

import os

import pytest
from pyspark.sql import functions as F

from keepsake.sources import files, transcripts


def put(path, text, at=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    if at is not None:
        os.utime(path, (at, at))
    return path


def test_found_by_kind(spark, tmp_path):
    files.register(spark)
    root, home = str(tmp_path / "root"), str(tmp_path / "home")
    line = '{"type":"user","sessionId":"s","message":{"role":"user","content":"hello é"}}'
    old, new = put(f"{root}/projects/a/1.jsonl", line, 1_000_000_000), put(f"{root}/projects/b/2.jsonl", line + "\n" + line, 1_700_000_000)
    put(f"{root}/projects/a/deep/3.jsonl", line)
    put(f"{root}/projects/a/notes.txt", "x")
    memory = put(f"{root}/projects/a/memory/NOTES.md", "keep this")
    put(f"{root}/projects/b/memory/NOTES.md", "")
    put(f"{root}/projects/b/memory/OTHER.md", "x")
    rules, more = put(f"{root}/RULES.md", "be kind"), put(f"{home}/RULES.md", " \n")
    put(f"{home}/HOUSE.md", "x" * files.LARGEST)
    read = lambda **o: spark.read.format("transcripts").options(path=root, memory="NOTES.md", instructions="RULES.md,HOUSE.md", also=home, **o).load()
    got = sorted((r["path"], r["kind"], r["raw"]) for r in read().collect())
    assert got == sorted([(old, "session", line), (new, "session", line + "\n" + line), (memory, "memory", "keep this"), (rules, "instructions", "be kind")])
    assert more not in {g[0] for g in got}
    late = read(kinds="session", since="2010-01-01")
    assert [(r["path"], r["modified"].year) for r in late.collect()] == [(new, 2023)]
    # the same text as the reader of Spark's own gives
    ours = transcripts.rendered(read(kinds="session").select("path", "raw")).select("text").collect()
    theirs = transcripts.rendered(transcripts.discovered(spark, root).where(~F.col("path").contains("/deep/")).select("path", "raw")).select("text").collect()
    assert sorted(r["text"] for r in ours) == sorted(r["text"] for r in theirs)
    assert spark.read.format("transcripts").option("path", f"{root}/none").load().count() == 0


def test_files_are_spread_over_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES", 2)
    for i in range(5):
        put(str(tmp_path / f"projects/p/{i}.jsonl"), "x")
    parts = files.TranscriptReader({"path": str(tmp_path)}).partitions()
    assert [len(p.files) for p in parts] == [2, 2, 1]


def test_an_import_is_whole_or_nothing(spark, tmp_path):
    files.register(spark)
    target = str(tmp_path / "claims")
    rows = spark.range(1000).repartition(4).select(F.col("id"), F.concat(F.lit("claim "), "id").alias("content"), F.lit(None).cast("string").alias("error"))
    rows.write.format("claims").mode("append").save(target)
    held = lambda: spark.read.parquet(f"{target}/import-*")
    assert held().count() == 1000 and held().columns == ["id", "content"]
    bad = rows.withColumn("error", F.when(F.col("id") == 777, "bad type"))
    with pytest.raises(Exception, match="bad type"):
        bad.write.format("claims").mode("append").save(target)
    assert held().count() == 1000 and [d for d in os.listdir(target) if d.startswith(".job")] == []
    rows.limit(10).write.format("claims").mode("append").save(target)
    assert held().count() == 1010
    rows.limit(0).write.format("claims").mode("append").save(target)
    assert held().count() == 1010 and len(os.listdir(target)) == 2
    with pytest.raises(Exception, match="never deleted"):
        rows.write.format("claims").mode("overwrite").save(target)
