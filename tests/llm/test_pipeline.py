import random
import time

import numpy as np
import pandas as pd
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from keepsake.llm import bpe, quality

SECRET = "pass" + "word=abcdefghijkl0123"


def documents(spark):
    rng = random.Random(8)
    good = [" ".join(f"word{rng.randrange(997)}" for _ in range(60)) for _ in range(60)]
    item = " ".join(f"item{k}" for k in range(25))
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100, good[3]), (101, good[3] + " more"), (102, good[4] + " " + item), (103, f"{good[5]} {' '.join(good[40].split()[:30])} {SECRET} end"), (104, None), (105, ""), (None, good[6] + " x y z x y z x y z x y z x y z x y z"), (20, good[20])]
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), good, item


def test_stages(spark, tmp_path):
    docs, good, item = documents(spark)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    sf = f"file://{tmp_path}"
    one = stages["n-gram jaccard join"](spark, docs, sf)
    assert one.columns == docs.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in one.collect())
    assert ids == sorted([-1, *range(60), 102, 103, 104, 105])
    clean = stages["benchmark decontamination"](spark, one, sf)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in clean.collect()) == sorted([-1, *range(60), 103, 104, 105])
    masked = {r["doc_id"]: r for r in stages["secret scans"](spark, clean, sf).collect()}
    text = f"{good[5]} {' '.join(good[40].split()[:30])} {corpus_pipeline.MASK} end"
    assert masked[103]["text"] == text and masked[103]["n_chars"] == len(text)
    assert masked[104]["text"] is None and masked[7]["text"] == good[7] and len(masked) == clean.count()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in stages["byte-level bpe"](spark, stages["secret scans"](spark, clean, sf), sf).collect():
        assert list(r["ids"]) == library.encode_ordinary(masked[r["doc_id"]]["text"] or "") and r["round_trip"]


def test_run_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    kept = {r["doc_id"] for r in rows}
    assert len(kept) == len(rows) and kept < docs and all(r["round_trip"] for r in rows)
    assert len(kept & bad) <= 0.1 * len(bad) and len(kept) > 0.4 * len(docs)


def test_rows_that_share_an_id_and_null_ids(spark, tmp_path):
    rng = random.Random(9)
    good = [" ".join(f"word{rng.randrange(997)}" for _ in range(60)) for _ in range(12)]
    item = " ".join(f"item{k}" for k in range(25))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    sf = f"file://{tmp_path}"

    def stage(name, rows):
        docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, docs, sf).collect()), key=repr)

    leak = good[0] + " " + item
    # a shared id loses its leaking row only, and a null id does not save one
    clean = [(7, good[1]), (7, good[2]), (None, good[3]), (None, None), (8, good[4])]
    assert stage("benchmark decontamination", [*clean, (7, leak), (None, leak + " x"), (9, leak)]) == sorted(clean, key=repr)
    # of near copies one row with an id and one without stay
    rows = [(5, good[5]), (7, good[5] + " more"), (7, good[6]), (None, good[5] + " end"), (None, good[7]), (None, good[7] + " more"), (None, good[7]), (None, None), (None, None), (-3, good[8]), (2, good[8] + " x"), (10, good[8])]
    kept = stage("n-gram jaccard join", [*rows, (4, good[9]), (4, good[9] + " more"), (4, good[9] + " end"), (4, good[9]), (6, None), (6, None)])
    one = [r for r in kept if (r[1] or "").startswith((good[7], good[9]))]
    assert [r[0] for r in one] in ([4, None], [None, 4])
    assert [r for r in kept if r not in one] == sorted([(5, good[5]), (7, good[6]), (None, good[5] + " end"), (None, None), (None, None), (-3, good[8]), (6, None)], key=repr)


def most_held(spark):
    """MB of the largest of the Python workers that Spark keeps."""

    def run(batches):
        for _ in batches:
            time.sleep(0.5)  # so that each task has a worker of its own
        with open("/proc/self/status") as f:
            yield pd.DataFrame({"mb": [int(line.split()[1]) / 1024 for line in f if line.startswith("RssAnon")]})

    return max(r["mb"] for r in spark.range(0, 4, 1, 4).mapInPandas(run, "mb double").collect())


def test_workers_give_back_what_a_stage_held(spark):
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(150_000)]
    texts = [" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts]], "text string").coalesce(1)
    most_held(spark)
    before = most_held(spark)
    contexts = np.zeros((quality.ROWS, quality.DIMS), np.float32)
    assert quality.scored(docs, {"contexts": contexts, "share": 0.25}).where("score = 0.25").count() == 300
    net = quality.fit_network(np.random.default_rng(1).normal(size=(40, 3 * quality.DIMS + 1)), np.arange(40) % 2, epochs=1)
    assert quality.scored(docs, {"contexts": contexts, "net": net}).where("score between 0 and 1").count() == 300
    assert most_held(spark) < before + 40
    pairs = bpe.BytePairs(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    assert bpe.encode(docs, pairs).where("size(ids) > 1000").count() == 300
    assert most_held(spark) < before + 40
