import hashlib

import random

import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from keepsake.llm.bpe import BytePairs, Cutter, Known, encode, load_ranks, merged, pair_ranks
from keepsake.llm.common import unit_text, units

RANKS = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def test_equals_tiktoken(spark):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    texts = [None, "", " ", "a", "hello world's  naïve\tcafé\n\n end ", "日本語テキスト 😀😀 x", "   \u00a0\u3000 x\x85y", "\x00\x01 !!!???'ll I'LL", "ab" * 300, "zq" * 7 + " 12345 ٣٤", "x\r\n\r\n y", "word " * 5000, "qzxj" * 300 + " end", "x\ny z\n", "\u1c80 \x1c \x1d\x85 a\x1fb", "a " * 40]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "hello hello", None), (1, "dup", "c"), (1, "dup", "c")]
    pairs = BytePairs(RANKS, P.PATTERN)
    for bound in (3, 200_000):
        df = encode(spark.createDataFrame(rows, "doc_id long, text string, piece string"), pairs, dictionary=bound)
        got = df.withColumn("back", pairs.decoded(df["ids"])).collect()
        assert len(got) == len(rows)
        for r in got:
            assert list(r["ids"]) == library.encode_ordinary(r["text"] or ""), r["text"]
            assert bytes(r["back"]) == (r["text"] or "").encode()


def test_query_over_small_table(spark):
    from keepsake.llm.bpe import op6_bpe

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op6_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_heap_equals_tiktoken():
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    letters = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(30_000))
    for piece in (letters, "a" * 5000, "ab" * 777, "x", "日本" * 400):
        assert merged(piece.encode(), RANKS) == library.encode_ordinary(piece)


def test_empty_table(spark):
    pairs = BytePairs(RANKS, P.PATTERN)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), pairs).collect() == []


def test_any_pattern(spark):
    pattern = r"[a-z ]+|[^a-z ]+"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    texts = ["hello there  big world", "It IS 5 o'clock", "x"]
    got = encode(spark.createDataFrame([(t,) for t in texts], "text string"), BytePairs(RANKS, pattern), at_spaces=False).collect()
    assert {r["text"]: list(r["ids"]) for r in got} == {t: library.encode_ordinary(t) for t in texts}


def test_pairs_of_neighbours():
    ranks = RANKS | {b"qzxjv": max(RANKS.values()) + 1}  # no merge leads to it
    owners, values, places, codes = pair_ranks(ranks)
    there = 0
    for k, v in ranks.items():
        for a, b in ((ranks.get(k[:i]), ranks.get(k[i:])) for i in range(1, len(k))):
            if a is not None and b is not None:
                at = places[a] + codes[b]
                assert (owners[at], values[at]) == (a, v)
                there += 1
    assert there == sum(x is not None for x in owners)
    assert pair_ranks({bytes([x]): x for x in range(256)})[:2] == ([], [])


def test_token_that_no_merge_makes(spark):
    ranks = {bytes([x]): x for x in range(256)} | {b"ab": 256, b"xyz": 257, b"abab": 258}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["xyz", "xyzxyz abab", "xyz", "ababab é", None]
    got = encode(spark.createDataFrame([(t,) for t in texts], "text string"), BytePairs(ranks, P.PATTERN)).collect()
    assert [list(r["ids"]) for r in got] == [library.encode_ordinary(r["text"] or "") for r in got]


def test_plans_do_not_spell_out_the_rank_map(spark, capsys):
    pairs = BytePairs(RANKS, P.PATTERN)
    encoded = encode(spark.createDataFrame([("hello world qzxj",)], "text string"), pairs)
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 27))
    encoded.explain()
    plan = capsys.readouterr().out
    # no row holds the rank map either: the subquery stands where its column was referred to
    assert "ubquery" in plan and "__ranks" not in plan and len(plan) < 200_000


def test_overlapping_pairs_of_one_rank(spark):
    ranks = {bytes([x]): x for x in range(256)} | {b"ab": 256, b"ba": 257, b"aba": 258, b"aa": 259, b"abaa": 260, b"bb": 261}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(5)
    texts = ["".join(draw.choices("ab", k=draw.randint(1, 40))) for _ in range(400)]
    for bound in (1, 1000):
        got = encode(spark.createDataFrame([(t,) for t in texts + texts[:100]], "text string"), BytePairs(ranks, P.PATTERN), dictionary=bound).collect()
        assert [list(r["ids"]) for r in got] == [library.encode_ordinary(r["text"]) for r in got]


def test_fold_does_not_look_its_types_up_at_every_merge(spark, capsys):
    pairs = BytePairs(RANKS, P.PATTERN)
    pairs.with_folds(spark.createDataFrame([("hello",)], "piece string"), "ids", lambda fold: fold(F.col("piece"))).explain(True)
    plan = capsys.readouterr().out
    # an item of an array that is written out, or the concatenation of arrays, costs more than the merge itself
    assert "aggregate(" in plan and "array_position(" not in plan and "concat(" not in plan and "transform(array(" not in plan


def test_pieces_of_units_equal_those_of_the_pattern():
    draw = random.Random(7)
    parts = ["word", "É", "ß", "日本", "'s", "'ll", "'", ".", ",", "...", "***", "_", "9", "٣", "\u0301", "\u00a0", "\u3000", "\n", " ", " ", "—", "…", "\t"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 12))) for _ in range(4000)]
    cutter = Cutter(Known([]), RANKS, P.PATTERN, True)
    for t in texts:
        keys = units(t)
        pieces, sizes = cutter._pieces(keys)
        assert pieces == cutter.pattern.findall(t) and list(sizes) == [len(cutter.pattern.findall(unit_text(k))) for k in keys]


def test_nothing_is_kept_between_slices():
    known = Known([{"hashes": b"", "sizes": b"", "ids": b""}])
    cutter = Cutter(known, RANKS, P.PATTERN, True)
    before = set(vars(cutter))
    out = cutter.cut(pa.array(["some words, and others", None, "", "q" * 300 + " end"])).to_pylist()
    assert not isinstance(cutter, dict) and set(vars(cutter)) == before  # no memo grows with the texts
    assert [r["rare"] for r in out] == [["some", " words", ",", " and", " others"], [], [], [" end"]]
    assert out[3]["runs"] == [merged(b"q" * 300, RANKS), []] and out[1]["runs"] == [[]]
