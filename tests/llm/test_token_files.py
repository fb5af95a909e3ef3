import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keepsake.llm.common import scratch
from keepsake.llm.token_files import Encoder, pack, read_tokens, token_digests, unpack, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300))
def test_pack_round_trip(ids):
    a = np.array(ids, dtype=np.uint64)
    assert np.array_equal(unpack(pack(a)), a)


def test_pack_counts():
    assert len(pack(np.zeros(120, np.uint64))) == 2
    assert len(pack(np.full(3, 2**20 - 1, np.uint64))) == 1
    assert len(pack(np.full(3, 2**20, np.uint64))) == 2
    assert len(pack(np.array([2**63], np.uint64))) == 2


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t.,'as1é  ß!ʼ-", max_size=40)))
def test_encoder_equals_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == want


def test_files_round_trip(spark):
    rows = [(i, f"Text no. {i},\nwith  odd\tspaces and <|endoftext|> " * (i % 7), "x") for i in range(-50, 150)]
    rows += [(3, "copy", "x"), (3, "copy", "x"), (3, None, "x"), (None, "no id", "x"), (77, "x " * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(6)
    path = scratch(spark, "t")
    write_tokens(df, path, PATH, 2, block_ids=500)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for doc_id, text, _ in order:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, ids))
        start += len(ids)
    got = sorted(((r["doc_id"], r["start"], list(r["ids"])) for r in read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_digests(spark, path).collect())
    assert got == [(s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for _, s, i in want]


def test_empty(spark):
    path = scratch(spark, "t")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 2)
    assert token_digests(spark, path).collect() == []


def test_special_tokens_as_the_library_has_them():
    text = "x <|endoftext|> y"
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert 50256 in want and np.frombuffer(ENCODER.encode(text), "<u4").tolist() == want


def test_memo_of_two_generations():
    small = Encoder(PATH, limit=5, characters=20)
    texts = [f"some words, no. {i % 3} and\nlines {i}." for i in range(40)] + ["", "  a  b "]
    for text, ids in zip(texts, small.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(small) <= 5 + 40


def test_query_equals_library(spark):
    from keepsake.llm.token_files import op2_token_output

    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    start, want = 0, []
    for doc_id, text in docs:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in op2_token_output(spark, sf).collect())
    assert got == want


def test_units_joined():
    import pyarrow as pa

    from keepsake.llm.common import joined

    own, index = [b"abcd", b"", b"efghijkl"], [2, 0, 1, 0, 2, 2]
    flat, ends = joined(own, pa.array(index, pa.int32()))
    assert flat.to_pybytes()[: ends[-1]] == b"".join(own[i] for i in index)
    assert ends.tolist() == [0, 8, 12, 12, 16, 24, 32]
