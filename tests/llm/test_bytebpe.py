import base64
import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tabscope.llm import queries as Q
from tabscope.llm.bytebpe import PairTable, bpe_table, byte_bpe, decode_documents, encode_documents

SF = "/root/testdata/sf0.001"
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@lru_cache
def library(name):
    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", FILES)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text(alphabet="ab theing\n 1!é日", max_size=400)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_equals_the_library(name, texts):
    got = byte_bpe(P.path(name)).encode(texts)
    assert [g.tolist() for g in got] == [library(name).encode_ordinary(t or "") for t in texts]
    assert [byte_bpe(P.path(name)).decode(g) for g in got] == [(t or "").encode() for t in texts]


@pytest.mark.parametrize("name", FILES)
@given(st.text(alphabet=st.sampled_from("abcdeilnorst="), min_size=120, max_size=3000))
@settings(max_examples=60, deadline=None)
def test_long_pieces(name, piece):
    assert byte_bpe(P.path(name)).encode([piece])[0].tolist() == library(name).encode_ordinary(piece)


@pytest.mark.parametrize("name", FILES)
def test_every_entry_encodes_to_itself(name):
    bpe = byte_bpe(P.path(name))
    assert all(ids.tolist() == [i] for i, ids in zip(bpe.bytes_of, bpe.encode_pieces(list(bpe.bytes_of.values()))))


def test_pair_table_with_full_probes():
    left, right = np.divmod(np.arange(5000), 70)
    table = PairTable(left, right, np.arange(5000))
    l, r = np.meshgrid(np.arange(90), np.arange(90))
    want = np.where((r < 70) & (l * 70 + r < 5000), l * 70 + r, 2**31 - 1)
    assert (table(l, r) == want).all()


def test_decode_refuses_unknown_ids():
    with pytest.raises(ValueError):
        byte_bpe(P.path(FILES[0])).decode(np.array([50256]))


ROWS = [(5, "b c"), (1, None), (2, ""), (None, "no id"), (5, "b c"), (3, "long words " * 9000), (4, "=" * 5000), (2**40, "é日😀 <|endoftext|>")]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, ids string, decoded int")
    got = sorted(map(tuple, bpe_table(docs).collect()), key=str)
    want = []
    for d, t in ROWS:
        ids = library(FILES[0]).encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_table(docs.limit(0)).count() == 0
    back = decode_documents(encode_documents(docs)).collect()
    assert sorted((r["decoded"] for r in back)) == sorted((t or "").encode() for _, t in ROWS)


def test_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op11_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, t in docs:
        ids = library(FILES[0]).encode_ordinary(t or "")
        assert got[d] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
