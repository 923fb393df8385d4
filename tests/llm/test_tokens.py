import zlib
from functools import lru_cache

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabscope.llm import queries as Q
from tabscope.llm.eliasfano import EliasFano, TokenFile, pack_file, token_table, write_tokens, read_tokens
from tabscope.llm.packing import pack, plan, sequences, slots
from tabscope.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@lru_cache
def tokenizer(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def whole(name, text, end):
    t = tokenizer(name)
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@pytest.mark.parametrize("name", FILES)
@given(st.text(alphabet="ab Z\n\t\r'stédİ123.,!# 　\x1ćß日😀<|>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_cached_encoding_is_whole_encoding(name, text):
    e = encoder(P.path(name))
    assert e.encode(text) == np.array(e.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@given(st.lists(st.integers(0, 2**45), max_size=80).map(sorted))
@settings(max_examples=150, deadline=None)
def test_elias_fano_round_trip(values):
    ef, _ = EliasFano.from_bytes(EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes())
    assert ef.selects(np.arange(ef.n)).tolist() == values == [ef.select(i) for i in range(ef.n)]


def test_selects_any_positions_and_finds_ids():
    rng = np.random.default_rng(2)
    values = np.sort(rng.integers(0, 1 << 40, 30_000))
    ef = EliasFano.of(values)
    at = rng.integers(0, len(values), 5000)
    assert (ef.selects(at) == values[at]).all() and not len(ef.selects(np.zeros(0, dtype=np.int64)))
    ids = [None, None, -5, 3, 3, 3, 9, 1 << 40]
    f = TokenFile(pack_file(ids, [np.full(i, i, dtype="<u4").tobytes() for i in range(8)]))
    assert [list(f.find(d)) for d in (-6, -5, 3, 4, 9, 1 << 40, 1 << 41)] == [[], [2], [3, 4, 5], [], [6], [7], []]
    assert [(d, s, x.tolist()) for d, s, x in f.rows(block=3)] == [(d, i * (i - 1) // 2, [i] * i) for i, d in enumerate(ids)]


def test_elias_fano_is_small_and_selects():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 900, 20000))
    ef = EliasFano.of(ends)
    assert len(ef.to_bytes()) * 8 < 20000 * (2.1 + np.log2(ends[-1] / 20000) + 0.1)
    assert [ef.select(i) for i in (0, 511, 512, 513, 19999)] == ends[[0, 511, 512, 513, 19999]].tolist()


def test_wide_ids_keep_four_bytes():
    ids = [np.array([1, 70000], dtype="<u4").tobytes(), np.array([2], dtype="<u4").tobytes()]
    assert [x.tolist() for _, _, x in TokenFile(pack_file([0, 1], ids)).rows()] == [[1, 70000], [2]]


def test_token_file():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (1, 5, 2, 0, 3)]
    f = TokenFile(pack_file([None, -7, -7, 4, 2**40], ids))
    assert [f.doc_id(i) for i in range(5)] == [None, -7, -7, 4, 2**40] and f.document(1).tolist() == [0, 1, 2, 3, 4]
    assert [(d, s, len(x)) for d, s, x in f.rows()] == [(None, 0, 1), (-7, 1, 5), (-7, 6, 2), (4, 8, 0), (2**40, 8, 3)]


ROWS = [(5, "b c"), (1, None), (2, ""), (None, "no id"), (5, "b c"), (3, "long words " * 9000), (2**40, "tail")]


def frame(spark):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, start int, ids string")


def test_token_table_edges(spark, scratch):
    got = sorted(map(tuple, token_table(frame(spark)).collect()), key=lambda r: r[1])
    start, want = 0, []
    for d, t in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = whole(FILES[0], t, 0)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_table(frame(spark).limit(0)).count() == 0
    files = write_tokens(frame(spark), scratch, P.path(FILES[0]), file_ids=3)
    assert files.count() > 3
    back = read_tokens(spark, files, scratch, keep_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in back] == want
    assert back[-1].ids == whole(FILES[0], "tail", 0).tolist()


def test_token_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: tuple(r)[1:4] for r in Q.op2_token_files(spark, SF).collect()}
    start = 0
    for d, t in docs:
        ids = whole(FILES[0], t, 0)
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_piece_within_capacity(histogram):
    runs = plan(histogram, 64)
    placed = {}
    for r in runs:
        assert r.n > 0 and sum(n * c for n, c in r.items) <= 64
        for n, c in r.items:
            placed[n] = placed.get(n, 0) + r.n * c
    assert placed == histogram
    assert sum(r.n for r in runs) <= 2 * max(1, -(-sum(n * c for n, c in histogram.items()) // 64))
    assert len(slots(runs)) == sum(len(r.items) for r in runs)


def check_packed(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = sorted(((d, k, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes()))
                   for d, t in docs for ids in [whole(FILES[1], t, 1)] for k, at in enumerate(range(0, len(ids), capacity))), key=repr)
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == want
    return len(by_sequence), sum(r.length for r in rows)


def test_pack_edges(spark):
    packed = pack(frame(spark), keep_ids=True)
    rows = packed.drop("ids").collect()
    check_packed(rows, ROWS, 4096)
    whole_ids = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in packed.collect():
        assert bytes(whole_ids[r.sequence_id])[4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert pack(frame(spark).limit(0)).count() == 0


def test_pack_query_and_hot_lengths(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, total = check_packed(Q.op4_best_fit_packing(spark, SF).collect(), docs, 4096)
    assert n <= 1.02 * total / 4096 + 1
    from tabscope.llm.packing import encode_pieces, place
    pieces = encode_pieces(spark.createDataFrame([(i, "same text") for i in range(500)], "doc_id long, text string"), P.path(FILES[1]))
    pieces = pieces.persist()
    h = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    check_packed(place(pieces, plan(h, 4096), 500, window_rows=30).collect(), [(i, "same text") for i in range(500)], 4096)
