import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabscope.llm import queries as Q
from tabscope.llm.alignment import align_documents, aligner, alignment_table, lockstep, pair_blocks, score_links

SF = "/root/testdata/sf0.001"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@lru_cache
def libraries():
    a = Tokenizer.from_file(P.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path(B))


@lru_cache
def alphabet():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain(text):
    """(ids, bytes) lists of both tokenizers, or None."""
    if not text:
        return None
    a, b = libraries()
    enc = a.encode(" " + text, add_special_tokens=False)
    ta = [(i, bytes(alphabet()[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
    tb = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (ta, tb) if b"".join(x for _, x in ta) == want == b"".join(x for _, x in tb) else None


def brute(rows):
    """The contract, pair by pair, over all tokens."""
    found, count = [], Counter()
    for d, text in rows:
        both = plain(text)
        if both is None:
            found.append((d, None, None, None, []))
            continue
        spans = []
        for tokens in both:
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = []
        j0 = 0
        for i, s, e in spans[0]:
            while spans[1][j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((i, spans[1][j][0]))
                j += 1
        count.update(links)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, k = [], [0, 0]
        for c in cuts:
            sides = []
            for side in (0, 1):
                ids = []
                while k[side] < len(spans[side]) and spans[side][k[side]][2] <= c:
                    ids.append(str(spans[side][k[side]][0]))
                    k[side] += 1
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        found.append((d, len(spans[0]), len(spans[1]), groups, links))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, na or 0, nb or 0, len(groups or []), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for d, na, nb, groups, links in found]


@given(st.lists(st.tuples(st.sets(st.integers(1, 39), max_size=12), st.sets(st.integers(1, 39), max_size=12)), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_lockstep(docs):
    sides = [[sorted(s | {40}) for s in side] for side in zip(*docs)]
    link_a, link_b, cut, n_links = lockstep(*[x for side in sides for x in (np.concatenate(side), np.array([len(s) for s in side]))])
    at = first_a = first_b = 0
    for a, b, n in zip(*sides, n_links):
        got = [(i - first_a, j - first_b) for i, j in zip(link_a[at:at + n], link_b[at:at + n])]
        begin = lambda ends, k: ends[k - 1] if k else 0
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if begin(a, i) < b[j] and begin(b, j) < a[i]]
        assert got == want and cut[at:at + n].sum() == len(set(a) & set(b))
        at, first_a, first_b = at + n, first_a + len(a), first_b + len(b)
    assert at == len(link_a)


ROWS = [(5, "b c strange tokenisation"), (1, None), (2, ""), (None, "no id"), (5, "b c strange tokenisation"), (3, "long words " * 6000),
        (4, "▁ is taken for a space"), (6, "  é日😀\n\t<|endoftext|> <s> <0x0A> \x00 x  "), (7, " "), (2**40, "ﬁ Ⅷ ½")]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(d, t, 9, "x") for d, t in ROWS], "doc_id long, text string, block int, a_ids string")
    want = sorted(brute(ROWS), key=str)
    assert sorted(map(tuple, alignment_table(docs).collect()), key=str) == want
    assert want[0][1:] == (0,) * 6 + ("",) or any(w[1:] == (0,) * 6 + ("",) for w in want)
    assert alignment_table(docs.limit(0)).count() == 0


def test_small_blocks_and_real_outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    rows = [tuple(r) for r in docs.collect()]
    from tabscope.llm.common import materialize
    aligned = materialize(align_documents(docs, block=3000), "aligned")
    assert sorted(map(tuple, score_links(materialize(pair_blocks(docs, block=3000), "blocks")).collect())) == sorted(brute(rows))
    find = aligner(P.path(A), P.path(B))
    for r in aligned.collect():
        assert len(r["link_a"]) == len(r["link_b"]) and len(r["cut_a"]) == len(r["cut_b"])
        if r["a_ids"]:
            assert (r["cut_a"][-1], r["cut_b"][-1]) == (len(r["a_ids"]) - 1, len(r["b_ids"]) - 1)
            assert find._joined(find.bytes_a, np.array(r["a_ids"])) == find._joined(find.bytes_b, np.array(r["b_ids"]))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, Q.op12_tokenizer_alignment(spark, SF).collect())) == sorted(brute(rows))
