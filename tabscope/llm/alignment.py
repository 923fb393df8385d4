"""Cross-tokenizer alignment (operator 12): lockstep merging of two tokenizations' byte ends, many documents at once.

One numpy state holds the A and the B pointer of every document of a block. Each step emits the link of the two tokens
pointed at, marks a cut where both end, moves the pointer of the token that ends first (both at a cut), and compacts
the state when documents finish.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import spans
from .common import materialize, small_batches
from .tokens import encoder, tokenizer_path

#: Bytes of text that one lockstep state and one block of pair counts take (at least one batch of rows).
BLOCK = 4 << 20


def lockstep(ends_a: np.ndarray, size_a: np.ndarray, ends_b: np.ndarray, size_b: np.ndarray):
    """Merge the documents' ascending token ends (byte offsets, concatenated; ``size_*`` tokens each, none empty).

    Returns ``link_a``, ``link_b`` (positions in the concatenated arrays, in document order), ``cut`` (true where both
    tokens end) and ``n_links`` per document. The last ends of a document must be equal.
    """
    stop_a, stop_b = np.cumsum(size_a), np.cumsum(size_b)
    base = np.cumsum(size_a + size_b) - (size_a + size_b)  # a document has fewer links than tokens
    total = int((size_a + size_b).sum())
    link_a, link_b, cut = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int32), np.zeros(total, dtype=bool)
    n_links = np.zeros(len(size_a), dtype=np.int64)
    lane = np.arange(len(size_a))
    i, j, at, last = stop_a - size_a, stop_b - size_b, base.copy(), stop_a.copy()
    while len(lane):
        link_a[at], link_b[at] = i, j
        end_a, end_b = ends_a[i], ends_b[j]
        both = end_a == end_b
        cut[at] = both
        at += 1
        i += end_a <= end_b
        j += end_b <= end_a
        done = i == last  # both tokenizations end at the same byte
        if done.any():
            n_links[lane[done]] = at[done] - base[lane[done]]
            go = ~done
            lane, i, j, at, last = lane[go], i[go], j[go], at[go], last[go]
    kept = spans(base, n_links)
    return link_a[kept], link_b[kept], cut[kept], n_links


class Aligner:
    """Tokenizer A (a ``tokenizers`` byte-level BPE file) on a space and the text, B (a SentencePiece file) on the text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {chr(v): k for k, v in self.a.alphabet.items()}
        vocabulary = self.a.whole.get_vocab(with_added_tokens=True)
        named = {i: t for t, i in vocabulary.items()}
        self.bytes_a = self._table([bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
                                    for t in (named.get(i, "") for i in range(max(named) + 1))])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = self._table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                    for i, p in enumerate(pieces)])

    @staticmethod
    def _table(entries: list[bytes]):
        size = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries))
        return np.frombuffer(b"".join(entries), dtype=np.uint8), np.cumsum(size) - size, size

    @staticmethod
    def _joined(table, ids: np.ndarray) -> bytes:
        data, start, size = table
        return data[spans(start[ids], size[ids])].tobytes()

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and B; none if the text is null or empty or either's bytes are not those of space + text."""
        none = np.empty(0, dtype=np.int32)
        if not text:
            return none, none
        a = np.frombuffer(self.a.encode(" " + text), dtype="<u4").astype(np.int32)
        b = np.array(self.b.encode(text), dtype=np.int32)
        want = b" " + text.encode("utf-8", "surrogatepass")
        if self._joined(self.bytes_b, b) != want or self._joined(self.bytes_a, a) != want:
            return none, none
        return a, b

    def align(self, texts: list[str | None]):
        """Flat ids of A and B with tokens per text, and ``lockstep`` over them."""
        pairs = [self.tokens(t) for t in texts]
        size_a = np.array([len(a) for a, _ in pairs], dtype=np.int64)
        size_b = np.array([len(b) for _, b in pairs], dtype=np.int64)
        empty = np.empty(0, dtype=np.int32)
        ids_a, ids_b = np.concatenate([empty, *[a for a, _ in pairs]]), np.concatenate([empty, *[b for _, b in pairs]])
        some = size_a > 0
        n_links = np.zeros(len(texts), dtype=np.int64)
        # running ends over all texts: within a text their differences are the byte offsets, and both tokenizations
        # of a text have the same bytes, so equal running ends are equal offsets
        link_a, link_b, cut, n_links[some] = lockstep(np.cumsum(self.bytes_a[2][ids_a]), size_a[some], np.cumsum(self.bytes_b[2][ids_b]), size_b[some])
        return ids_a, size_a, ids_b, size_b, link_a, link_b, cut, n_links


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    return Aligner(path_a, path_b)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.astype(np.int32)))


def _blocks(batches: Iterator[pa.RecordBatch], text: int, aligner_: Aligner, block: int):
    """The batches in blocks of about ``block`` bytes of text (column ``text``), each with the alignment of its texts."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= block:
            yield held, aligner_.align([t for b in held for t in b.column(text).to_pylist()])
            held, size = [], 0
    if held:
        yield held, aligner_.align([t for b in held for t in b.column(text).to_pylist()])


def _counts(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many flags are set in each run of ``sizes``."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[np.concatenate([[0], np.cumsum(sizes)])])


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keys: tuple[str, ...] = ("doc_id",),
                    text: str = "text", block: int = BLOCK) -> DataFrame:
    """``keys`` and the alignment of every whole text as arrays of int: ``a_ids``, ``b_ids``; ``link_a`` and ``link_b``
    (numbers of the linked tokens, from 0, in text order); ``cut_a`` and ``cut_b`` (last token of each group).

    All arrays are empty where the text is null or empty, or where a tokenizer's bytes are not those of space + text.
    One row per input row, repeated rows and null keys included; columns besides the keys and the text are not read; an
    empty table gives no rows. A text is aligned whole, however long.
    """
    small_batches(docs.sparkSession)
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    n = len(keys)
    names = [*keys, "a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, aligned in _blocks(batches, n, aligner(path_a, path_b), block):
            ids_a, size_a, ids_b, size_b, link_a, link_b, cut, n_links = aligned
            n_cuts = _counts(cut, n_links)
            link_a = link_a - np.repeat(np.cumsum(size_a) - size_a, n_links)
            link_b = link_b - np.repeat(np.cumsum(size_b) - size_b, n_links)
            arrays = [_lists(ids_a, size_a), _lists(ids_b, size_b), _lists(link_a, n_links), _lists(link_b, n_links),
                      _lists(link_a[cut], n_cuts), _lists(link_b[cut], n_cuts)]
            at = 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[a.slice(at, batch.num_rows) for a in arrays]], names=names)
                at += batch.num_rows

    cols = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    return cols.mapInArrow(run, T.StructType([*cols.schema.fields[:n], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in names[n:]]]))


def groups_digests(ids_a, size_a, ids_b, size_b, cut_a, cut_b) -> list[str]:
    """SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2,b3`` ('' without tokens); flat arrays, cuts as positions in them."""
    group_a, group_b = np.searchsorted(cut_a, np.arange(len(ids_a))), np.searchsorted(cut_b, np.arange(len(ids_b)))
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    before_b = np.concatenate([[0], cut_b + 1])
    at_a, at_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + cut_a[group_b] + 1
    plain, bar, semicolon = _decimals(int(max(ids_a.max(initial=0), ids_b.max(initial=0))) // 65536 + 1)
    out[at_a], out[at_b] = plain[ids_a], plain[ids_b]
    out[at_a[cut_a]], out[at_b[cut_b]] = bar[ids_a[cut_a]], semicolon[ids_b[cut_b]]
    ends = np.cumsum(size_a + size_b).tolist()
    return [hashlib.sha256("".join(out[s:e].tolist())[:-1].encode()).hexdigest() if e > s else "" for s, e in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def _decimals(pages: int) -> list[np.ndarray]:
    return [np.array([f"{i}{end}" for i in range(pages * 65536)], dtype=object) for end in ",|;"]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def pair_blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block: int = BLOCK) -> DataFrame:
    """Alignment digests per row of ``docs`` (doc_id, text), and the id pairs that each block of documents links.

    A block's row has ``pairs`` (distinct a_id * 2^32 + b_id, ascending) and ``times`` (links of each in the block). A
    document's row has doc_id, its counts, ``groups_sha256``, and its links as ``at`` (positions in the block's
    ``pairs``) and ``times``. Blocks are numbered by task, so the result must be written once before it is used twice.
    """
    small_batches(docs.sparkSession)
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_id", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups_sha256", T.StringType()),
                           T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.IntegerType())),
                           T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        arrow = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("groups_sha256", pa.string()),
                           ("pairs", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
        block_id = TaskContext.get().partitionId() << 32
        for held, aligned in _blocks(batches, 1, aligner(path_a, path_b), block):
            ids_a, size_a, ids_b, size_b, link_a, link_b, cut, n_links = aligned
            n_cuts = _counts(cut, n_links)
            shas = groups_digests(ids_a, size_a, ids_b, size_b, link_a[cut], link_b[cut])
            pairs, place, times = np.unique((ids_a[link_a].astype(np.int64) << 32) | ids_b[link_b], return_inverse=True, return_counts=True)
            width = max(1, len(pairs))
            own, own_times = np.unique(np.repeat(np.arange(len(n_links)), n_links) * width + place, return_counts=True)
            own_size = np.bincount(own // width, minlength=len(n_links))
            yield pa.RecordBatch.from_pydict({"block": [block_id], "doc_id": [None], **{c: [None] for c in COUNTS}, "groups_sha256": [None],
                                              "pairs": [pairs], "at": [None], "times": [times.astype(np.int32)]}, schema=arrow)
            n = len(n_links)
            columns = [pa.array(np.full(n, block_id)), pa.concat_arrays([b.column(0) for b in held]),
                       *[pa.array(x.astype(np.int64)) for x in (size_a, size_b, n_cuts, n_links)], pa.array(shas, pa.string()),
                       pa.nulls(n, pa.list_(pa.int64())), _lists(own % width, own_size), _lists(own_times, own_size)]
            rows = pa.RecordBatch.from_arrays(columns, schema=arrow)
            for at in range(0, n, 512):
                yield rows.slice(at, 512)
            block_id += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def score_links(blocks: DataFrame) -> DataFrame:
    """Corpus-wide pair counts brought back to the documents: doc_id, the counts, n_best, count_sum, groups_sha256.

    Pairs meet by id, one row per block and pair, so a pair that all documents hold is as many rows as there are
    blocks. Each block then gets its pairs' totals, in front of its documents, and both pass through a task in order.
    """
    listed = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "link"))
    pairs = listed.select("block", "at", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    totals = pairs.groupBy("pair").agg(F.sum(F.col("times").cast("long")).alias("total"))
    totals = totals.withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    highest = totals.groupBy("b_id").agg(F.max("total").alias("highest"))
    totals = totals.join(highest, "b_id").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    scored = pairs.join(totals, "pair").select("block", F.lit(0).alias("kind"), "at", "total", "best")
    kept = ["doc_id", *COUNTS, "groups_sha256"]
    lists = ["links", "link_times"]
    documents = blocks.where("pairs is null").select("block", F.lit(1).alias("kind"), *kept, F.col("at").alias(lists[0]), F.col("times").alias(lists[1]))
    rows = scored.unionByName(documents, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    rows = rows.select("block", "kind", "at", "total", "best", *lists, *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, total, best = None, [], np.empty(0, np.int64), np.empty(0, bool)
        for batch in batches:
            blocks_, kind = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = np.flatnonzero((np.diff(blocks_) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kind)]):
                if s == e:
                    continue
                if blocks_[s] != now:
                    now, parts, total, best = blocks_[s], [], np.empty(0, np.int64), np.empty(0, bool)
                part = batch.slice(s, e - s)
                if kind[s] == 0:
                    parts.append([part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)])
                    continue
                if parts:
                    at, t, b = map(np.concatenate, zip(*parts))
                    total, best, parts = np.empty(len(at), np.int64), np.empty(len(at), bool), []
                    total[at], best[at] = t, b.astype(bool)
                links, times = part.column(5).flatten().to_numpy(), part.column(6).flatten().to_numpy().astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.diff(part.column(5).offsets.to_numpy()))])
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[links], times * total[links])]
                n_best, count_sum = (np.diff(x[ends]) for x in sums)
                yield pa.RecordBatch.from_arrays([*part.columns[7:12], pa.array(n_best), pa.array(count_sum), part.column(12)],
                                                 names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", *COUNTS, "n_best", "count_sum")]
                                             + [T.StructField("groups_sha256", T.StringType())]))


def alignment_table(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Alignment digests per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best``: links whose id pair has its B id's highest number of links in the corpus (ties included); ``count_sum``:
    sum of the pairs' numbers over the links. Rows without tokens (``align_documents``) have zeros and ''. Repeated rows
    count and are returned as often as they stand.
    """
    return score_links(materialize(pair_blocks(docs, path_a, path_b), "alignment"))
