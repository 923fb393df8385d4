"""Byte-level BPE (operator 11): padded numpy matrices of the distinct pieces of a batch, bucketed by length.

Each round every row of a matrix merges its leftmost pair of least rank. All rows lose exactly one entry by that, so a
matrix is compacted to one column less; rows without a pair left leave it. A pair's rank comes from a hash table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Rank of a pair that does not merge.
NONE = np.int32(2**31 - 1)
#: Entries of one matrix; longer buckets are worked off in slices.
CELLS = 1 << 20
#: Matrix widths: a piece goes to the narrowest that holds it. Wider pieces are matrices of one row.
WIDTHS = np.array([2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128], dtype=np.int64)


class PairTable:
    """Rank of a pair of ids: open addressing with linear probing, built and read by whole arrays."""

    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        keys, ranks = (left.astype(np.int64) << 32) | right, rank.astype(np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several keys for one slot, one stays
            mine = self.keys[slot] == keys
            self.ranks[slot[mine]] = ranks[mine]
            keys, ranks, slot = keys[~mine], ranks[~mine], (slot[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.ODD) >> self.shift).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (NONE: no such pair), in the shape of ``left``."""
        keys = ((left.astype(np.int64) << 32) | right).ravel()
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        at = np.flatnonzero((found != keys) & (found != -1))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys[at]
            out[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != -1)
            at, slot = at[go], slot[go]
        return out.reshape(left.shape)


class ByteBPE:
    """Ids of texts by a file of ``base64 rank`` lines; ids are ranks.

    Equal to ``tiktoken.Encoding(pat_str=pattern, mergeable_ranks=..., special_tokens={}).encode_ordinary(text)``:
    a piece that is an entry is that entry, others are merged from their bytes.
    """

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            entries = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.bytes_of = {i: b for b, i in entries.items()}
        self.single = np.array([entries[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pad = np.int32(max(entries.values()) + 1)  # in no pair
        pairs = [(entries[t[:k]], entries[t[k:]], i) for t, i in entries.items() for k in range(1, len(t))
                 if t[:k] in entries and t[k:] in entries]
        self.rank = PairTable(*np.array(pairs, dtype=np.int64).reshape(-1, 3).T)
        self.exceptions: dict[bytes, np.ndarray] = {}
        own = list(entries)
        for piece, ids in zip(own, self.encode_pieces(own)):
            if len(ids) != 1:  # merging does not reach this entry, though the piece is one
                self.exceptions[piece] = np.array([entries[piece]], dtype=np.int32)

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each piece (bytes, none empty)."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        flat = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        starts = np.cumsum(sizes) - sizes
        bucket = np.searchsorted(WIDTHS, sizes)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            b = int(bucket[group[0]])
            if b == len(WIDTHS):
                for i in group.tolist():
                    out[i] = self._merge_row(flat[starts[i]:starts[i] + sizes[i]])
                continue
            width = int(WIDTHS[b])
            step = max(1, CELLS // width)
            for at in range(0, len(group), step):
                rows = group[at:at + step]
                cols = np.arange(width)
                inside = cols < sizes[rows, None]
                matrix = np.where(inside, flat[np.minimum(starts[rows, None] + cols, len(flat) - 1)], self.pad)
                self._merge(matrix, rows, out)
        for i, p in enumerate(pieces) if self.exceptions else ():
            if p in self.exceptions:
                out[i] = self.exceptions[p]
        return out

    def _done(self, matrix: np.ndarray, rows: np.ndarray, out: list) -> None:
        length = (matrix != self.pad).sum(axis=1)
        ids = matrix[matrix != self.pad]
        ends = np.cumsum(length).tolist()
        for i, begin, end in zip(rows.tolist(), [0, *ends], ends):
            out[i] = ids[begin:end]

    def _merge(self, matrix: np.ndarray, rows: np.ndarray, out: list) -> None:
        rank = self.rank(matrix[:, :-1], matrix[:, 1:])
        while len(rows):
            if not rank.shape[1]:
                return self._done(matrix, rows, out)
            at = rank.argmin(axis=1)  # the leftmost of the least ranks
            least = rank[np.arange(len(rows)), at]
            go = least != NONE
            if not go.all():
                self._done(matrix[~go], rows[~go], out)
                matrix, rank, rows, at, least = matrix[go], rank[go], rows[go], at[go], least[go]
                if not len(rows):
                    return
            n, width = matrix.shape
            row = np.arange(n)
            matrix[row, at] = least
            matrix = matrix[np.arange(width) != at[:, None] + 1].reshape(n, width - 1)
            rank = rank[np.arange(width - 1) != at[:, None]].reshape(n, width - 2)
            left, right = at > 0, at < width - 2
            rank[row[left], at[left] - 1] = self.rank(matrix[row[left], at[left] - 1], least[left])
            rank[row[right], at[right]] = self.rank(least[right], matrix[row[right], at[right] + 1])

    def _merge_row(self, ids: np.ndarray) -> np.ndarray:
        """A long piece: a round merges its leftmost least pair and those of the same rank right of it, up to the first
        that makes a pair of lesser rank; the same merges, in the same order, as one pair a round."""
        while len(ids) > 1:
            rank = self.rank(ids[:-1], ids[1:])
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # starts of runs of overlapping pairs: every second merges
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
            before = np.where(np.isin(at - 2, at), least, np.where(at > 0, ids[at - 1], self.pad))
            after = np.append(ids, self.pad)[at + 2]
            made = np.full(len(at), least, dtype=ids.dtype)
            lower = np.flatnonzero((self.rank(before, made) < least) | (self.rank(made, after) < least))
            if len(lower):
                at = at[:lower[0] + 1]
            ids = ids.copy()
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each whole text (null: none); each distinct piece of the texts is merged once."""
        number: dict[str, int] = {}
        found = [np.array([number.setdefault(p, len(number)) for p in self.find(t)] if t else [], dtype=np.int64) for t in texts]
        ids = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in number])
        if not ids:
            return [np.empty(0, dtype=np.int32)] * len(texts)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat, start = np.concatenate(ids), np.cumsum(size) - size
        return [flat[spans(start[f], size[f])] for f in found]

    @property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all entries, and where each id's begin and how many they are."""
        if not hasattr(self, "_flat"):
            size = np.zeros(int(self.pad), dtype=np.int64)
            for i, b in self.bytes_of.items():
                size[i] = len(b)
            data = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(size))), dtype=np.uint8)
            self._flat = data, np.cumsum(size) - size, size
        return self._flat

    def decode(self, ids: np.ndarray) -> bytes:
        data, start, size = self.flat
        if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or not size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return data[spans(start[ids], size[ids])].tobytes()


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] entries, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    """One table per worker process and file."""
    return ByteBPE(path)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))


def _ranks_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_documents(docs: DataFrame, ranks: str | None = None, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and ``ids`` (array of int): the ids of every whole text, null and empty texts an empty array.

    One row per input row, repeated rows included; null keys stay null; columns besides the keys and the text are not
    read. An empty table gives no rows. A text of any length is encoded whole, in one task.
    """
    small_batches(docs.sparkSession)
    path, n = ranks or _ranks_path(), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            ids = _lists(bpe.encode(batch.column(n).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], ids], names=[*keys, "ids"])

    cols = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    return cols.mapInArrow(run, T.StructType([*cols.schema.fields[:n], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, ranks: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes (binary) that its ids stand for; null ids give null, no ids give no bytes.

    An id outside the vocabulary is an error; a column named ``into`` is replaced.
    """
    small_batches(encoded.sparkSession)
    path = ranks or _ranks_path()
    kept = [c for c in encoded.columns if c != into]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            col = batch.column(at)
            values, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            null = col.is_null().to_pylist()
            data = [None if null[i] else bpe.decode(values[ends[i]:ends[i + 1]]) for i in range(len(col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*kept, into])

    cols = encoded.select(*kept)
    return cols.mapInArrow(run, T.StructType([*cols.schema.fields, T.StructField(into, T.BinaryType())]))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.concat_ws(" ", ids.cast("array<string>"))


def bpe_table(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Digests of a round trip: doc_id, n_tokens, ids_sha256 (of the decimal ids), decoded_sha256 (of the decoded bytes)."""
    path = ranks or _ranks_path()
    digests = encode_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)
    digests = digests.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"))
    return decode_documents(digests, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
