"""R2, R3 on words of many texts at once: 1-2-grams as slices of one buffer, their md5 side by side, hashed counts.

Texts hold their words in order with one space between them, so a word and a pair of words are both slices of the text.
The md5 key of a term is the first 8 bytes of its md5, whose first 4 give the bucket of the hashed vectors
(``retrieval.hash_bucket``). Terms that are only counted need no md5 of their pairs of words.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Terms whose md5 is computed at once: their columns stay in the processor's cache.
STEP = 16384
#: Bytes of a term that is one block of md5; longer ones go by hashlib.
ONE_BLOCK = 55

_K = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
#: Of eight bytes, those that belong to a term with -1, 0, ... 8 bytes there, and the bit behind its last byte.
_MASK = np.array([0, *[(1 << 8 * i) - 1 for i in range(9)]], np.uint64)
_END = np.array([0, *[0x80 << 8 * i for i in range(8)], 0], np.uint64)


def _blocks_md5(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the digests of padded blocks: ``words`` (16, n) little-endian."""
    n = words.shape[1]
    used = [bool(w.any()) for w in words]
    init = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, np.uint32) for x in init)
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, _K[i], out=a)
        if used[_WORD[i]]:
            np.add(a, words[_WORD[i]], out=a)
        np.left_shift(a, np.uint32(_TURN[i]), out=turned)
        np.right_shift(a, np.uint32(32 - _TURN[i]), out=a)
        np.bitwise_or(a, turned, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(init[0]), b + np.uint32(init[1])


def md5_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the md5 of each slice of ``data`` (bytes), as a big-endian number."""
    out = np.empty(len(starts), np.uint64)
    data = np.append(data, np.zeros(64, np.uint8))  # a term may be read beyond the last slice
    eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))  # the eight bytes from each place on
    for s in range(0, len(starts), STEP):
        at, size = starts[s:s + STEP], sizes[s:s + STEP]
        long = np.flatnonzero(size > ONE_BLOCK)
        short = np.minimum(size, ONE_BLOCK)
        words = np.zeros((16, len(at)), np.uint32)
        for j in range(int(short.max()) // 8 + 1):
            left = np.clip(short - 8 * j, -1, 8)  # bytes of the term among these eight; -1: it ended before
            x = eight[at + 8 * j] & _MASK[left + 1] | _END[left + 1]
            words[2 * j] = x  # casts keep the lower half
            words[2 * j + 1] = x >> np.uint64(32)
        words[14] = short * 8
        a, b = _blocks_md5(words)
        out[s:s + STEP] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
        for i in long.tolist():
            out[s + i] = int.from_bytes(hashlib.md5(data[at[i]:at[i] + size[i]].tobytes()).digest()[:8], "big")
    return out


def order_of(keys: np.ndarray) -> np.ndarray:
    """``argsort``, equal keys in their order. The places take the lowest bits of the keys, so that plain numbers are sorted;
    if keys differ in those bits only, they are sorted as they are."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    mixed = np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64))
    order = (mixed & low).astype(np.int64)
    k = keys[order]
    if ((k[1:] != k[:-1]) & (k[1:] & ~low == k[:-1] & ~low)).any():
        return np.argsort(keys, kind="stable")
    return order


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(m)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of texts (a string column, words with one space between them): text, first byte and length of each."""

    def __init__(self, col: pa.Array):
        n = len(col)
        _, offsets, data = col.buffers()
        ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
        base, ends = (ends[0], ends - ends[0]) if n else (0, np.zeros(1, np.int64))
        self.data = np.frombuffer(data, np.uint8)[base:base + ends[-1]] if data is not None and ends[-1] else np.empty(0, np.uint8)
        gaps = np.flatnonzero(self.data == 32)
        full = np.flatnonzero(ends[1:] > ends[:-1])
        begins, closes = np.zeros((2, len(self.data) + 1), bool)
        begins[ends[:-1][full]] = begins[gaps + 1] = True
        closes[ends[1:][full]] = closes[gaps] = True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(closes)
        self.text = np.searchsorted(ends, self.starts, side="right") - 1
        self.pairs = np.flatnonzero(self.text[1:] == self.text[:-1])  # words that have one behind them

    @cached_property
    def single(self) -> np.ndarray:
        """The md5 key of every word."""
        # words occur often: with the space behind them they follow each other, and each is hashed where it occurs first
        cuts = pa.py_buffer(np.append(self.starts, len(self.data)))
        word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, cuts, pa.py_buffer(self.data)]).dictionary_encode().indices.to_numpy()
        first = np.empty(word.max() + 1 if len(word) else 0, np.int64)
        first[word[::-1]] = np.arange(len(word))[::-1]
        return md5_keys(self.data, self.starts[first], (self.ends - self.starts)[first])[word]

    @cached_property
    def text_of(self) -> np.ndarray:
        """The text of every word, and then of every pair of words."""
        return np.concatenate([self.text, self.text[self.pairs]])

    def terms(self) -> np.ndarray:
        """A key of every word and then of every pair of words: that of a pair is mixed from its words'."""
        return np.concatenate([self.single, _pair_key(self.single[self.pairs], self.single[self.pairs + 1])])

    def md5(self) -> np.ndarray:
        """The md5 key of every word and then of every pair of words."""
        return np.concatenate([self.single, md5_keys(self.data, self.starts[self.pairs], self.ends[self.pairs + 1] - self.starts[self.pairs])])

    def strings(self, occurrences: np.ndarray) -> pa.Array:
        """Terms as text, by their place in ``terms``."""
        m = len(self.starts)
        single = occurrences < m
        left = np.where(single, occurrences, self.pairs[np.where(single, 0, occurrences - m)] if len(self.pairs) else 0)
        right = np.where(single, left, left + 1)
        begin, size = self.starts[left], self.ends[right] - self.starts[left]
        offsets = np.r_[0, np.cumsum(size)]
        take = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[take])).cast(pa.string())


def buckets(keys: np.ndarray, dims: int) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int64) % dims


def small(x: np.ndarray) -> np.ndarray:
    """Numbers that are not negative, in the least type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def counts_packed(at: np.ndarray, keys: np.ndarray, n: int, dims: int) -> tuple[np.ndarray, ...]:
    """Hashed counts of ``n`` texts from the md5 keys of their terms: filled buckets of each, the buckets, and the counts, as small numbers."""
    c = np.bincount(at * dims + buckets(keys, dims), minlength=n * dims)
    cells = np.flatnonzero(c)
    return small(np.bincount(cells // dims, minlength=n)), small(cells % dims), small(c[cells])


def counts_matrix(packed: tuple[np.ndarray, ...], dims: int) -> np.ndarray:
    """Hashed vectors (texts x dims), L2-normalised."""
    sizes, bucket, c = (x.astype(np.int64) for x in packed)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), bucket] = c
    out /= (np.sqrt(np.einsum("ij,ij->i", out, out)) + 1e-12)[:, None]
    return out


def pack(x: object, level: int = 1) -> bytes:
    return zlib.compress(pickle.dumps(x), level)


def unpack(x: bytes) -> object:
    return pickle.loads(zlib.decompress(x))


def _codes(ids: pa.Array) -> np.ndarray:
    return ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def dense_rows(batches: Iterator[pa.RecordBatch], dims: int, chunks: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows of some ``chunks`` chunks from (id, no, words) sorted by id: n, doc_ids, chunk_nos, packed. Chunks of equal id
    and number, which stand in one row as ids are not divided, are one."""
    def row(held: pa.Table) -> pa.RecordBatch:
        ids, nos, words = (held.column(c).combine_chunks() for c in range(3))
        ids, nos, words = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, nos, words))
        _, first, of = np.unique(_codes(ids) << 32 | nos.to_numpy(), return_index=True, return_inverse=True)
        found, n = Words(words), len(first)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x.take(pa.array(first)))
        packed = pack(counts_packed(of[found.text_of], found.md5(), n, dims), 0)
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), one(ids), one(nos), pa.array([packed], pa.binary())], names=["n", "doc_ids", "chunk_nos", "packed"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch.slice(s, chunks) for s in range(0, batch.num_rows, chunks)]
        while sum(b.num_rows for b in held) >= chunks:
            table = pa.Table.from_batches(held)
            ids = _codes(pa.concat_arrays(table.column(0).chunks))
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1  # the last id may go on in the next batch
            cut = cuts[max(0, np.searchsorted(cuts, chunks, side="right") - 1)] if len(cuts) else 0
            if not cut:
                break
            yield row(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield row(pa.Table.from_batches(held))
