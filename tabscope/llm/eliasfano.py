"""Token files: a concatenated id array with Elias-Fano coded document boundaries and document ids."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_folder, small_batches, text_bytes
from .tokens import encoder, tokenizer_path

MAGIC = b"EFTOKEN1"
#: Ids in one file: what a task holds while it writes or reads (a longer document has a file of its own).
FILE_IDS = 2_000_000
#: Input bytes of text that one writing task takes in, about.
TASK_BYTES = 64 * 1024 * 1024


class EliasFano:
    """A non-decreasing sequence of n integers in [0, u]: n * (2 + log2(u / n)) bits, about.

    The low ``l`` bits of each value are packed side by side; the high parts are a bit vector with a one at
    position high(i) + i. ``select`` finds the i-th one through a count of ones per 512-bit block, so a value is
    read without decoding what stands before it; the stored counts are 32-bit.
    """

    BLOCK = 512

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.l, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        step = self.BLOCK // 8
        per = np.add.reduceat(ones, np.arange(0, len(ones), step)) if len(ones) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)
        self.rows = np.pad(high, (0, -len(high) % step)).reshape(-1, step)

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        u = int(values[-1]) if n else 0
        l = max(0, (u // n).bit_length() - 1) if n and u > n else 0
        high = np.zeros(((u >> l) + n) // 8 + 1, dtype=np.uint8)
        at = (values >> np.uint64(l)) + np.arange(n, dtype=np.uint64)
        np.bitwise_or.at(high, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        bits = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, l, np.packbits(bits.ravel(), bitorder="little"), high)

    def select(self, i: int) -> int:
        """The i-th value (from 0)."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        start = block * self.BLOCK
        bits = np.unpackbits(self.high[start // 8:start // 8 + self.BLOCK // 8], bitorder="little")
        at = start + int(np.flatnonzero(bits)[i - int(self.before[block])])
        first = i * self.l
        part = np.unpackbits(self.low[first // 8:(first + self.l + 7) // 8], bitorder="little")[first % 8:first % 8 + self.l]
        return ((at - i) << self.l) | sum(int(b) << k for k, b in enumerate(part))

    def selects(self, i: np.ndarray) -> np.ndarray:
        """The values at the positions ``i``: only the blocks that hold them are unpacked."""
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return i
        before = self.before.astype(np.int64)
        block = np.searchsorted(before, i, side="right") - 1
        used, place = np.unique(block, return_inverse=True)
        ones = np.flatnonzero(np.unpackbits(self.rows[used], axis=1, bitorder="little").ravel())
        ahead = np.cumsum(before[used + 1] - before[used]) - (before[used + 1] - before[used])
        at = block * self.BLOCK + ones[ahead[place] + i - before[block]] % self.BLOCK
        bit = i[:, None] * self.l + np.arange(self.l)
        low = (self.low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << np.arange(self.l)
        return ((at - i) << self.l) | low.sum(axis=1)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQ", self.n, self.l, len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple["EliasFano", int]:
        n, l, size = struct.unpack_from("<QBQ", data, at)
        at += struct.calcsize("<QBQ")
        low = np.frombuffer(data, np.uint8, (n * l + 7) // 8, at)
        high = np.frombuffer(data, np.uint8, size, at + len(low))
        return cls(n, l, low, high), at + len(low) + size


def pack_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One token file: magic, null ids, smallest id, bytes per token, coded document ids, coded end offsets, the id array.

    ``doc_ids`` ascend, nulls first; ``ids`` holds each document's little-endian 32-bit ids. The file keeps two bytes a
    token where all its ids fit, else four.
    """
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    coded = EliasFano.of((known - base).astype(np.uint64)).to_bytes()
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids])).to_bytes()
    tokens = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(tokens) or tokens.max() < 1 << 16 else 4
    return MAGIC + struct.pack("<QqB", len(doc_ids) - len(known), base, width) + coded + ends + tokens.astype(f"<u{width}").tobytes()


class TokenFile:
    """A token file held in memory: documents by position, through the coded boundaries."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.nulls, self.base, width = struct.unpack_from("<QqB", data, 8)
        self.known, at = EliasFano.from_bytes(data, 8 + struct.calcsize("<QqB"))
        self.ends, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", offset=at)

    def __len__(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.known.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.ids[self.ends.select(i - 1) if i else 0:self.ends.select(i)]

    def find(self, doc_id: int) -> range:
        """Positions of a document id, by binary search over selected ids."""
        def first_not_below(d: int) -> int:
            low, high = 0, self.known.n
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if self.base + self.known.select(mid) < d else (low, mid)
            return low + self.nulls
        return range(first_not_below(doc_id), first_not_below(doc_id + 1))

    def rows(self, block: int = 4096) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document; ids and ends are selected for ``block`` documents at a time."""
        start = 0
        for first in range(0, len(self), block):
            at = np.arange(first, min(first + block, len(self)))
            known = (self.known.selects(at[at >= self.nulls] - self.nulls) + self.base).tolist()
            for d, end in zip([None] * (len(at) - len(known)) + known, self.ends.selects(at).tolist()):
                yield d, start, self.ids[start:end]
                start = end


def _files(folder: str):
    """File system and path of a folder, by its address."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, file_ids: int = FILE_IDS,
                 tasks: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write token files in ascending doc_id order.

    Returns the written files: ``part`` (position of the writing task), ``number`` (file in it), ``path``,
    ``n_docs``, ``n_ids``; ordered by (part, number), they hold the documents in ascending doc_id order, rows with a
    null doc_id first. A range shuffle by doc_id gives each task a span of ids; it holds one file at a time. A file is
    written beside its place and moved there, and its name and content follow from its rows, so an attempt that is run
    again replaces it by the same bytes. ``folder`` is reached by ``pyarrow.fs`` and must be shared by all executors.
    """
    small_batches(docs.sparkSession, 256)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        enc, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        held_docs, held_ids, size, number = [], [], 0, 0

        def flush():
            nonlocal held_docs, held_ids, size, number
            path = f"{root}/part-{part:06d}-{number:05d}.eft"
            mine = f"{root}/.{uuid.uuid4().hex}.writing"
            with files.open_output_stream(mine) as f:
                f.write(pack_file(held_docs, held_ids))
            files.move(mine, path)
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [path], "n_docs": [len(held_docs)], "n_ids": [size]})
            held_docs, held_ids, size, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc(text) + end
                if held_ids and size + len(ids) // 4 > file_ids:
                    yield flush()
                held_docs.append(d)
                held_ids.append(ids)
                size += len(ids) // 4
        if held_ids:
            yield flush()

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = tasks or max(text_bytes(cols) // TASK_BYTES + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("number", T.LongType()), T.StructField("path", T.StringType()),
                           T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
    ordered = cols.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(write, schema), "token-files")


def read_tokens(spark: SparkSession, files: DataFrame, folder: str, keep_ids: bool = False) -> DataFrame:
    """Documents of the token files that ``write_tokens`` lists: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    ``start`` counts the ids of all documents before; files' totals are summed first (one row per file).
    """
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).select("path", "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _files(folder)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(path) as f:
                    token_file = TokenFile(f.read())
                rows = [(d, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids) for d, start, ids in token_file.rows()]
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                if keep_ids:
                    cols.append(pa.array([r[4].astype(np.int64) for r in rows], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
                          + [T.StructField("ids", T.ArrayType(T.LongType()))] * keep_ids)
    n = max(1, files.count())
    return placed.repartition(min(n, max(n // 4, spark.sparkContext.defaultParallelism)), "path").mapInArrow(read, schema)


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files in the shared folder and read the documents' places back.

    One row per input row: doc_id, start, n_tokens (with the end id), ids_crc32. A null or empty text has the end id
    alone; rows that repeat a doc_id follow one another, in the order of their texts' hashes; extra columns are
    ignored; an empty table gives no files and no rows.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    files = write_tokens(docs, folder, tokenizer or tokenizer_path("byte_bpe_50k.json"), end_id)
    return read_tokens(docs.sparkSession, files, folder)
