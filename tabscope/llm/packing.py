"""Best-fit packing of documents into sequences: linear grouping, configurations, best fit by length."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches
from .tokens import encoder, tokenizer_path

#: Equal-cardinality groups of the large lengths, and the share of the capacity above which a length is large.
GROUPS = 512
LARGE = 1 / 4
#: Pieces of one length that are numbered in one window.
WINDOW_ROWS = 4096


class Run(NamedTuple):
    """``n`` sequences of one make: (length, copies) in their order."""

    n: int
    items: tuple[tuple[int, int], ...]


def _fill(room: int, sizes: list[tuple[int, int, int]]) -> dict[int, int]:
    """Copies of each group that fill ``room`` best: a bounded subset sum over (group, size, available)."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for g, size, have in sizes:
        for _ in range(min(have, room // size)):
            steps.append((g, size, reach))
            reach |= (reach << size) & mask
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for g, size, before in reversed(steps):
        if not before >> at & 1:
            chosen[g] += 1
            at -= size
    return chosen


def _large_runs(counts: list[tuple[int, int]], capacity: int, groups: int) -> list[Run]:
    """Runs of the large lengths (length, count), longest first.

    Linear grouping: the lengths in descending order are cut into groups of equal cardinality and each counts as its
    group's largest. Over these few sizes, configurations are chosen one after the other: the largest size left, and
    beside it what fills the room best; each is used as often as its groups allow. Then the actual lengths take the
    slots of their groups, so no sequence can overflow.
    """
    total = sum(c for _, c in counts)
    per = -(-total // groups) if total else 1
    queues: list[deque] = []
    room = 0
    for length, count in counts:
        while count:
            if not room:
                queues.append(deque())
                room = per
            take = min(count, room)
            queues[-1].append([length, take])
            count, room = count - take, room - take
    size = [q[0][0] for q in queues]
    left = [sum(c for _, c in q) for q in queues]
    runs: list[Run] = []
    for g in range(len(queues)):
        while left[g]:
            config = _fill(capacity - size[g], [(h, size[h], left[h] - (h == g)) for h in range(g, len(queues)) if left[h] - (h == g) > 0])
            config[g] += 1
            times = min(left[h] // m for h, m in config.items())
            slots = [h for h, m in sorted(config.items()) for _ in range(m)]
            for h, m in config.items():
                left[h] -= m * times
            taken = []
            for h in slots:  # the next `times` actual lengths of the group, as segments
                need, segments = times, []
                while need:
                    head = queues[h][0]
                    k = min(need, head[1])
                    segments.append([head[0], k])
                    head[1] -= k
                    need -= k
                    if not head[1]:
                        queues[h].popleft()
                taken.append(deque(segments))
            while taken[0]:
                n = min(t[0][1] for t in taken)
                runs.append(Run(n, tuple((t[0][0], 1) for t in taken)))
                for t in taken:
                    t[0][1] -= n
                    if not t[0][1]:
                        t.popleft()
    return runs


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> list[Run]:
    """Sequences for ``histogram`` (length: pieces, lengths from 1 to ``capacity``).

    Large lengths go by linear grouping; each smaller length, longest first, then goes to the fullest sequences that
    still hold it, and to new ones if none does. Works on counts alone: its time and its result depend on how many
    lengths there are (at most ``capacity``), not on how many pieces.
    """
    order = sorted(((n, c) for n, c in histogram.items() if c), reverse=True)
    runs = [Run(c, ((n, 1),)) for n, c in order if n == capacity]
    runs += _large_runs([(n, c) for n, c in order if capacity * large < n < capacity], capacity, groups)
    open_runs: dict[int, list[Run]] = defaultdict(list)
    for r in runs:
        open_runs[capacity - sum(n * c for n, c in r.items)].append(r)
    rooms = sorted(open_runs)
    for n, c in order:
        if n > capacity * large:
            continue
        while c:
            at = bisect_left(rooms, n)
            room = rooms[at] if at < len(rooms) else capacity
            fits = room // n
            here = open_runs[room].pop() if at < len(rooms) else Run(-(-c // fits), ())
            if at < len(rooms) and not open_runs[room]:
                rooms.pop(at)
                del open_runs[room]
            copies, used = (fits, min(here.n, c // fits)) if c >= fits else (c, 1)
            for run, space in ((Run(used, (*here.items, (n, copies))), room - copies * n), (Run(here.n - used, here.items), room)):
                if run.n and run.items:
                    if space not in open_runs:
                        insort(rooms, space)
                    open_runs[space].append(run)
            c -= copies * used
    return [r for space in sorted(open_runs) for r in open_runs[space]]


def slots(runs: list[Run]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), sorted: where the pieces of a length go, by rank.

    Of a length's pieces from ``first rank`` on, each ``copies`` go side by side into the next sequence.
    """
    rows, rank, sequence = [], defaultdict(int), 0
    for run in runs:
        offset = 0
        for n, copies in run.items:
            rows.append((n, rank[n], copies, sequence, offset))
            rank[n] += run.n * copies
            offset += n * copies
        sequence += run.n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Pieces of every whole text with its end id: doc_id, piece, start, length, ids_crc32 and, if asked, ids (bytes)."""
    small_batches(docs.sparkSession, 256)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer).encode, struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    kinds = [T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def place(pieces: DataFrame, runs: list[Run], largest: int, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each takes the slot of its rank among the pieces of its length.

    Ranks need no window over a whole length: the pieces of a length are dealt by hash into windows of about
    ``window_rows`` rows (``largest``: pieces of the commonest length), whose counts give each its first rank.
    """
    table = slots(runs)
    shift = 1 << 44
    code = table[:, 0] * shift + table[:, 1]
    salts = max(1, -(-largest // window_rows))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)
    cols = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(cols.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(cols)).to_numpy(zero_copy_only=False)
            slot = table[np.searchsorted(code, n * shift + rank, side="right") - 1]
            nth = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(cols)], pa.array(slot[:, 3] + nth // slot[:, 2]), pa.array(slot[:, 4] + nth % slot[:, 2] * n)],
                                             names=[*cols, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*cols, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Place the documents (doc_id, text) in sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` with ``keep_ids``).
    Only documents longer than ``capacity`` are cut. Null and empty texts are their end id alone; rows that repeat a
    doc_id, or have none, are each placed; extra columns are ignored; an empty table gives no rows. Pieces of one
    length are interchangeable, so the plan is made from the count per length (at most ``capacity`` rows on the
    driver) and a piece finds its place by its rank among those of its length.
    """
    pieces = materialize(encode_pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id, capacity, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(pieces, plan(histogram, capacity), max(histogram.values(), default=0))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of ``pack(..., keep_ids=True)``: sequence_id, ids (little-endian 32-bit, in offset order), length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most `capacity` ids
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, p: F.concat(out, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
