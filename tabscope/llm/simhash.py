"""SimHash near-duplicates: word-shingle fingerprints, BK-trees over shards, connected classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_schema, materialize, small_batches, sorted_runs, words_of
from .graph import components, local_roots

SEED = 42
#: Fingerprints of one tree. Shards are cut so that they hold up to about as many; larger ones are dealt into blocks of this size.
BLOCK = 4096
#: Rejected doc_ids up to which they are sent to the documents (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text: XXH64 of each run of ``shingle`` words (A-Z lower-cased, joined by a space).

    A text with fewer words has one shingle of all its words; null or wordless texts have fingerprint 0.
    """
    words = [] if not text else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-shingle]).tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    for i in range(0, n, 65536):
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[i:i + 65536], stops[i:i + 65536])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


class BKTree:
    """Distinct 64-bit values; the children of a node are keyed by their Hamming distance to the node's value.

    A subtree of at most ``leaf`` values stays a plain list that is compared directly. ``followed`` counts the edges that
    queries have taken.
    """

    def __init__(self, values: np.ndarray, leaf: int = 8):
        self.values, self.followed = values, 0
        self.root: tuple = (np.arange(len(values)), None)
        todo = [self.root] if len(values) <= leaf else []
        if len(values) > leaf:
            self.root = (0, {})
            todo = [(self.root, np.arange(1, len(values)))]
            while todo:
                (pivot, children), rest = todo.pop()
                far = np.bitwise_count(values[rest] ^ values[pivot])
                order = np.argsort(far, kind="stable")
                rest, far = rest[order], far[order]
                cuts = np.flatnonzero(np.diff(far)) + 1
                for part, d in zip(np.split(rest, cuts), far[np.r_[0, cuts]].tolist() if len(far) else []):
                    if len(part) <= leaf:
                        children[d] = (part, None)
                    else:
                        children[d] = (int(part[0]), {})
                        todo.append((children[d], part[1:]))

    def within(self, queries: np.ndarray, radius: int, chunk: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index arrays (query, value) of all pairs within ``radius``, for some queries at a time."""
        for begin in range(0, len(queries), chunk):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            todo = [(self.root, np.arange(begin, min(begin + chunk, len(queries))))]
            while todo:
                (here, children), asked = todo.pop()
                if children is None:
                    q, v = np.nonzero(np.bitwise_count(queries[asked][:, None] ^ self.values[here][None, :]) <= radius)
                    found.append((asked[q], here[v]))
                    continue
                far = np.bitwise_count(queries[asked] ^ self.values[here]).astype(np.int16)
                hit = asked[far <= radius]
                found.append((hit, np.full(len(hit), here)))
                for d, child in children.items():  # only edges that the triangle inequality leaves open
                    going = asked[np.abs(far - d) <= radius]
                    if len(going):
                        self.followed += len(going)
                        todo.append((child, going))
            yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _stars(values: np.ndarray, block: np.ndarray, left: int, right: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value linked to it) inside one shard, or between two blocks of a large shard."""
    if len(values) == 2 and left == right:
        if (int(values[0]) ^ int(values[1])).bit_count() > radius:
            return values[:0], values[:0]
        return values[:1], values[1:]
    order = np.argsort(values.view(np.int64), kind="stable")
    values, block = values[order], block[order]
    tree_at = np.flatnonzero(block == left)
    query_at = tree_at if left == right else np.flatnonzero(block == right)
    label = np.arange(len(values))
    tree = BKTree(values[tree_at])
    for q, v in tree.within(values[query_at], radius):
        label = local_roots(len(values), query_at[q], tree_at[v], label)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def shard_bits(n: int, radius: int = 3, block: int = BLOCK) -> int:
    """Leading bits of a band that name a shard: with them, ``n`` spread values make shards of at most ``block``."""
    narrowest = 64 // (radius + 1)
    return min(max(-(-n // block) - 1, 0).bit_length(), narrowest)


def links(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Star edges (a, b) that connect the distinct fingerprints ``fp`` (long) just as all pairs within ``radius`` do.

    Fingerprints are cut into ``radius + 1`` bands of bits; two of them that differ in at most ``radius`` bits
    agree on a band, so also on its leading bits, and every link lies inside a shard (band, leading bits). The number of
    leading bits follows from the number of fingerprints, so that a shard is a BK-tree of some thousand values at every
    size; all its members query it. A shard of more than ``block`` values is dealt into blocks by hash, and each pair of
    blocks goes to a task of its own, one as the tree and the other as the queries: trees travel to their queries by
    the shuffle, since a broadcast of a shard has no bound.
    """
    bits = shard_bits(prints.count(), radius, block)
    bands = radius + 1 if bits else 1  # without bits, one shard holds all values
    ends = [64 * (i + 1) // (radius + 1) for i in range(bands)]
    fp = F.col("fp")
    keys = F.array(*(F.concat_ws(":", F.lit(i), F.shiftrightunsigned(fp, end - bits).bitwiseAND(F.lit((1 << bits) - 1)))
                     if bits else F.lit("0") for i, end in enumerate(ends)))
    sharded = prints.select("fp", F.explode(keys).alias("shard_name")).select(
        "fp", F.xxhash64("shard_name").alias("shard"))
    sizes = sharded.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
    dealt = sharded.join(sizes, "shard").select(
        "fp", "shard", blocks.alias("m"), F.pmod(F.xxhash64("fp", F.lit(7)), blocks).alias("block"))
    paired = dealt.select("fp", "shard", "block", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")).select(
        "fp", "shard", "block", F.least("block", "other").alias("l"), F.greatest("block", "other").alias("r"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b, held = [], [], 0
        for run in sorted_runs(batches, ["shard", "l", "r"]):
            if len(run["fp"]) < 2:
                continue
            a, b = _stars(run["fp"].astype(np.int64).view(np.uint64), run["block"], run["l"][0], run["r"][0], radius)
            if len(a):
                out_a.append(a.view(np.int64))
                out_b.append(b.view(np.int64))
                held += len(a)
            if held > 50_000:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
                out_a, out_b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    dealt_out = paired.repartition("shard", "l", "r").sortWithinPartitions("shard", "l", "r", "fp")
    return dealt_out.mapInArrow(search, long_schema("a", "b"))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, h (hash of the text), fp (long) of every row's whole text."""
    small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "h", "fp"])

    text = F.col("text").cast("string")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return ids.mapInArrow(hashed, long_schema("doc_id", "h", "fp"))


def simhash_classes(docs: DataFrame, shingle: int = 3, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text; other columns are ignored).

    One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id that
    links within ``radius`` bits reach, itself included), ``copies`` (rows with the same fingerprint).
    Null, empty and wordless texts have fingerprint 0 and link like any other; repeated rows are returned as
    often as they come; rows with a null doc_id take part in links, and component_id is null only where a whole
    class has no doc_id. An empty table gives no rows.

    Rows with one fingerprint meet only in a count and a minimum, which combine before the shuffle; the search
    runs over distinct fingerprints.
    """
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")),
                           "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius, block), "simhash-classes")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = (rooted.join(least, "root").where("copies > 1 OR NOT component_id <=> least_id")
               .select("fp", "component_id", "copies"))
    return prints.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` without the near-duplicates: of each class one row stays, that of the smallest doc_id.

    Rows are told apart by doc_id and text: unlike texts of one doc_id that are in different classes all stay; in one
    class the text of least hash stays, and of rows alike in both, one. Rows without a doc_id go where their class has a
    row with one; a class without any keeps one row.
    """
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    alike = materialize(prints.groupBy("doc_id", "h", "fp").agg(F.count("*").alias("rows")), "simhash-rows")
    roots = components(links(alike.select("fp").distinct(), radius, BLOCK), "simhash-classes")
    rooted = alike.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = rooted.groupBy("root").agg(F.min(order).alias("first"), F.sum("rows").alias("rows")).where("rows > 1").select("root", "first")
    member = rooted.join(first, "root")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    marked = materialize(member.select("doc_id", "h", same.alias("kept"), "rows").where("NOT kept OR rows > 1"), "simhash-gone")
    named = marked.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("kept").alias("_kept"))
    named = F.broadcast(named) if marked.count() <= BROADCAST_IDS else named
    key = F.xxhash64(F.col("text").cast("string"))
    cond = F.col("doc_id").cast("long").eqNullSafe(named["_id"]) & (key == named["_h"])
    kept = docs.join(named.where("NOT _kept"), cond, "left_anti").select(docs.columns)
    repeated = named.where("_kept")
    if marked.where("kept").isEmpty():
        return kept
    again = kept.join(repeated, cond, "left_semi").select(docs.columns)
    one = again.withColumn("_h", key).dropDuplicates(["doc_id", "_h"]).select(docs.columns)
    return kept.join(repeated, cond, "left_anti").select(docs.columns).union(one)
