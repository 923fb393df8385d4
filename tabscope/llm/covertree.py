"""Embedding near-duplicates: cover trees per block of vectors, joined pairwise by dual traversal."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import files_freed
from .common import long_schema, materialize, sorted_runs
from .graph import components, local_roots

#: Vectors of one tree: what a task holds of either side of a pair of trees.
BLOCK = 4096
#: Vectors from which the upper levels (cells) are made, and cells at most; both bound what the driver holds and sends.
SAMPLE, CELLS = 2048, 64
#: Trees of a group at most, and bytes of its vectors: a task holds two groups and meets all pairs of their trees.
GROUP, GROUP_BYTES = 8, 1 << 24
#: Copies of trees that a round deals out, as a multiple of all trees, and those of which there is one round only.
ROUND, ONE_ROUND = 1, 128
#: Vectors among which a task that reads the table puts equal ones together.
MEET = 32_768
#: Rounding that bounds on distances allow for.
SLACK = 1e-6
#: Smallest radius of a level; below it stand the vectors themselves.
FINEST = 0.05


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def greedy_cover(x: np.ndarray, radius: float, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Centres (indices into ``x``, the first row among them) more than ``radius`` apart, and each row's centre within it."""
    owner = np.full(len(x), -1)
    centres, left = [], np.arange(len(x))
    while len(left):
        some = left[:chunk]
        near = _distance(x[some], x[some]) <= radius
        open_, picked = np.ones(len(some), dtype=bool), []
        for i in range(len(some)):
            if open_[i]:
                picked.append(i)
                open_ &= ~near[i]
        new = some[picked]
        far = _distance(x[left], x[new])
        best = np.argmin(far, axis=1)
        inside = far[np.arange(len(left)), best] <= radius
        own = np.isin(left, new)
        owner[left[inside]] = len(centres) + best[inside]
        owner[new] = np.arange(len(centres), len(centres) + len(new))
        centres.extend(new.tolist())
        left = left[~(inside | own)]
    return np.array(centres), owner


class CoverTree:
    """Nested levels over unit vectors: radii 2, 1, 1/2, ... and last the vectors themselves.

    A node of a level covers its vectors within the level's radius and the centres of its children are further apart
    than theirs; a node is the first of its own children. The vectors are stored so that every node's are consecutive:
    ``levels`` holds per level the nodes' first and last position, true covering radius, and range of children.
    """

    def __init__(self, x: np.ndarray, finest: float = FINEST):
        order = np.arange(len(x))
        starts, ends, levels, radius = np.array([0]), np.array([len(x)]), [], 2.0
        while True:
            levels.append([starts, ends])
            if radius <= finest or len(starts) == len(x):
                break
            radius /= 2
            new_s, new_e = [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s == 1:
                    new_s.append(s)
                    new_e.append(e)
                    continue
                mine = order[s:e]
                centres, owner = greedy_cover(x[mine], radius)
                leads = np.ones(len(mine), dtype=int)
                leads[centres] = 0
                by = np.lexsort((leads, owner))  # a node's centre comes first
                order[s:e] = mine[by]
                cuts = s + np.r_[0, np.cumsum(np.bincount(owner, minlength=len(centres)))]
                new_s += cuts[:-1].tolist()
                new_e += cuts[1:].tolist()
            starts, ends = np.array(new_s), np.array(new_e)
        if len(starts) < len(x):
            levels.append([np.arange(len(x)), np.arange(1, len(x) + 1)])
        self.order, self.x = order, x[order]
        reaches = []
        for s, e in levels:
            node = np.repeat(np.arange(len(s)), e - s)
            reach = np.zeros(len(s))
            np.maximum.at(reach, node, np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", self.x, self.x[s[node]]), 0)))
            reaches.append(np.where(e - s == 1, 0.0, reach))
        self._link([s for s, _ in levels], reaches)

    def _link(self, starts: list[np.ndarray], reaches: list[np.ndarray]) -> None:
        """``levels`` from the nodes' first positions and radii; a level's nodes follow each other."""
        self.x32, self.levels = self.x.astype(np.float32), []
        for k, (s, reach) in enumerate(zip(starts, reaches)):
            e = np.append(s[1:], len(self.x))
            below = starts[k + 1] if k + 1 < len(starts) else np.arange(len(s) + 1)
            first = np.searchsorted(below, s)
            last = np.searchsorted(below, e) if k + 1 < len(starts) else first
            self.levels.append((s, e, reach, first, last))

    def pack(self, v: np.ndarray, ids: np.ndarray, n: np.ndarray) -> bytes:
        """The tree with its vectors as they were read (``v``, in the order of the rows it was made of), their ids and weights."""
        levels = zlib.compress(pickle.dumps([(s.astype(np.int32), reach) for s, _, reach, _, _ in self.levels]), 1)
        return pickle.dumps((v[self.order], ids[self.order], zlib.compress(n[self.order].tobytes(), 1), levels))

    @classmethod
    def unpack(cls, data: bytes) -> tuple[CoverTree, np.ndarray, np.ndarray]:
        """The tree, and ids and weights in the order of its vectors."""
        v, ids, n, levels = pickle.loads(data)
        tree = cls.__new__(cls)
        tree.order, tree.x = np.arange(len(v)), _unit(v)
        tree._link(*zip(*((s.astype(np.int64), reach) for s, reach in pickle.loads(zlib.decompress(levels)))))
        return tree, ids, np.frombuffer(zlib.decompress(n), np.int64)


class Joined:
    """All links between two trees (or within one): sums of linked weights per vector and connected roots."""

    def __init__(self, a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, cosine: float, rows: int = 512):
        self.a, self.b, self.cosine, self.tau = a, b, cosine, float(np.sqrt(2 - 2 * cosine))
        self.na, self.nb = len(a.x), len(b.x)
        self.a32, self.b32 = a.x32, b.x32
        self.single = (a.x.shape[1] + 8) * 2.0 ** -22  # more than the error of a cosine in single precision
        self.sum_a, self.sum_b = np.r_[0, np.cumsum(wa[a.order])], np.r_[0, np.cumsum(wb[b.order])]
        self.add_a, self.add_b = np.zeros(self.na + 1, dtype=np.int64), np.zeros(self.nb + 1, dtype=np.int64)
        self.chain_a, self.chain_b = np.zeros(self.na + 1, dtype=np.int64), np.zeros(self.nb + 1, dtype=np.int64)
        self.label = np.arange(self.na + self.nb)
        depth = max(len(a.levels), len(b.levels))
        level = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]
        root = np.array([0])
        open_a, open_b = self._compare(level(a, 0), level(b, 0), root, root, root, root, np.ones((1, 1), dtype=bool))
        for k in range(depth - 1):
            # open_a (sorted), open_b: the pairs of nodes of this level whose children are still to be compared
            parents, at = np.unique(open_a, return_inverse=True)
            ia, own_a = _children(a, k, parents)
            found = []
            for lo in range(0, len(ia), rows):
                some, own = ia[lo:lo + rows], own_a[lo:lo + rows]
                here = slice(np.searchsorted(at, own[0]), np.searchsorted(at, own[-1], side="right"))
                others, col = np.unique(open_b[here], return_inverse=True)
                still = np.zeros((own[-1] - own[0] + 1, len(others)), dtype=bool)
                still[at[here] - own[0], col] = True
                ib, own_b = _children(b, k, others)
                found.append(self._compare(level(a, k + 1), level(b, k + 1), some, ib, own - own[0], own_b, still))
            if not found:
                break
            open_a, open_b = (np.concatenate(x) for x in zip(*found))
            by = np.argsort(open_a, kind="stable")
            open_a, open_b = open_a[by], open_b[by]
        for chain, base, n in ((self.chain_a, 0, self.na), (self.chain_b, self.na, self.nb)):
            at = base + np.flatnonzero(np.cumsum(chain[:n]) > 0)
            self.label = local_roots(len(self.label), at, at + 1, self.label)

    def _compare(self, la, lb, ia, ib, own_a, own_b, still):
        """Prune, accept or leave open the node pairs ia x ib by their centres' distance and covering radii.

        Only pairs whose parents (``own_a``, ``own_b``) are ``still`` open count. Nodes without a radius are compared
        apart from the others, as their bound is much tighter. Returns the pairs that stay open.
        """
        left = [(ia[:0], ib[:0])]
        for na in (la[2][ia] == 0, la[2][ia] > 0):
            for nb in (lb[2][ib] == 0, lb[2][ib] > 0):
                if na.any() and nb.any():
                    left.append(self._settle(la, lb, ia[na], ib[nb], own_a[na], own_b[nb], still))
        return tuple(np.concatenate(x) for x in zip(*left))

    def _settle(self, la, lb, ia, ib, own_a, own_b, still):
        sa, ea, ra = la[0][ia], la[1][ia], la[2][ia]
        sb, eb, rb = lb[0][ib], lb[1][ib], lb[2][ib]
        reach = min(self.tau + SLACK + ra.max() + rb.max(), 2.0)
        near = self.a32[sa] @ self.b32[sb].T >= 1 - reach * reach / 2 - self.single  # what the widest bound leaves
        i, j = np.divmod(np.flatnonzero(near), len(ib))
        open_ = still[own_a[i], own_b[j]]
        i, j = i[open_], j[open_]
        if not len(i):
            return ia[:0], ib[:0]
        if len(i) * 8 > len(ia) * len(ib):
            dot = (self.a.x[sa] @ self.b.x[sb].T)[i, j]
        else:
            dot = np.einsum("ij,ij->i", self.a.x[sa[i]], self.b.x[sb[j]])
        far, spread = np.sqrt(np.maximum(2 - 2 * dot, 0)), ra[i] + rb[j]
        linked = np.where(spread == 0, dot >= self.cosine, far + spread <= self.tau - SLACK)
        if linked.any():
            li, lj = i[linked], j[linked]
            for add, chain, s, e, mine, other in (
                    (self.add_a, self.chain_a, sa, ea, li, (self.sum_b[eb] - self.sum_b[sb])[lj]),
                    (self.add_b, self.chain_b, sb, eb, lj, (self.sum_a[ea] - self.sum_a[sa])[li])):
                total = np.zeros(len(s), dtype=np.int64)
                np.add.at(total, mine, other)
                np.add.at(add, s, total)
                np.add.at(add, e, -total)
                hit = np.unique(mine)
                np.add.at(chain, s[hit], 1)
                np.add.at(chain, e[hit] - 1, -1)
            self.label = local_roots(len(self.label), sa[li], self.na + sb[lj], self.label)
        open_ = ~linked & (spread > 0) & (far - spread <= self.tau + SLACK)
        return ia[i[open_]], ib[j[open_]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked weight of each vector of a and of b, in their trees' order."""
        return np.cumsum(self.add_a[:-1]), np.cumsum(self.add_b[:-1])


def _children(tree: CoverTree, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes of level ``k`` (of a tree's last level: the nodes) and for each the index of its parent in ``nodes``."""
    if k + 1 >= len(tree.levels):
        return nodes, np.arange(len(nodes))
    first, n = tree.levels[k][3][nodes], tree.levels[k][4][nodes] - tree.levels[k][3][nodes]
    own = np.repeat(np.arange(len(nodes)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own], own


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths; zeros without a sign."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) + 0


def _lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def _classes(v: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of ``v``, the least id and the sum of the weights of each, and where each occurs."""
    rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1])))[:, 0]
    _, first, of = np.unique(rows, return_index=True, return_inverse=True)
    least, total = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), dtype=np.int64)
    np.minimum.at(least, of, ids)
    np.add.at(total, of, n)
    return v[first], least, total, first


def _unit(rows: np.ndarray | list[np.ndarray]) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64) if isinstance(rows, np.ndarray) else np.stack(rows).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres of the finest level of the sample's cover tree that has at most ``most`` nodes."""
    best, radius = np.array([0]), 2.0
    while radius > FINEST:
        radius /= 2
        centres, _ = greedy_cover(sample, radius)
        if len(centres) > most:
            break
        best = centres
    return sample[best]


def near_pairs(rows: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame | None:
    """(id, links, root) for vectors of ``rows`` (id, h, v: vectors of one length and their hashes) that link to others.

    Equal vectors are one of weight n under their least id. Rows of one id add up: ``links`` are weights of linked
    vectors, ``root`` an id it is connected to. The upper level is a cover of a bounded sample, whose centres are the
    cells; a cell's vectors are dealt by their hash into blocks of about ``block`` (so no cell is too large for a task)
    and each block becomes a cover tree. Groups of consecutive blocks meet in pairs, a pair in a task: there pairs of
    blocks and then of nodes are pruned by their covering radii, and those that are left traversed. Pairs of groups go in
    rounds that deal out about as many trees as there are, so that the disk follows the vectors, not their pairs.
    """
    spark = rows.sparkSession
    picked = rows.groupBy("h").agg(F.min("id").alias("id")).orderBy("h").limit(SAMPLE)
    sample = rows.join(F.broadcast(picked), ["h", "id"]).dropDuplicates(["h"]).orderBy("h").select("v").collect()
    if not sample:
        return None
    centres = _cells(_unit([np.array(r["v"]) for r in sample]), CELLS)

    def nearest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = _distance(_unit(v), centres)
        cell = np.argmin(far, axis=1)
        return cell, far[np.arange(len(cell)), cell]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = nearest(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(far)], names=["h", "cell", "far"])

    assigned = rows.select("h", "v").mapInArrow(assign, "h long, cell long, far double")
    cells = {r["cell"]: (r["n"], r["reach"]) for r in assigned.groupBy("cell", "h").agg(F.max("far").alias("far"))
             .groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("reach")).collect()}
    parts = np.array([-(-cells[c][0] // block) if c in cells else 1 for c in range(len(centres))])
    first = np.r_[0, np.cumsum(parts)]
    blocks = int(first[-1])
    # two groups fit in a task, and there are so many that the pairs of a round, and all of them, occupy the cores twice
    cores, copies = spark.sparkContext.defaultParallelism, max(ROUND * blocks, ONE_ROUND)
    group = max(1, min(GROUP, GROUP_BYTES // (block * centres.shape[1] * 8), copies // (4 * cores), int(blocks / (2 * cores ** 0.5))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, h = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
            v, ids, n, some = _classes(np.concatenate([_matrix(b.column(2)) for b in held]), ids, np.ones(len(ids), dtype=np.int64))
            cell = nearest(v)[0]
            return pa.RecordBatch.from_arrays([pa.array(first[cell] + h[some] % parts[cell]), pa.array(ids), pa.array(n), _lists(v)], names=["block", "id", "n", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= MEET:
                yield met(held)
                held = []
        if held:
            yield met(held)

    dealt = rows.select("id", "h", "v").mapInArrow(deal, T.StructType([*long_schema("block", "id", "n").fields, rows.schema["v"]]))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["block"]):
            v, ids, n, _ = _classes(np.stack(list(run["v"])), run["id"].astype(np.int64), run["n"].astype(np.int64))
            tree, at = CoverTree(_unit(v)), int(run["block"][0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([at // group]), pa.array([int(np.searchsorted(first, at, side="right")) - 1]), pa.array([tree.x[0].tolist()], pa.list_(pa.float64())),
                 pa.array([float(tree.levels[0][2][0])]), pa.array([tree.pack(v, ids, n)], pa.binary())], names=["block", "grp", "cell", "centre", "reach", "tree"])

    trees = materialize(dealt.repartition(max(blocks, cores), "block").sortWithinPartitions("block", "id")
                        .mapInArrow(build, "block long, grp long, cell long, centre array<double>, reach double, tree binary"), "cover-trees")
    tau = float(np.sqrt(2 - 2 * cosine)) + SLACK
    near = [(int(c), int(d)) for c, (_, rc) in cells.items() for d, (_, rd) in cells.items()
            if c == d or _distance(centres[[c]], centres[[d]])[0, 0] <= rc + rd + tau]
    heads = trees.select("block", "grp", "cell", "centre", "reach")
    other = heads.select(*(F.col(c).alias(f"{c}_b") for c in heads.columns))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    cell_pairs = F.broadcast(spark.createDataFrame(near, "cell long, cell_b long"))  # at most CELLS ** 2 rows
    pairs = (heads.join(cell_pairs, "cell").join(other, "cell_b").where(F.col("block") <= F.col("block_b"))
             .where(apart <= F.col("reach") + F.col("reach_b") + F.lit(tau)).select("grp", "grp_b").distinct())
    # a row's place in its part of the table tells its round
    pairs = materialize(pairs.withColumn("k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "cover-pairs")
    n_pairs = pairs.count()
    rounds = -(-2 * group * n_pairs // copies)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["grp_a"], row["grp_b"]) != now:
                    if held:
                        yield from meet(*now, held)
                    now, held = (row["grp_a"], row["grp_b"]), []
                held.append((row["grp"], np.array(row["centre"]), row["reach"], *CoverTree.unpack(row["tree"])))
        if held:
            yield from meet(*now, held)

    def meet(grp_a: int, grp_b: int, held: list) -> Iterator[pa.RecordBatch]:
        """Links of all pairs of trees of two groups, or of one: a row for each vector that has some."""
        begin = np.r_[0, np.cumsum([len(ids) for *_, ids, _ in held])]
        links, one, two = np.zeros(begin[-1], dtype=np.int64), [], []
        for i, (ga, centre_a, reach_a, a, _, wa) in enumerate(held):
            for j, (gb, centre_b, reach_b, b, _, wb) in enumerate(held):
                if j < i or (ga, gb) != (grp_a, grp_b) or np.linalg.norm(centre_a - centre_b) > reach_a + reach_b + tau:
                    continue
                join = Joined(a, b, wa, wb, cosine)
                links_a, links_b = join.links()
                links[begin[i]:begin[i + 1]] += links_a
                links[begin[j]:begin[j + 1]] += links_b if i < j else -wa  # within a tree either side meets all; a vector is no link of its own
                place = np.r_[begin[i]:begin[i + 1], begin[j]:begin[j + 1]]
                some = np.flatnonzero(join.label != np.arange(len(place)))
                one.append(place[some])
                two.append(place[join.label[some]])
        hit = np.flatnonzero(links > 0)
        if len(hit):
            ids, label = np.concatenate([x[4] for x in held]), local_roots(len(links), np.concatenate(one), np.concatenate(two))
            yield pa.RecordBatch.from_pydict({"id": ids[hit], "links": links[hit], "root": ids[label[hit]]})

    found = None
    batch_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row holds a tree
    try:
        for k in range(rounds):
            mine = pairs.where(F.col("k") % rounds == k).select(F.col("grp").alias("grp_a"), "grp_b")
            ends = mine.select("grp_a", "grp_b", F.explode(F.array_distinct(F.array("grp_a", "grp_b"))).alias("grp"))
            work = trees.select("grp", "block", "centre", "reach", "tree").join(F.broadcast(ends), "grp")  # the pairs of a round are fewer than the trees
            work = work.repartition(-(-4 * n_pairs // rounds), "grp_a", "grp_b").sortWithinPartitions("grp_a", "grp_b", "block")
            some = materialize(work.select("grp_a", "grp_b", "grp", "centre", "reach", "tree").mapInArrow(traverse, long_schema("id", "links", "root")), "cover-links")
            found = some if found is None else found.union(some)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, ``n_links``, ``component_id``, ``kept``.

    Two vectors link if their cosine, in double precision, is at least ``cosine``; their length has to be the same.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, link with
    nothing. A vec_id names one vector: rows that repeat it with other components share its component. Repeated rows
    link with each other and count one by one; extra columns are ignored; an empty table gives no rows.

    Equal vectors are one weighted vector: those that a task reads before they are dealt, the others in their tree.
    Their rows find them again by two 64-bit hashes.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    e = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    # a maximum counts NaN as the largest and leaves nulls out
    high, low, limit = F.array_max(e), F.array_min(e), F.lit(float("inf"))
    usable = F.col("vec_id").isNotNull() & ~F.exists(e, lambda x: x.isNull()) & (high < limit) & (low > -limit) & ((high != 0) | (low != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), e).alias("v"))
    keys = [F.when(F.col("v").isNotNull(), x).alias(c) for c, x in (("h", F.xxhash64("v")), ("h2", F.xxhash64(F.lit(1), "v")))]
    known = rows.where("v IS NOT NULL").select(F.col("vec_id").alias("id"), *keys, "v")
    found = None
    with files_freed(spark, batch_rows=1000):
        for length in sorted(r["k"] for r in known.select(F.size("v").alias("k")).distinct().collect()):
            some = near_pairs(known.where(F.size("v") == length).select("id", "h", "v"), cosine, block)
            found = found if some is None else some if found is None else found.union(some)
        if found is None:
            return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
        roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "cover-classes")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = known.groupBy("h", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    named = (classes.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
             .where("n > 1 OR links IS NOT NULL").select("h", "h2", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "root"))
    component = F.coalesce("root", "id", "vec_id")
    return rows.select("vec_id", *keys).join(named, ["h", "h2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
