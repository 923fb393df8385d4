"""Top-k search (R5-R9, J3): posting blocks with their largest weights, blocks of chunks against blocks of queries,
and inverted cells of coded vectors.

Chunks are numbered in (doc_id, chunk_no) order and cut into blocks of ``BLOCK``; the index tables are
  numbers  (doc_id, chunk_no, cid, block)
  lexical  (term, block, top, at, w)      postings of a term in a block, ``top`` the largest weight
  dense    (block, n, at, bucket, w)      hashed vectors of a block's chunks
They come from ``retrieval.build_index`` tables (in memory or read from Parquet) and can be stored beside them. An index
in memory gives its parts as blocks instead (``termparts.blocks``), whose postings stand under the hashes of their terms.
Queries may be any number, with ids of any type: they are numbered and cut into blocks too, and none are collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import safe_round as R
from ..session import cut_lineage
from . import wordhash
from .window import global_row_index

#: Chunks in a block, and queries in a block of queries.
BLOCK = 256
QUERIES = 256
#: Scores are reported and ranked to six digits: what could round up to the k-th best is not skipped.
SLACK = 1e-6


def _field(name: str, out: str | None = None):
    """The field ``name`` of all structs of the array ``e``."""
    return F.transform("e", lambda x: x[name]).alias(out or name)


def search_tables(index: dict[str, DataFrame], block: int = BLOCK) -> dict[str, DataFrame]:
    """Block tables of an index (see the module's head)."""
    keys = ["doc_id", "chunk_no"]
    numbers = global_row_index(index["chunks"].select(*keys), keys, out="cid")
    numbers = cut_lineage(numbers.select(*keys, F.col("cid").cast("long").alias("cid"), F.floor(F.col("cid") / block).alias("block")))
    at = (F.col("cid") - F.col("block") * block).cast("int").alias("at")

    def lists(df, *cols):
        entry = F.sort_array(F.collect_list(F.struct(*cols)))
        return df.agg(entry.alias("e")), [_field(c) for c in cols]

    post, cols = lists(index["postings"].join(numbers, keys).select("term", "block", at, "w").groupBy("term", "block"), "at", "w")
    lexical = post.select("term", "block", F.array_max(_field("w")).alias("top"), *cols)
    vecs, cols = lists(index["dense"].join(numbers, keys).select("block", at, "bucket", "w").groupBy("block"), "at", "bucket", "w")
    sizes = numbers.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("n"))
    dense = sizes.join(vecs.select("block", *cols), "block", "left")
    return {"numbers": numbers, "lexical": lexical, "dense": dense}


# ---------------------------------------------------------------- R6, J3

def lexical_search(tables: dict[str, DataFrame], weights: DataFrame, k: int = 8, probe: int = 4) -> DataFrame:
    """R6 (J3): the k chunks of largest dot product per query, exactly: query_id, rank, doc_id, chunk_no, lexical.

    ``weights`` (query_id, term, qw) are the queries' TF-IDF weights. A block cannot score above the sum of qw * top
    over the query's terms. The ``probe`` blocks of largest bound give each query a k-th best score; of the others
    only blocks whose bound reaches it are scored. Equal scores go by (doc_id, chunk_no).
    """
    thin = tables["lexical"].select("term", "block", "top")
    bounds = cut_lineage(weights.join(thin, "term").groupBy("query_id", "block").agg(F.sum(F.col("qw") * F.col("top")).alias("bound")))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    probed = bounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= probe).select("query_id", "block")
    first = cut_lineage(_block_scores(tables, weights, probed))
    best = Window.partitionBy("query_id").orderBy(F.desc("lexical"))
    kth = first.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("query_id", F.col("lexical").alias("_kth"))
    rest = bounds.join(probed, ["query_id", "block"], "left_anti").join(kth, "query_id", "left")
    rest = rest.where(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth") - SLACK)).select("query_id", "block")
    scores = first.unionByName(_block_scores(tables, weights, rest))
    by = Window.partitionBy("query_id").orderBy(F.desc("lexical"), "cid")
    top = scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return top.join(tables["numbers"].select("cid", "doc_id", "chunk_no"), "cid").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "chunk_no", "lexical")


def _block_scores(tables: dict[str, DataFrame], weights: DataFrame, blocks: DataFrame) -> DataFrame:
    """Scores of the chunks in the given (query_id, block): query_id, cid, lexical (six digits)."""
    wanted = weights.join(blocks, "query_id")
    hit = wanted.join(tables["lexical"].select("term", "block", "at", "w"), ["term", "block"])
    one = hit.select("query_id", "block", "qw", F.explode(F.arrays_zip("at", "w")).alias("e"))
    sums = one.groupBy("query_id", "block", "e.at").agg(F.sum(F.col("qw") * F.col("e.w")).alias("lexical"))
    size = F.lit(BLOCK)
    return sums.select("query_id", (F.col("block") * size + F.col("at")).alias("cid"), R("lexical").alias("lexical"))


# ---------------------------------------------------------------- R5, R8

def _list(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column))
    if not col.is_valid()[row].as_py():
        return np.empty(0)
    ends = col.offsets
    return col.values.slice(ends[row].as_py(), ends[row + 1].as_py() - ends[row].as_py()).to_numpy(zero_copy_only=False)


class _Pair:
    """A block of chunks and a block of queries, as matrices."""

    def __init__(self, batch: pa.RecordBatch, row: int, dims: int):
        get = lambda c: _list(batch, c, row)
        one = lambda c: batch.column(batch.schema.get_field_index(c))[row].as_py()
        # without dims the rows hold no hashed vectors
        self.block, self.n, self.qn = one("block"), one("n"), get("qn").astype(np.int64)
        if "packed" in batch.schema.names:  # a part of an index in memory
            counts, (terms, idf, sizes, self.l_at, tf, norm) = wordhash.unpack(one("packed"))
            self.chunks = wordhash.counts_matrix(counts, dims) if dims else np.zeros((self.n, 0))
            self.l_w = tf * np.repeat(idf, sizes) / norm[self.l_at]
        else:
            self.chunks = np.zeros((self.n, dims))
            if dims:
                self.chunks[get("at").astype(np.int64), get("bucket").astype(np.int64)] = get("w")
            terms, sizes = get("l_tid").astype(np.int64), get("l_n").astype(np.int64)
            self.l_at, self.l_w = get("l_at").astype(np.int64), get("l_w").astype(float)
        self.tids = np.unique(get("t_tid").astype(np.int64))
        m = len(self.qn)
        self.qd, self.ql = np.zeros((dims, m)), np.zeros((len(self.tids), m))
        if dims:
            self.qd[get("d_bucket").astype(np.int64), get("d_q").astype(np.int64)] = get("d_w")
        self.ql[np.searchsorted(self.tids, get("t_tid")), get("t_q").astype(np.int64)] = get("t_w")
        # where the block's postings of the queries' terms stand; none if it has no such term
        self.l_from, self.l_size = np.zeros((2, len(self.tids)), dtype=np.int64)
        place = np.searchsorted(self.tids, terms)
        known = np.flatnonzero(place < len(self.tids))
        known = known[self.tids[place[known]] == terms[known]]
        self.l_from[place[known]], self.l_size[place[known]] = (np.cumsum(sizes) - sizes)[known], sizes[known]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """No chunk of the block scores above these, per query."""
        tops, has = np.zeros(len(self.tids)), np.flatnonzero(self.l_size)
        has = has[np.argsort(self.l_from[has])]
        if len(has):  # between two of these terms there may be others' postings: their ends are cuts too
            cuts = np.stack([self.l_from[has], self.l_from[has] + self.l_size[has]], 1).ravel()
            tops[has] = np.maximum.reduceat(np.append(self.l_w, 0.0), cuts)[::2]
        return self.chunks.max(0, initial=0.0) @ self.qd, tops @ self.ql

    def scores(self, live=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks @ self.qd[:, live], self.lexical(live)

    def lexical(self, live=slice(None)) -> np.ndarray:
        """Only the postings of a query's own terms are met."""
        ql = self.ql[:, live]
        lexical = np.zeros((self.n, ql.shape[1]))
        for j in range(ql.shape[1]):
            terms = np.flatnonzero((ql[:, j] != 0) & (self.l_size > 0))
            size = self.l_size[terms]
            at = np.arange(size.sum()) + np.repeat(self.l_from[terms] - np.cumsum(size) + size, size)
            lexical[:, j] = np.bincount(self.l_at[at], self.l_w[at] * np.repeat(ql[terms, j], size), self.n)
        return lexical

    def keys(self, batch: pa.RecordBatch, row: int, at: np.ndarray) -> list[pa.Array]:
        """Ids and numbers of the chunks at these places."""
        cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_ids", "chunk_nos")]
        return [c.values.take(pa.array(c.offsets[row].as_py() + at)) for c in cols]


def _batch(cols: Sequence, names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=list(names))


def _out(blocks: DataFrame, *doubles: str) -> T.StructType:
    """qn, doc_id, chunk_no and the given doubles."""
    cols = [("qn", T.LongType()), ("doc_id", blocks.schema["doc_ids"].dataType.elementType), ("chunk_no", blocks.schema["chunk_nos"].dataType.elementType)]
    return T.StructType([T.StructField(c, t) for c, t in cols + [(c, T.DoubleType()) for c in doubles]])


#: Weights of queries that are sent to every task; more are joined by a shuffle.
SENT_WEIGHTS = 500_000


def _meet(blocks: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    return blocks.crossJoin(F.broadcast(queries) if small else queries)


def _numbered(terms: DataFrame, dense: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, bool]:
    """Numbers of the queries (query_id, qn), their weights by number, and whether all fit in every task."""
    qn = cut_lineage(global_row_index((terms if dense is None else dense).select("query_id").distinct(), ["query_id"], out="qn"))
    qt = cut_lineage(terms.join(qn, "query_id").select("qn", "tid", "qw"))
    qd = None if dense is None else cut_lineage(dense.join(qn, "query_id").select("qn", "bucket", "qw"))
    n = sum(x.limit(SENT_WEIGHTS + 1).count() for x in (qt, qd) if x is not None)
    return qn, qt, qd, n <= SENT_WEIGHTS


def _lexical(blocks: DataFrame, terms: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
    """(qn, doc_id, chunk_no, lexical) of the pairs that share a term, or of a block's ``k`` best per query; (query_id, qn)."""
    qn, qt, _, small = _numbered(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                p = _Pair(batch, row, 0)
                s = p.lexical()
                for j, q in enumerate(p.qn.tolist()):
                    keep = np.flatnonzero(s[:, j] > 0)
                    if k is not None:
                        keep = keep[np.lexsort((keep, -np.round(s[keep, j], 6)))][:k]
                    if len(keep):
                        yield _batch([np.full(len(keep), q), *p.keys(batch, row, keep), s[keep, j]], ["qn", "doc_id", "chunk_no", "lexical"])

    blocks = blocks if small else cut_lineage(blocks)
    return _meet(blocks, _query_blocks(None, qt, qn.select("qn")), small).mapInArrow(run, _out(blocks, "lexical")), qn


def lexical_pairs(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_no, lexical of every pair that shares a term; ``terms`` (query_id, tid, qw)."""
    found, qn = _lexical(blocks, terms, None)
    return found.join(qn, "qn").select("query_id", "doc_id", "chunk_no", "lexical")


def lexical_blocks(blocks: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """``lexical_search`` on parts of texts: each gives its k best chunks per query."""
    found, qn = _lexical(blocks, terms, k)
    by = Window.partitionBy("qn").orderBy(F.desc("lexical"), F.col("doc_id").asc_nulls_last(), "chunk_no")
    top = found.withColumn("lexical", R("lexical")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return top.join(qn, "qn").select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "chunk_no", "lexical")


def dense_pairs(blocks: DataFrame, dense: DataFrame, dims: int) -> DataFrame:
    """query_id, doc_id, chunk_no, dense of every pair that shares a bucket.

    ``blocks`` (n, doc_ids, chunk_nos, packed: ``wordhash.counts_packed``), ``dense`` (query_id, bucket, qw). Rows of chunks
    meet rows of queries as matrices, so nothing is joined by bucket and no pair is shuffled.
    """
    small = dense.limit(SENT_WEIGHTS + 1).count() <= SENT_WEIGHTS
    each = dense.groupBy("query_id").agg(F.collect_list(F.struct("bucket", "qw")).alias("e")).select("query_id", _field("bucket"), _field("qw"))
    each = each.coalesce(1) if small else each

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, bucket, qw = batch.columns
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                q = np.repeat(np.arange(len(ids), dtype=np.int32), pc.list_value_length(bucket).to_numpy())
                yield pa.RecordBatch.from_arrays([one(ids), one(pa.array(q)), one(bucket.flatten()), one(qw.flatten())], names=["q_ids", "q", "bucket", "qw"])

    lists = [T.StructField("q_ids", T.ArrayType(dense.schema["query_id"].dataType)), T.StructField("q", T.ArrayType(T.IntegerType())),
             T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("qw", T.ArrayType(T.DoubleType()))]
    queries = each.mapInArrow(gather, T.StructType(lists))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.schema.names.index
            for row in range(batch.num_rows):
                chunks = wordhash.counts_matrix(wordhash.unpack(batch.column(of("packed"))[row].as_py()), dims)
                ids, nos, q_ids = (batch.column(of(c))[row].values for c in ("doc_ids", "chunk_nos", "q_ids"))
                q, bucket, qw = (_list(batch, c, row) for c in ("q", "bucket", "qw"))
                for s in range(0, len(q_ids), QUERIES):
                    own = (q >= s) & (q < s + QUERIES)
                    weights = np.zeros((dims, min(QUERIES, len(q_ids) - s)))
                    weights[bucket[own], q[own] - s] = qw[own]
                    dense = chunks @ weights
                    i, j = np.nonzero(dense > 0)
                    if len(i):
                        at = pa.array(i)
                        yield _batch([q_ids.take(pa.array(j + s)), ids.take(at), nos.take(at), dense[i, j]], ["query_id", "doc_id", "chunk_no", "dense"])

    blocks = blocks if small else cut_lineage(blocks)
    schema = T.StructType([dense.schema["query_id"], *_out(blocks, "dense").fields[1:]])
    return _meet(blocks, queries, small).mapInArrow(score, schema)


def _query_blocks(dense: DataFrame | None, lexical: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Rows of up to QUERIES queries: qn, d_* (bucket weights), t_* (term weights), and the columns of ``extra`` as arrays."""
    place = (F.col("qn") - F.col("_b") * QUERIES).cast("int").alias("q")

    def grouped(df, prefix, *cols):
        x = df.withColumn("_b", F.floor(F.col("qn") / QUERIES)).select("_b", place, *cols)
        g = x.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("q", *cols))).alias("e"))
        return g.select("_b", *[_field(c, f"{prefix}_{c}") for c in ("q", *cols)])

    ids = (extra if extra is not None else dense.select("qn").distinct()).withColumn("_b", F.floor(F.col("qn") / QUERIES))
    cols = [c for c in ids.columns if c != "_b"]
    head = ids.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("e"))
    head = head.select("_b", *[_field(c) for c in cols])
    if dense is not None:
        head = head.join(grouped(dense.withColumnRenamed("qw", "w"), "d", "bucket", "w"), "_b", "left")
    t = grouped(lexical.withColumnRenamed("qw", "w"), "t", "tid", "w")
    return head.join(t, "_b", "left").drop("_b")


def hybrid_search(tables: dict[str, DataFrame], query_dense: DataFrame, query_terms: DataFrame, k: int, weights: tuple[float, float],
                  dims: int) -> DataFrame:
    """R8 on block tables: query_id, rank, doc_id, chunk_no, score, dense, lexical (six digits), top k per query.

    ``query_dense`` (query_id, bucket, qw), ``query_terms`` (query_id, term, qw). Blocks of chunks meet blocks of
    queries twice: for the extremes of both scores over all chunks (what is not matched scores 0), by which they are
    normalised, and for the top k, where a block is not scored for a query if its largest weights cannot reach the k-th
    best score that the task has seen. Chunks that score 0 in both are not listed; ties go by (doc_id, chunk_no).
    """
    tid = cut_lineage(global_row_index(query_terms.select("term").distinct(), ["term"], out="tid"))
    hits = tables["lexical"].join(tid, "term").select("block", "tid", F.size("at").alias("n"), "at", "w")
    entry = F.sort_array(F.collect_list(F.struct("tid", "n", "at", "w")))
    lex = hits.groupBy("block").agg(entry.alias("e"))
    lex = lex.select("block", _field("tid", "l_tid"), _field("n", "l_n"),
                     F.flatten(_field("at")).alias("l_at"), F.flatten(_field("w")).alias("l_w"))
    names = tables["numbers"].groupBy("block").agg(F.sort_array(F.collect_list(F.struct("cid", "doc_id", "chunk_no"))).alias("e"))
    names = names.select("block", _field("doc_id", "doc_ids"), _field("chunk_no", "chunk_nos"))
    blocks = cut_lineage(tables["dense"].join(names, "block").join(lex, "block", "left"))
    return hybrid_blocks(blocks, query_terms.join(tid, "term").select("query_id", "tid", "qw"), query_dense, k, weights, dims)


def hybrid_blocks(blocks: DataFrame, terms: DataFrame, dense: DataFrame, k: int, weights: tuple[float, float], dims: int) -> DataFrame:
    """``hybrid_search`` on rows of blocks, which are read twice: block, n, doc_ids, chunk_nos, and packed (``termparts.blocks``)
    or at, bucket, w, l_tid, l_n, l_at, l_w.

    ``terms`` (query_id, tid, qw), ``dense`` (query_id, bucket, qw).
    """
    qn, qt, qd, small = _numbered(terms, dense)
    extremes = ["dmin", "dmax", "lmin", "lmax"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                p = _Pair(batch, row, dims)
                d, lx = p.scores()
                yield pa.RecordBatch.from_arrays([pa.array(p.qn), *[pa.array(x) for x in (d.min(0), d.max(0), lx.min(0), lx.max(0))]], names=["qn", *extremes])

    schema = T.StructType([T.StructField("qn", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in extremes]])
    found = _meet(blocks, _query_blocks(qd, qt), small).mapInArrow(find, schema).groupBy("qn").agg(
        F.min("dmin").alias("dmin"), F.max("dmax").alias("dmax"), F.min("lmin").alias("lmin"), F.max("lmax").alias("lmax"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}  # the task's k best scores per query
        for batch in batches:
            for row in range(batch.num_rows):
                p = _Pair(batch, row, dims)
                lo_d, hi_d, lo_l, hi_l = (_list(batch, c, row).astype(float) for c in extremes)

                def mixed(d, lx, q=slice(None)):
                    norm = lambda x, lo, hi: np.where(hi > lo, (x - lo) / (hi - lo + 1e-12), x)
                    return weights[0] * norm(d, lo_d[q], hi_d[q]) + weights[1] * norm(lx, lo_l[q], hi_l[q])

                kth = np.array([seen[q][k - 1] if q in seen and len(seen[q]) == k else -np.inf for q in p.qn.tolist()])
                live = np.flatnonzero(mixed(*p.bounds()) >= kth - SLACK)
                if not len(live):
                    continue
                d, lx = p.scores(live)
                score = np.round(mixed(d, lx, live), 6)
                cols = []
                for j, q in enumerate(live.tolist()):
                    keep = np.flatnonzero(((d[:, j] > 0) | (lx[:, j] > 0)) & (score[:, j] >= kth[q] - SLACK))
                    if len(keep) > k:  # only what ties with the k-th best is put in order
                        least = len(keep) - k
                        keep = keep[score[keep, j] >= np.partition(score[keep, j], least)[least]]
                    keep = keep[np.lexsort((keep, -score[keep, j]))][:k]
                    if len(keep):
                        cols.append((np.full(len(keep), p.qn[q]), keep, score[keep, j], d[keep, j], lx[keep, j]))
                        old = seen.get(int(p.qn[q]), np.empty(0))
                        seen[int(p.qn[q])] = -np.sort(-np.concatenate([old, score[keep, j]]))[:k]
                if cols:
                    qs, at, *values = (np.concatenate(x) for x in zip(*cols))
                    yield _batch([qs, *p.keys(batch, row, at), *values], ["qn", "doc_id", "chunk_no", "score", "dense", "lexical"])

    cand = _meet(blocks, _query_blocks(qd, qt, found), small).mapInArrow(search, _out(blocks, "score", "dense", "lexical"))
    by = Window.partitionBy("qn").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "chunk_no")
    top = cand.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).join(qn, "qn")
    return top.select("query_id", "rank", "doc_id", "chunk_no", R("score").alias("score"), R("dense").alias("dense"), R("lexical").alias("lexical"))


# ---------------------------------------------------------------- R5 on stored vectors

def _unit(values: np.ndarray) -> np.ndarray:
    return values / (np.linalg.norm(values, axis=1, keepdims=True) + 1e-12)


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _packed(df: DataFrame, id_col: str, vec_col: str, prefix: str) -> DataFrame:
    """One row per Arrow batch: ids (array), and the unit vectors as one matrix of doubles."""
    cols = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                b = batch.slice(s, 1024)
                m = _unit(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), b.column(0)), pa.array([m.shape[1]], pa.int32()),
                                                  pa.array([m.tobytes()], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_d", f"{prefix}_m"])

    schema = T.StructType([T.StructField(f"{prefix}_ids", T.ArrayType(cols.schema["id"].dataType)), T.StructField(f"{prefix}_d", T.IntegerType()),
                           T.StructField(f"{prefix}_m", T.BinaryType())])
    return cols.mapInArrow(run, schema)


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
                  qid: str = "query_id") -> DataFrame:
    """R5 on stored vectors: exact cosine top k per query, ids of any type, any number of queries.

    Blocks of vectors meet blocks of queries as matrices; a pair of blocks gives k rows per query, so no list of all
    pairs exists. Ties on the score (six digits) go by the item's id. Null vectors are left out.
    """
    c, q = _packed(corpus, id_col, vec_col, "c"), _packed(queries, qid, vec_col, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, qids = batch.column(0)[r].values, batch.column(3)[r].values
                a = np.frombuffer(batch.column(2)[r].as_py()).reshape(len(ids), -1)
                b = np.frombuffer(batch.column(5)[r].as_py()).reshape(len(qids), -1)
                s = np.round(b @ a.T, 6)
                rank = pc.rank(ids, "ascending", tiebreaker="first").to_numpy()
                kk = min(k, len(ids))
                top = np.array([np.lexsort((rank, -row))[:kk] for row in s])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.repeat(np.arange(len(qids)), kk))), ids.take(pa.array(top.ravel())),
                                                  pa.array(np.take_along_axis(s, top, 1).ravel())], names=["query_id", "item_id", "score"])

    schema = T.StructType([T.StructField("query_id", q.schema["q_ids"].dataType.elementType), T.StructField("item_id", c.schema["c_ids"].dataType.elementType),
                           T.StructField("score", T.DoubleType())])
    found = c.crossJoin(q).mapInArrow(run, schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", R("score").alias("score"))


# ---------------------------------------------------------------- R9

#: Rows of a cell that one group holds; larger cells are dealt over several groups.
CELL_ROWS = 8192


def cell_index(corpus: DataFrame, cells: int | None = None, sample_rows: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding",
               seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """R9 index: centroids, and every vector coded in its cell: item_id, cell, part, scale, code (bytes).

    Centroids (k-means; by default the square root of the sample's rows) are fitted on at most about ``sample_rows``
    vectors chosen by the hash of their id. Each unit vector is its cell's centroid plus a residual kept in one signed
    byte per entry. Cells of more than ``CELL_ROWS`` rows have several parts.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(vec_col).cast("array<double>").alias("v"))
    total = rows.count()
    step = max(1, total // sample_rows)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    sample = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(step)) == 0).select(array_to_vector(F.transform("v", lambda x: x / norm)).alias("features"))
    n_cells = cells or max(1, int(min(total, sample_rows) ** 0.5))
    model = KMeans(k=max(2, n_cells), seed=seed, maxIter=10).fit(sample)
    centres = np.array(model.clusterCenters())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch.column(1)))
            cell = ((centres * centres).sum(1) - 2 * v @ centres.T).argmin(1)
            rest = v - centres[cell]
            scale = np.abs(rest).max(1) / 127 + 1e-30
            byte = np.round(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(scale), pa.array([b.tobytes() for b in byte], pa.binary())],
                                             names=["item_id", "cell", "scale", "code"])

    schema = T.StructType([rows.schema["item_id"], T.StructField("cell", T.IntegerType()), T.StructField("scale", T.DoubleType()), T.StructField("code", T.BinaryType())])
    coded = cut_lineage(rows.mapInArrow(code, schema))
    sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts"))  # one row per cell
    coded = coded.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
    return centres, coded


def approx_neighbours(corpus: DataFrame, queries: DataFrame, k: int = 10, probes: int = 16, id_col: str = "vec_id", vec_col: str = "embedding",
                      qid: str = "query_id", index: tuple[np.ndarray, DataFrame] | None = None, wider: int = 4) -> DataFrame:
    """Top k of the cosine per query from the ``probes`` nearest cells: query_id, rank, item_id, score (exact).

    Coded vectors give ``wider`` * k candidates per query, which are scored again by the vectors themselves. Recall
    against ``vector_search`` is measured by the query ``approx_neighbours_recall``.
    """
    centres, coded = index or cell_index(corpus, id_col=id_col, vec_col=vec_col)
    probes, keep = min(probes, len(centres)), wider * k
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col(qid).alias("query_id"), F.col(vec_col).cast("array<double>").alias("v"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch.column(1)))
            cell = np.argsort((centres * centres).sum(1) - 2 * v @ centres.T, axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(len(v)), probes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cell.ravel().astype(np.int32)), pa.array([v[i].tobytes() for i in rows], pa.binary())],
                                             names=["query_id", "cell", "q"])

    asked = q.mapInArrow(nearest, T.StructType([q.schema["query_id"], T.StructField("cell", T.IntegerType()), T.StructField("q", T.BinaryType())]))
    parts = coded.groupBy("cell").agg(F.max("parts").alias("parts"))
    asked = asked.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "query_id", "q")
    rows = coded.select("cell", "part", F.lit(0).alias("kind"), "item_id", "scale", "code").unionByName(asked, allowMissingColumns=True)
    rows = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, held = None, None, None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if s == e:
                    continue
                cell, part, kind = key[s].tolist()
                if (cell, part) != now:
                    now, ids, vectors, held = (cell, part), None, None, []
                rows_ = batch.slice(s, e - s)
                if kind == 0:
                    held.append(rows_)
                    continue
                if ids is None:
                    ids = pa.concat_arrays([h.column(3) for h in held])
                    byte = np.frombuffer(b"".join(b for h in held for b in h.column(5).to_pylist()), dtype=np.int8).reshape(len(ids), -1)
                    vectors = centres[cell] + byte * np.concatenate([h.column(4).to_numpy() for h in held])[:, None]
                m = np.frombuffer(b"".join(rows_.column(7).to_pylist())).reshape(len(rows_), -1) @ vectors.T
                kk = min(keep, len(ids))
                top = np.argpartition(-m, kk - 1, axis=1)[:, :kk]
                yield pa.RecordBatch.from_arrays([rows_.column(6).take(pa.array(np.repeat(np.arange(len(m)), kk))), ids.take(pa.array(top.ravel())),
                                                  pa.array(np.take_along_axis(m, top, 1).ravel())], names=["query_id", "item_id", "near"])

    schema = T.StructType([q.schema["query_id"], coded.schema["item_id"], T.StructField("near", T.DoubleType())])
    near = rows.select("cell", "part", "kind", "item_id", "scale", "code", "query_id", "q").mapInArrow(score, schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("near"), "item_id")
    cand = near.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= keep).select("query_id", "item_id")
    items = corpus.select(F.col(id_col).alias("item_id"), F.col(vec_col).cast("array<double>").alias("w"))
    pairs = cand.join(items, "item_id").join(q, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    cosine = dot("v", "w") / ((F.sqrt(dot("v", "v")) + 1e-12) * (F.sqrt(dot("w", "w")) + 1e-12))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return pairs.select("query_id", "item_id", R(cosine).alias("score")).withColumn("rank", F.row_number().over(by)) \
        .where(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")
