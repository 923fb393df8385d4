"""Chunking, lexical + hashed-vector indexes, hybrid search, sections.

Index tables (all keyed by ``(doc_id, chunk_no)``):
  chunks   (doc_id, chunk_no, text)
  dense    (doc_id, chunk_no, bucket, w)     hashed 1-2-gram counts, L2-normalised
  postings (doc_id, chunk_no, term, w)       TF-IDF, L2-normalised
  terms    (term, df, idf)                   the vocabulary

Top-k searches run on block tables (``search``). ``dense_scores`` and
``lexical_scores`` list every matching pair, for reports and as the plain twin
of the searches. An index in memory (``build_index``) makes TF-IDF weights where
its texts are dealt (``termparts``); a stored one is read by joins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import safe_round as R
from ..session import cut_lineage, files_freed
from . import termparts as TP
from . import wordhash as WH

# Chunking, hashing and hybrid-weight parameters.
CHUNK_SIZE = 1400
CHUNK_OVERLAP = 220
HASH_DIMS = 768
DENSE_WEIGHT = 0.6
LEXICAL_WEIGHT = 0.4
TOP_K = 8
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
#: Those besides the line feed.
OTHER_BREAKS = "\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029"


WHITE = " \t\n\u000b\f\r"


def _strip(col: Column) -> Column:
    """Without white space (``\\s``) at the ends, for text that has no line break but the line feed. The end is looked at
    first: trimming there walks over the whole text."""
    return F.when(reduce(lambda x, y: x | y, [col.endswith(c) for c in WHITE]), F.btrim(col, F.lit(WHITE))).otherwise(F.ltrim(col, F.lit(WHITE)))


# ---------------------------------------------------------------- R1

def split_lines(text: Column) -> Column:
    """Python ``str.splitlines`` (no trailing empty line)."""
    other = reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in OTHER_BREAKS])
    plain = F.when(other, F.regexp_replace(text, LINE_BREAKS, "\n")).otherwise(text)
    # inside the lambda the text is at hand, not made again for each use; one character as the pattern needs no regular expression
    lines = F.transform(F.array(plain), lambda x: F.split(F.when(x.endswith("\n"), F.left(x, F.length(x) - 1)).otherwise(x), "\n"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.element_at(lines, 1))


def chunk_array(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """R1 for one text: pack lines up to ``size`` chars; each new chunk starts with the last ``overlap`` chars."""
    init = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur"),
                    F.lit(0).alias("n"), F.lit(False).alias("has"))

    def step(acc, line):
        ll = F.length(line) + 1
        full = acc["has"] & (acc["n"] + ll > size)

        def begun(tail):  # the text's last characters are sought once
            some = tail != ""
            return F.struct(F.concat(acc["chunks"], F.array(_strip(acc["cur"]))).alias("chunks"),
                            F.when(some, F.concat(tail, F.lit("\n"), line)).otherwise(line).alias("cur"),
                            F.when(some, F.length(tail) + ll).otherwise(ll - 1).alias("n"), F.lit(True).alias("has"))

        going = F.struct(acc["chunks"].alias("chunks"), F.when(acc["has"], F.concat(acc["cur"], F.lit("\n"), line)).otherwise(line).alias("cur"),
                         (acc["n"] + ll).alias("n"), F.lit(True).alias("has"))
        return F.when(full, F.element_at(F.transform(F.array(F.substring(acc["cur"], -overlap, overlap)), begun), 1)).otherwise(going)

    def finish(acc):
        allc = F.when(acc["has"], F.concat(acc["chunks"], F.array(_strip(acc["cur"])))).otherwise(acc["chunks"])
        return F.filter(allc, lambda c: c != "")

    out = F.aggregate(split_lines(text), init, step, finish)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\S"), out).otherwise(F.array().cast("array<string>"))


def chunk_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_SIZE,
               overlap: int = CHUNK_OVERLAP, deal: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, chunk_no, text); documents are chunked in parallel, each whole text in one fold.

    The fold is CPU-heavy per row, so input that arrives in fewer partitions than the
    cluster's default parallelism (e.g. one small file) is spread first, unless ``deal`` is false.
    The columns ``keep`` stay in front.
    """
    # hash-partition on the document id: spreads the CPU-heavy fold, and every later aggregate keyed
    # by (doc_id, chunk_no, ...) (term counts, norms) is then already clustered: no second shuffle
    if deal:
        par = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
        docs = docs.repartition(par, F.col(id_col))
    return docs.select(*keep, F.col(id_col).alias("doc_id"), F.posexplode(chunk_array(F.col(text_col), size, overlap))
                       .alias("chunk_no", "text"))


# ---------------------------------------------------------------- R2-R4

def tokens(text: Column) -> Column:
    """Lower-case word tokens of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def ngrams12_of(tok: Column) -> Column:
    """R2 on a token-array column: unigrams followed by bigrams (pass a column, not an expression,
    so the tokenizer runs once per text)."""
    m = F.greatest(F.size(tok) - 1, F.lit(0))
    # zip of two shifted slices: the token array appears only as an argument, never inside the lambda
    bi = F.zip_with(F.slice(tok, 1, m), F.slice(tok, 2, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tok, F.when(m > 0, bi).otherwise(F.array().cast("array<string>")))


def ngrams12(text: Column) -> Column:
    """R2: unigrams followed by bigrams of a text expression."""
    return ngrams12_of(tokens(text))


def with_terms(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keys..., terms): tokens computed once, then 1- and 2-grams."""
    tok = df.select(*keys, tokens(F.col(text_col)).alias("_tok"))
    return tok.select(*keys, ngrams12_of(F.col("_tok")).alias("terms"))


def term_counts(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keys..., term, tf) from 1- and 2-grams."""
    return (with_terms(df, keys, text_col).select(*keys, F.explode("terms").alias("term"))
            .groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")))


def hash_bucket(term: Column, dims: int = HASH_DIMS) -> Column:
    """Portable hashing trick: md5 prefix mod dims (identical in DuckDB)."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")


def _l2(df: DataFrame, keys: Sequence[str], val: str, out: str = "w") -> DataFrame:
    # a window, not an aggregate joined back: rows that are dealt by a key already stay where they are
    norm = F.sqrt(F.sum(F.col(val) * F.col(val)).over(Window.partitionBy(*keys)))
    return df.withColumn(out, F.col(val) / (norm + F.lit(1e-12)))


def dense_from_counts(tc: DataFrame, keys: Sequence[str], dims: int = HASH_DIMS) -> DataFrame:
    b = tc.groupBy(*keys, hash_bucket(F.col("term"), dims).alias("bucket")).agg(F.sum("tf").cast("double").alias("c"))
    return _l2(b, keys, "c").drop("c")


def hash_embed(df: DataFrame, keys: Sequence[str], text_col: str = "text", dims: int = HASH_DIMS) -> DataFrame:
    """(keys..., bucket, w): unsigned bucket counts of 1-2-grams, L2-normalised (+1e-12)."""
    return dense_from_counts(term_counts(df, keys, text_col), keys, dims)


def tfidf_index(chunks: DataFrame, keys: Sequence[str] = ("doc_id", "chunk_no"), max_features: int | None = None,
                tc: DataFrame | None = None):
    """Smooth idf ln((1+n)/(1+df)) + 1; L2 rows. Returns (postings, terms).

    All terms are kept, or the ``max_features`` most frequent if that is given.
    """
    keys = list(keys)
    tc = tc if tc is not None else term_counts(chunks, keys)
    n = chunks.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n"))
    stats = tc.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    vocab = stats if max_features is None else stats.orderBy(F.desc("total"), "term").limit(max_features)
    nn = n.scalar()
    terms = vocab.select("term", "df", (F.log((1 + nn) / (1 + F.col("df"))) + 1).alias("idf"))
    post = tc.join(terms.select("term", "idf"), "term").withColumn("x", F.col("tf") * F.col("idf"))
    return _l2(post, keys, "x").select(*keys, "term", "w"), terms


class MemoryIndex(dict):
    """The tables of an index that is made again from its documents where it is read, and their texts dealt to parts.

    Its functions send the terms' frequencies, never the postings (``termparts``).
    """

    def __init__(self, tables: dict[str, DataFrame], docs: DataFrame, id_col: str, text_col: str):
        super().__init__(tables)
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.chunk_sizes = docs.select(F.size(chunk_array(F.col(text_col))).alias("n"))

    @property
    def n_chunks(self) -> Column:
        """The number of chunks; nothing is shuffled for it."""
        return self.chunk_sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()

    def chunks_of(self, ids: DataFrame, small: bool) -> DataFrame:
        """The chunks of the documents of ``ids`` (doc_id), made where the documents are read; only those are cut into chunks."""
        wanted = ids.select(F.col("doc_id").alias(self.id_col)).distinct()
        docs = self.docs.join(F.broadcast(wanted) if small else wanted, self.id_col, "left_semi")
        return chunk_text(docs, self.id_col, self.text_col, deal=False)

    @cached_property
    def n_parts(self) -> int:
        return TP.n_parts(self.docs, self.text_col)

    @cached_property
    def n_buckets(self) -> int:
        return -(-self.n_parts // TP.PARTS_A_BUCKET)

    @cached_property
    def dealt(self) -> DataFrame:
        docs = TP.deal(self.docs.select(self.id_col, self.text_col), self.id_col, self.n_parts)
        return chunk_text(docs, self.id_col, self.text_col, deal=False, keep=["part"])

    def dense_blocks(self, dims: int) -> DataFrame:
        """Rows of some thousand chunks with their hashed counts: n, doc_ids, chunk_nos, packed (``wordhash``)."""
        docs = self.docs.select(self.id_col, self.text_col).repartition(self.n_parts, F.col(self.id_col)).sortWithinPartitions(self.id_col)
        chunks = chunk_text(docs, self.id_col, self.text_col, deal=False)
        words = chunks.select("doc_id", "chunk_no", F.array_join(tokens(F.col("text")), " ").alias("words"))
        kind = words.schema["doc_id"].dataType
        schema = T.StructType([T.StructField(c, k) for c, k in (("n", T.IntegerType()), ("doc_ids", T.ArrayType(kind)), (
            "chunk_nos", T.ArrayType(T.IntegerType())), ("packed", T.BinaryType()))])
        return words.mapInArrow(lambda batches: WH.dense_rows(batches, dims), schema)

    @cached_property
    def texts(self) -> DataFrame:
        return TP.worded(self.dealt, F.col("doc_id"), F.col("chunk_no"), tokens(F.col("text")))

    @cached_property
    def postings(self) -> DataFrame:
        answer = TP.answers(TP.sent(self.texts, self.n_buckets), self.n_buckets)
        return TP.postings(self.texts, answer, self.n_parts)

    def ask(self, queries: DataFrame, dims: int | None) -> tuple[DataFrame, DataFrame]:
        """The blocks of chunks (with hashed vectors if ``dims``), and the weights (query_id, tid, qw) of the queries' terms.

        The frequencies are stored, packed; so the texts are read twice, and dealt once more.
        """
        m = TP.n_parts(queries, "text")
        dealt = TP.deal(queries.select("query_id", "text"), "query_id", m, asking=True)
        asked = TP.worded(dealt, F.col("query_id"), F.lit(0), tokens(F.col("text")))
        rows = TP.sent(self.texts, self.n_buckets).unionByName(TP.sent(asked, self.n_buckets))
        with files_freed(queries.sparkSession):
            answer = cut_lineage(TP.answers(rows, self.n_buckets))
        known = cut_lineage(TP.query_weights(asked, answer.where("part < 0"), m))
        return TP.blocks(self.texts, answer.where("part >= 0"), self.n_parts, dims), known


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> MemoryIndex:
    """S15 in memory: chunks, dense, postings, terms (persist with ``sources.io.write_index``)."""
    keys = ["doc_id", "chunk_no"]
    # nothing is stored: term counts are some ten times their text. Documents are dealt by id once, and chunks, counts and
    # hashed vectors are made again from them where a table needs them, without another shuffle
    chunks = chunk_text(docs, id_col, text_col)
    tc = term_counts(chunks, keys)
    _, terms = tfidf_index(chunks, keys, tc=tc)
    index = MemoryIndex({"chunks": chunks, "dense": dense_from_counts(tc, keys), "terms": terms}, docs, id_col, text_col)
    index["postings"] = index.postings
    return index


# ---------------------------------------------------------------- R5-R8

#: Weights of queries that are sent to every task; more are joined by a shuffle.
SENT_WEIGHTS = 500_000


def _small(weights: DataFrame) -> DataFrame:
    """The weights (query_id, ..., qw), to be broadcast if there are at most SENT_WEIGHTS."""
    n = weights.limit(SENT_WEIGHTS + 1).count()
    return F.broadcast(weights) if n <= SENT_WEIGHTS else weights


def dense_scores(index: dict[str, DataFrame], queries: DataFrame, qid: str = "query_id", qtext: str = "text") -> DataFrame:
    """Cosine of hashed vectors (both sides L2-normalised): (query_id, doc_id, chunk_no, dense), of those that share a bucket."""
    q = hash_embed(queries.select(F.col(qid).alias("query_id"), F.col(qtext).alias("text")), ["query_id"])
    q = q.select("query_id", "bucket", F.col("w").alias("qw"))
    if isinstance(index, MemoryIndex):
        from . import search
        return search.dense_pairs(index.dense_blocks(HASH_DIMS), q, HASH_DIMS)
    j = index["dense"].join(_small(q), "bucket")  # sums stay in the task that holds the chunk
    return j.groupBy("query_id", "doc_id", "chunk_no").agg(F.sum(F.col("w") * F.col("qw")).alias("dense"))


def lexical_scores(index: dict[str, DataFrame], queries: DataFrame, qid: str = "query_id", qtext: str = "text") -> DataFrame:
    """R6 (J3): TF-IDF dot product of query and chunk postings."""
    if isinstance(index, MemoryIndex):
        from . import search
        blocks, weights = index.ask(queries.select(F.col(qid).alias("query_id"), F.col(qtext).alias("text")), None)
        return search.lexical_pairs(blocks, weights)
    terms = index["terms"]
    qt = term_counts(queries.select(F.col(qid).alias("query_id"), F.col(qtext).alias("text")), ["query_id"])
    qt = qt.join(terms.select("term", "idf"), "term").withColumn("x", F.col("tf") * F.col("idf"))
    qt = _l2(qt, ["query_id"], "x").select("query_id", "term", F.col("w").alias("qw"))
    j = index["postings"].join(qt, "term")
    return j.groupBy("query_id", "doc_id", "chunk_no").agg(F.sum(F.col("w") * F.col("qw")).alias("lexical"))


def minmax_normalize(scores: DataFrame, col: str, n_total: Column | int, by: str = "query_id") -> DataFrame:
    """(s - min) / (max - min + 1e-12) per query, unchanged when max = min.

    Chunks absent from ``scores`` score 0, so the minimum is 0 whenever fewer than ``n_total`` chunks matched. The
    extremes are one aggregate (partial per task) joined back, so no task holds a query's scores.
    """
    g = scores.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    lo = F.when(F.col("_n") < n_total, F.least(F.lit(0.0), F.col("_lo"))).otherwise(F.col("_lo"))
    hi = F.when(F.col("_n") < n_total, F.greatest(F.lit(0.0), F.col("_hi"))).otherwise(F.col("_hi"))
    g = g.select(by, lo.alias("_mn"), hi.alias("_mx"))
    mn, mx = F.col("_mn"), F.col("_mx")
    return scores.join(g, by).withColumn(f"{col}_norm", F.when(mx > mn, (F.col(col) - mn) / (mx - mn + 1e-12)).otherwise(F.col(col))).drop("_mn", "_mx")


def _query_side(index: dict[str, DataFrame], queries: DataFrame, qid: str, qtext: str):
    """Query buckets and TF-IDF weights (bounded: queries x their own terms)."""
    q = queries.select(F.col(qid).alias("query_id"), F.col(qtext).alias("text"))
    qd = hash_embed(q, ["query_id"]).select("query_id", "bucket", F.col("w").alias("qw"))
    qt = term_counts(q, ["query_id"]).join(index["terms"].select("term", "idf"), "term") \
        .withColumn("x", F.col("tf") * F.col("idf"))
    ql = _l2(qt, ["query_id"], "x").select("query_id", "term", F.col("w").alias("qw"))
    return qd, ql


def hybrid_search(index: dict[str, DataFrame], queries: DataFrame, k: int = TOP_K, qid: str = "query_id",
                  qtext: str = "text", with_text: bool = False, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """0.6 * dense + 0.4 * lexical (each min-max normalised over all chunks, per query), top k per query.

    Any number of queries with ids of any type. ``tables`` are the index's block tables (``search.search_tables``) if
    they are stored; else they are made here. See ``search.hybrid_search``.
    """
    from . import search
    mix = (DENSE_WEIGHT, LEXICAL_WEIGHT)
    if tables is None and isinstance(index, MemoryIndex):
        q = queries.select(F.col(qid).alias("query_id"), F.col(qtext).alias("text"))
        qd = hash_embed(q, ["query_id"]).select("query_id", "bucket", F.col("w").alias("qw"))
        blocks, known = index.ask(q, HASH_DIMS)
        with files_freed(q.sparkSession):
            blocks = cut_lineage(blocks)  # read twice
        out = search.hybrid_blocks(blocks, known, qd, k, mix, HASH_DIMS)
    else:
        qd, ql = _query_side(index, queries, qid, qtext)
        out = search.hybrid_search(tables or search.search_tables(index), qd, ql, k, mix, HASH_DIMS)
    return out.join(index["chunks"], ["doc_id", "chunk_no"]) if with_text else out


def lexical_search(index: dict[str, DataFrame], queries: DataFrame, k: int = TOP_K, qid: str = "query_id", qtext: str = "text",
                   tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """R6 (J3): the k chunks of largest TF-IDF dot product per query, exactly, by posting blocks with largest weights."""
    from . import search
    if tables is None and isinstance(index, MemoryIndex):
        blocks, weights = index.ask(queries.select(F.col(qid).alias("query_id"), F.col(qtext).alias("text")), None)
        return search.lexical_blocks(blocks, weights, k)
    return search.lexical_search(tables or search.search_tables(index), _query_side(index, queries, qid, qtext)[1], k)


def hybrid_search_join(index: dict[str, DataFrame], queries: DataFrame, k: int = TOP_K, qid: str = "query_id",
                  qtext: str = "text", with_text: bool = False) -> DataFrame:
    """R8 by sparse joins over all matching pairs: the plain twin of ``hybrid_search``.

    Ties are broken by (doc_id, chunk_no). Chunks sharing no bucket and no term with a
    query have both scores 0 and are not listed.
    """
    n_total = index["chunks"].agg(F.count(F.lit(1))).scalar()
    d = minmax_normalize(dense_scores(index, queries, qid, qtext), "dense", n_total)
    lx = minmax_normalize(lexical_scores(index, queries, qid, qtext), "lexical", n_total)
    keys = ["query_id", "doc_id", "chunk_no"]
    j = d.join(lx, keys, "full_outer")
    # a chunk missing on one side scores 0 there: normalised 0 unless that side had max = min (then raw 0)
    dn = F.coalesce(F.col("dense_norm"), F.lit(0.0))
    ln = F.coalesce(F.col("lexical_norm"), F.lit(0.0))
    j = j.withColumn("score", R(DENSE_WEIGHT * dn + LEXICAL_WEIGHT * ln))  # ties on the reported value
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_no")
    top = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = top.select("query_id", "rank", "doc_id", "chunk_no", R("score").alias("score"),
                     R(F.coalesce(F.col("dense"), F.lit(0.0))).alias("dense"),
                     R(F.coalesce(F.col("lexical"), F.lit(0.0))).alias("lexical"))
    if with_text:
        out = out.join(index["chunks"], ["doc_id", "chunk_no"])
    return out


def union_hits(hits: Sequence[DataFrame], by: Sequence[str], request: str = "request_id", max_hits: int | None = None) -> DataFrame:
    """The hits of several queries as one list per request: the best score of each ``by`` (a tie goes to the lesser
    query_id), ranked by (score desc, ``by``) in ``ord``; the first ``max_hits`` if given.

    ``by`` is (doc_id, chunk_no), or with the text beside it. The best hit of an id is one aggregate, partial per task.
    """
    all_ = hits[0]
    for h in hits[1:]:
        all_ = all_.unionByName(h)
    rest = [c for c in all_.columns if c not in (request, *by)]
    g = all_.groupBy(request, *by).agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), "query_id")).alias("_h")).select(request, *by, "_h.*")
    w = Window.partitionBy(request).orderBy(F.desc("score"), *by)
    out = g.withColumn("ord", F.row_number().over(w))
    return out if max_hits is None else out.where(F.col("ord") <= max_hits)


def context_block(hits: DataFrame, chunks: DataFrame | MemoryIndex, max_blocks: int = 10, by_text: bool = False) -> DataFrame:
    """R10 (with U1): best score first, first hit per chunk (or per chunk and text), up to max_blocks (the feature's
    size of an answer), formatted ``[chunk:id score:x.xxx]`` + text and joined by a blank line, per request.

    Only the ids are ranked; the texts of the ``max_blocks`` hits of a request are fetched afterwards, from a table of chunks
    or from the documents of an index in memory.
    """
    keys = ["doc_id", "chunk_no"]

    def fetched(ids):  # chunks are not shuffled for a few hits
        ids = cut_lineage(ids)
        small = ids.limit(SENT_WEIGHTS + 1).count() <= SENT_WEIGHTS
        texts = chunks.chunks_of(ids, small) if isinstance(chunks, MemoryIndex) else chunks
        return (F.broadcast(ids) if small else ids).join(texts, keys)

    if by_text:
        best = union_hits([fetched(hits)], [*keys, "text"], max_hits=max_blocks)
    else:
        best = fetched(union_hits([hits], keys, max_hits=max_blocks))
    block = F.format_string("[chunk:%s score:%.3f]\n%s", F.concat_ws(":", "doc_id", "chunk_no"), F.col("score"), F.col("text"))
    g = best.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))).alias("bs"))
    return g.select("request_id", F.array_join(F.transform("bs", lambda s: s["b"]), "\n\n").alias("context"))


# ---------------------------------------------------------------- R11

HEADING_PATTERN = r"^[A-Z][A-Z\s:/()_-]{6,}$"


def extract_section(df: DataFrame, keyword: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """From the first line containing ``keyword`` (case-insensitive) to the next capital heading
    (or '=== ' line) that does not mention it; one row per text that has the keyword."""
    kw = keyword.lower()
    lines = df.select(F.col(id_col).alias("doc_id"), F.posexplode(split_lines(F.col(text_col))).alias("i", "line"))
    start = lines.where(F.lower("line").contains(kw)).groupBy("doc_id").agg(F.min("i").alias("s"))
    lj = _strip(F.col("line"))
    stop = (lj != "") & (((lj.rlike(HEADING_PATTERN)) & ~lj.contains(keyword.upper()))
                         | (F.lower(lj).startswith("=== ") & ~F.lower(lj).contains(kw)))
    x = lines.join(start, "doc_id").where(F.col("i") >= F.col("s"))
    ends = x.where((F.col("i") > F.col("s")) & stop).groupBy("doc_id").agg(F.min("i").alias("e"))
    sec = x.join(ends, "doc_id", "left").where(F.col("e").isNull() | (F.col("i") < F.col("e")))
    g = sec.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("ls"))
    return g.select("doc_id", _strip(F.array_join(F.transform("ls", lambda s: s["line"]), "\n")).alias("section"))
