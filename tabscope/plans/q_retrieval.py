"""Registered retrieval queries (R1-R12) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import safe_round as R
from ..operators import retrieval as RT
from ..operators import search as SR
from .catalog import register
from .sqlgen import r6
from .tables import t

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x):
    return STRIP.format(x=x)


def chunks_sql(table="documents", id_col="doc_id", text_col="text", size=1400, overlap=220):
    full = f"r.has AND r.n + length(l.line) + 1 > {size}"
    newcur = f"CASE WHEN right(r.cur, {overlap}) <> '' THEN right(r.cur, {overlap}) || chr(10) || l.line ELSE l.line END"
    return f"""src AS (SELECT {id_col} AS doc_id, {text_col} AS text FROM {table} WHERE {_strip(f'coalesce({text_col}, {chr(39)}{chr(39)})')} <> ''),
 sp AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS parts FROM src),
 ln AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM sp),
 r AS (SELECT doc_id, 0 AS i, '' AS cur, 0 AS n, false AS has, CAST(NULL AS VARCHAR) AS emit FROM src
   UNION ALL
   SELECT r.doc_id, r.i + 1,
     CASE WHEN {full} THEN {newcur} WHEN r.has THEN r.cur || chr(10) || l.line ELSE l.line END,
     CASE WHEN {full} THEN length({newcur}) ELSE r.n + length(l.line) + 1 END,
     true, CASE WHEN {full} THEN {_strip('r.cur')} END
   FROM r JOIN ln l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
 lastr AS (SELECT doc_id, max(i) AS mi FROM r GROUP BY doc_id),
 raw AS (SELECT doc_id, i, emit AS chunk FROM r WHERE emit IS NOT NULL
   UNION ALL SELECT r.doc_id, r.i + 1, {_strip('r.cur')} FROM r JOIN lastr ON r.doc_id = lastr.doc_id AND r.i = lastr.mi WHERE r.has),
 chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, chunk AS text
   FROM raw WHERE chunk <> '')"""


TOK = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _terms(x):
    tok = TOK.format(x=x)
    return (f"list_concat({tok}, CASE WHEN len({tok}) >= 2 THEN list_transform(range(1, len({tok})), "
            f"lambda i: {tok}[i] || ' ' || {tok}[i + 1]) ELSE [] END)")


def index_sql():
    return f"""{chunks_sql()},
 tc AS (SELECT doc_id, chunk_no, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest({_terms('text')}) AS term FROM chunks) GROUP BY ALL),
 nch AS (SELECT count(*) AS n FROM chunks),
 vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tc GROUP BY term),
 terms AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocab, nch),
 post0 AS (SELECT tc.doc_id, tc.chunk_no, tc.term, tf * idf AS x FROM tc JOIN terms USING (term)),
 post AS (SELECT doc_id, chunk_no, term, x / (sqrt(sum(x * x) OVER (PARTITION BY doc_id, chunk_no)) + 1e-12) AS w FROM post0),
 db AS (SELECT doc_id, chunk_no, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % 768 AS INTEGER) AS bucket, CAST(sum(tf) AS DOUBLE) AS c FROM tc GROUP BY ALL),
 dense AS (SELECT doc_id, chunk_no, bucket, c / (sqrt(sum(c * c) OVER (PARTITION BY doc_id, chunk_no)) + 1e-12) AS w FROM db),
 qtc AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
 qdb AS (SELECT query_id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % 768 AS INTEGER) AS bucket, CAST(sum(tf) AS DOUBLE) AS c FROM qtc GROUP BY ALL),
 qdense AS (SELECT query_id, bucket, c / (sqrt(sum(c * c) OVER (PARTITION BY query_id)) + 1e-12) AS qw FROM qdb),
 qpost0 AS (SELECT query_id, term, tf * idf AS x FROM qtc JOIN terms USING (term)),
 qpost AS (SELECT query_id, term, x / (sqrt(sum(x * x) OVER (PARTITION BY query_id)) + 1e-12) AS qw FROM qpost0),
 ds AS (SELECT query_id, doc_id, chunk_no, sum(w * qw) AS dense FROM dense JOIN qdense USING (bucket) GROUP BY ALL),
 ls AS (SELECT query_id, doc_id, chunk_no, sum(w * qw) AS lexical FROM post JOIN qpost USING (term) GROUP BY ALL),
 dsn AS (SELECT *, CASE WHEN mx > mn THEN (dense - mn) / (mx - mn + 1e-12) ELSE dense END AS dense_norm FROM (
   SELECT *, CASE WHEN count(*) OVER w < (SELECT n FROM nch) THEN least(0.0, min(dense) OVER w) ELSE min(dense) OVER w END AS mn,
     CASE WHEN count(*) OVER w < (SELECT n FROM nch) THEN greatest(0.0, max(dense) OVER w) ELSE max(dense) OVER w END AS mx
   FROM ds WINDOW w AS (PARTITION BY query_id))),
 lsn AS (SELECT *, CASE WHEN mx > mn THEN (lexical - mn) / (mx - mn + 1e-12) ELSE lexical END AS lexical_norm FROM (
   SELECT *, CASE WHEN count(*) OVER w < (SELECT n FROM nch) THEN least(0.0, min(lexical) OVER w) ELSE min(lexical) OVER w END AS mn,
     CASE WHEN count(*) OVER w < (SELECT n FROM nch) THEN greatest(0.0, max(lexical) OVER w) ELSE max(lexical) OVER w END AS mx
   FROM ls WINDOW w AS (PARTITION BY query_id))),
 hy AS (SELECT coalesce(dsn.query_id, lsn.query_id) AS query_id, coalesce(dsn.doc_id, lsn.doc_id) AS doc_id,
   coalesce(dsn.chunk_no, lsn.chunk_no) AS chunk_no, dense, lexical,
   0.6 * coalesce(dense_norm, 0.0) + 0.4 * coalesce(lexical_norm, 0.0) AS score
   FROM dsn FULL OUTER JOIN lsn ON dsn.query_id = lsn.query_id AND dsn.doc_id = lsn.doc_id AND dsn.chunk_no = lsn.chunk_no),
 top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id, chunk_no) AS rank FROM hy)"""


def _index(spark, sf):
    return RT.build_index(t(spark, sf, "documents"))


def _queries(spark, sf):
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


register("chunk_text", f"WITH RECURSIVE {chunks_sql()} SELECT doc_id, chunk_no, text FROM chunks")(
    lambda spark, sf: RT.chunk_text(t(spark, sf, "documents")))

register("tokenize_ngrams", f"""SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_unigrams, CAST(len(tok) + greatest(len(tok) - 1, 0) AS BIGINT) AS n_terms,
  tok[1] AS first_token, CASE WHEN len(tok) >= 2 THEN tok[1] || ' ' || tok[2] END AS first_bigram
FROM (SELECT doc_id, {TOK.format(x='text')} AS tok FROM documents)""")(
    lambda spark, sf: t(spark, sf, "documents").select("doc_id", RT.tokens(F.col("text")).alias("tok"))
    .select("doc_id", "tok", RT.ngrams12_of(F.col("tok")).alias("terms"))
    .select("doc_id", F.size("tok").cast("long").alias("n_unigrams"), F.size("terms").cast("long").alias("n_terms"),
            F.get("tok", 0).alias("first_token"), F.get("terms", F.size("tok")).alias("first_bigram")))

register("hash_embed", f"""WITH qtc AS (SELECT query_id, term, count(*) AS tf FROM (SELECT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
 qdb AS (SELECT query_id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % 768 AS INTEGER) AS bucket, CAST(sum(tf) AS DOUBLE) AS c FROM qtc GROUP BY ALL)
SELECT query_id, bucket, {r6('c / (sqrt(sum(c * c) OVER (PARTITION BY query_id)) + 1e-12)')} AS w FROM qdb""")(
    lambda spark, sf: RT.hash_embed(_queries(spark, sf), ["query_id"]).select("query_id", "bucket", R("w").alias("w")))

register("tfidf", f"WITH RECURSIVE {index_sql()} SELECT doc_id, chunk_no, term, {r6('w')} AS w FROM post")(
    lambda spark, sf: _index(spark, sf)["postings"].select("doc_id", "chunk_no", "term", R("w").alias("w")))

register("dense_scores", f"WITH RECURSIVE {index_sql()} SELECT query_id, doc_id, chunk_no, {r6('dense')} AS dense FROM ds")(
    lambda spark, sf: RT.dense_scores(_index(spark, sf), _queries(spark, sf)).select(
        "query_id", "doc_id", "chunk_no", R("dense").alias("dense")))

register("lexical_scores", f"WITH RECURSIVE {index_sql()} SELECT query_id, doc_id, chunk_no, {r6('lexical')} AS lexical FROM ls")(
    lambda spark, sf: RT.lexical_scores(_index(spark, sf), _queries(spark, sf)).select(
        "query_id", "doc_id", "chunk_no", R("lexical").alias("lexical")))


def _minmax(spark, sf):
    idx = _index(spark, sf)
    n = idx.n_chunks
    s = RT.minmax_normalize(RT.lexical_scores(idx, _queries(spark, sf)), "lexical", n)
    return s.select("query_id", "doc_id", "chunk_no", R("lexical_norm").alias("lexical_norm"))


register("minmax_normalize", f"WITH RECURSIVE {index_sql()} SELECT query_id, doc_id, chunk_no, {r6('lexical_norm')} AS lexical_norm FROM lsn")(_minmax)

register("hybrid_search", f"""WITH RECURSIVE {index_sql()}
SELECT query_id, rank, doc_id, chunk_no, {r6('score')} AS score, {r6('coalesce(dense, 0.0)')} AS dense,
  {r6('coalesce(lexical, 0.0)')} AS lexical FROM top WHERE rank <= 8""")(
    lambda spark, sf: RT.hybrid_search(_index(spark, sf), _queries(spark, sf)).withColumn("rank", F.col("rank").cast("long")))


def _centroids(spark, sf):
    e = t(spark, sf, "embeddings")
    p = e.select("label", F.posexplode("embedding").alias("d", "x"))
    c = p.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return c.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("s")) \
        .select(F.col("label").cast("long").alias("query_id"), F.transform("s", lambda s: s["x"]).alias("embedding"))


register("vector_scores", f"""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
 c AS (SELECT CAST(label AS BIGINT) AS query_id, d, avg(x) AS qx FROM e GROUP BY ALL),
 nv AS (SELECT vec_id, sqrt(sum(x * x)) AS nv FROM e GROUP BY 1),
 nq AS (SELECT query_id, sqrt(sum(qx * qx)) AS nq FROM c GROUP BY 1),
 s AS (SELECT query_id, vec_id, sum(x * qx) AS dot FROM e JOIN c USING (d) GROUP BY ALL),
 sc AS (SELECT s.query_id, vec_id AS item_id, dot / ((nv + 1e-12) * (nq + 1e-12)) AS score FROM s JOIN nv USING (vec_id) JOIN nq USING (query_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, item_id) AS rank FROM sc)
SELECT query_id, rank, item_id, {r6('score')} AS score FROM r WHERE rank <= 10""")(
    lambda spark, sf: SR.vector_search(t(spark, sf, "embeddings"), _centroids(spark, sf), 10).withColumn("rank", F.col("rank").cast("long")))

def _every_20th(spark, sf):
    e = t(spark, sf, "embeddings")
    return e, e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


register("approx_neighbours")(lambda spark, sf: SR.approx_neighbours(*_every_20th(spark, sf)).withColumn("rank", F.col("rank").cast("long")))


def _recall(spark, sf):
    e, q = _every_20th(spark, sf)
    exact = SR.vector_search(e, q, 10)
    kth = exact.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("wanted"))
    near = SR.approx_neighbours(e, q, 10).join(kth, "query_id")  # a neighbour as near as the tenth counts, whatever its id
    found = near.groupBy("query_id").agg(F.count_if(F.col("score") >= F.col("kth")).alias("found"), F.max("wanted").alias("wanted"))
    return found.agg(F.count(F.lit(1)).alias("n_queries"), (F.sum("found") / F.sum("wanted") >= 0.9).alias("recall_reached"))


register("approx_neighbours_recall", "SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0")(_recall)

register("lexical_search", f"""WITH RECURSIVE {index_sql()},
 lt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, doc_id, chunk_no) AS rank FROM ls)
SELECT query_id, rank, doc_id, chunk_no, {r6('lexical')} AS lexical FROM lt WHERE rank <= 8""")(
    lambda spark, sf: RT.lexical_search(_index(spark, sf), _queries(spark, sf)))


def _context(spark, sf):
    idx = _index(spark, sf)
    hits = RT.hybrid_search(idx, _queries(spark, sf), k=3).withColumn("request_id", F.lit(1).cast("long"))
    return RT.context_block(hits, idx, max_blocks=10)


register("context_block", f"""WITH RECURSIVE {index_sql()},
 h AS (SELECT top.query_id, top.doc_id, top.chunk_no, round(top.score, 6) + 0.0 AS score, chunks.text FROM top
   JOIN chunks USING (doc_id, chunk_no) WHERE rank <= 3),
 b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY score DESC, query_id) AS r1 FROM h),
 o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, chunk_no) AS ord FROM b WHERE r1 = 1)
SELECT CAST(1 AS BIGINT) AS request_id,
  string_agg(printf('[chunk:%s score:%.3f]', doc_id || ':' || chunk_no, score) || chr(10) || text, chr(10) || chr(10) ORDER BY ord) AS context
FROM o WHERE ord <= 10""")(_context)

register("extract_section", f"""WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
   generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 st AS (SELECT doc_id, min(i) AS s FROM ln WHERE contains(lower(line), 'license') GROUP BY doc_id),
 x AS (SELECT ln.*, s FROM ln JOIN st USING (doc_id) WHERE i >= s),
 en AS (SELECT doc_id, min(i) AS e FROM x WHERE i > s AND {_strip('line')} <> '' AND (
   (regexp_matches({_strip('line')}, '^[A-Z][A-Z\\s:/()_-]{{6,}}$') AND NOT contains({_strip('line')}, 'LICENSE'))
   OR (starts_with(lower({_strip('line')}), '=== ') AND NOT contains(lower({_strip('line')}), 'license'))) GROUP BY doc_id)
SELECT x.doc_id, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS section FROM x LEFT JOIN en USING (doc_id)
WHERE e IS NULL OR i < e GROUP BY x.doc_id""")(
    lambda spark, sf: RT.extract_section(t(spark, sf, "documents"), "license"))
