"""TF-IDF of texts that stay where they are dealt (R4, R6, R8 in memory).

Texts are dealt by id to parts of about ``CHARS`` characters. A part sends each of its terms once, as a 64-bit hash with
the number of its chunks that hold it, to the bucket of the hash; the bucket adds up and answers every part with the
frequencies in the order of the part's hashes. Postings themselves are never shuffled: a part makes them again from its
texts, with the answer beside them. Queries ask in the same way, as parts that hold no chunks. Terms of equal hashes
count as equal (10^8 terms hold such a pair with a chance of 0.0003).

  texts  (part, id, no, words)                words of a text, with one space between them
  sent   (part, bucket, n, keys, more, counts)  n: the part's texts
  answer (part, bucket, n, df)                n: all texts; df twice, and one more if a query has the term
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash as WH

#: Characters of a part: some million terms.
CHARS = 6_000_000
#: Parts for which there is one bucket of hashes.
PARTS_A_BUCKET = 4

SENT = "part int, bucket int, n long, keys binary, more binary, counts binary"
ANSWER = "part int, bucket int, n long, df binary"


def n_parts(df: DataFrame, text_col: str) -> int:
    chars = df.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-chars // CHARS))


def deal(df: DataFrame, id_col: str, n: int, asking: bool = False) -> DataFrame:
    """The rows with their ``part``; equal ids meet in a part. Parts that ask only have numbers below 0."""
    part = F.pmod(F.xxhash64(id_col), F.lit(n).cast("long")).cast("int")
    return df.withColumn("part", -1 - part if asking else part).repartition(n, "part")


def worded(df: DataFrame, id_col: Column, no: Column, tok: Column) -> DataFrame:
    """The table ``texts``."""
    return df.select("part", id_col.alias("id"), no.cast("int").alias("no"), F.array_join(tok, " ").alias("words"))


class Postings:
    """Terms (words and pairs of words) of a part's texts: postings by term and then text, texts in (id, no) order."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        one = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
        ids, nos = one(table["id"]), one(table["no"])
        place = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False)
        keys = place.astype(np.int64) << 32 | nos.to_numpy(zero_copy_only=False)
        by_text = np.argsort(keys, kind="stable")
        _, self.row, text = np.unique(keys[by_text], return_index=True, return_inverse=True)
        self.n, self.ids, self.nos = len(self.row), ids.take(pa.array(by_text[self.row])), nos.take(pa.array(by_text[self.row]))
        self.words = WH.Words(one(table["words"]).take(pa.array(by_text)))
        k, at = self.words.terms(), text[self.words.text_of]
        self.every = at  # the text of every occurrence
        order = WH.order_of(k)  # the texts of a term stay in order
        k, at = k[order], at[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        begins = new.copy()
        begins[1:] |= at[1:] != at[:-1]
        first = np.flatnonzero(begins)
        self.at, self.tf = at[first], np.diff(first, append=len(k))
        starts = np.flatnonzero(new[first])  # of the terms, among the postings
        self.keys, self.texts = k[first][starts], np.diff(starts, append=len(first))
        self.term = np.repeat(np.arange(len(starts)), self.texts)
        self.example = order[first][starts]  # an occurrence of each term

    def terms(self) -> pa.Array:
        """The terms as text."""
        return self.words.strings(self.example)

    def idf(self, answer: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inverse frequency of each term, 0 for those that no text of the corpus holds; the texts' norms; whether a query
        has the term."""
        rows = answer.sort_by("bucket").to_pydict()
        df = np.concatenate([np.empty(0, "<i8"), *[np.frombuffer(zlib.decompress(x), "<i8") for x in rows["df"]]])
        df, asked = (df >> 1).astype(float), (df & 1).astype(bool)
        n = rows["n"][0] if rows["n"] else 0
        idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
        x = self.tf * idf[self.term]
        return idf, np.sqrt(np.bincount(self.at, x * x, self.n)) + 1e-12, asked

    def weights(self, answer: pa.Table) -> np.ndarray:
        """The TF-IDF weight of each posting, L2-normalised per text."""
        idf, norm, _ = self.idf(answer)
        return self.tf * idf[self.term] / norm[self.at]


def _bound(i: int, buckets: int) -> int:
    return min((i << 64) // buckets, (1 << 64) - 1)


#: Bytes of a step from hash to hash that are stored as they are; those above are few values and are packed.
PLAIN = 5


def _steps(keys: np.ndarray, base: int) -> tuple[bytes, bytes]:
    """Sorted hashes as the steps between them, byte by byte."""
    planes = np.diff(keys, prepend=np.uint64(base)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return planes[:PLAIN].tobytes(), zlib.compress(planes[PLAIN:].tobytes(), 1)


def _keys(plain: bytes, more: bytes, base: int) -> np.ndarray:
    planes = np.concatenate([np.frombuffer(x, np.uint8).reshape(k, -1) for x, k in ((plain, PLAIN), (zlib.decompress(more), 8 - PLAIN))])
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64) + np.uint64(base)


def sent(texts: DataFrame, buckets: int) -> DataFrame:
    """The table ``sent``: a row for each part and bucket, also without a term, so that every bucket knows all texts."""
    def run(table: pa.Table) -> pa.Table:
        p = Postings(table)
        asking = (part := table["part"][0].as_py()) < 0
        edges = [*np.searchsorted(p.keys, np.array([_bound(i, buckets) for i in range(buckets)], np.uint64)), len(p.keys)]
        rows = []
        for i in range(buckets):
            keys = p.keys[edges[i]:edges[i + 1]]
            counts = np.zeros(len(keys), "<i8") if asking else p.texts[edges[i]:edges[i + 1]].astype("<i8")
            rows.append((part, i, 0 if asking else p.n, *_steps(keys, _bound(i, buckets)), zlib.compress(counts.tobytes(), 1)))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["part", "bucket", "n", "keys", "more", "counts"])

    return texts.groupBy("part").applyInArrow(run, SENT)


def answers(rows: DataFrame, buckets: int) -> DataFrame:
    """The table ``answer``, of all that was sent."""
    def run(table: pa.Table) -> pa.Table:
        parts, bucket = table["part"].to_numpy(), table["bucket"][0].as_py()
        base = _bound(bucket, buckets)
        keys = [_keys(plain, more, base) for plain, more in zip(table["keys"].to_pylist(), table["more"].to_pylist())]
        counts = [np.frombuffer(zlib.decompress(c), "<i8") for c in table["counts"].to_pylist()]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        df = 2 * np.bincount(inverse, np.concatenate(counts)).astype("<i8")
        df[inverse[np.repeat(parts < 0, [len(c) for c in counts])]] |= 1
        df = df[inverse]
        ends = np.cumsum([len(c) for c in counts])
        back = [zlib.compress(df[e - len(c):e].tobytes(), 1) for e, c in zip(ends, counts)]
        return pa.table([pa.array(parts, pa.int32()), pa.array([bucket] * len(parts), pa.int32()),
                         pa.array([int(table["n"].to_numpy().sum())] * len(parts), pa.int64()), pa.array(back, pa.binary())], names=["part", "bucket", "n", "df"])

    return rows.groupBy("bucket").applyInArrow(run, ANSWER)


def with_answers(texts: DataFrame, answer: DataFrame, n: int, make: Callable[[Postings, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """``make`` (postings, answer) of every part; the texts are dealt to ``n`` parts already."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return make(Postings(left), right)

    return texts.groupBy("part").cogroup(answer.repartition(n, "part").groupBy("part")).applyInArrow(run, schema)


def postings(texts: DataFrame, answer: DataFrame, n: int, id_col: str = "doc_id", no_col: str = "chunk_no") -> DataFrame:
    """Id, no, term, w."""
    def make(p: Postings, answer: pa.Table) -> pa.Table:
        return pa.table([p.ids.take(pa.array(p.at)), p.nos.take(pa.array(p.at)), p.terms().take(pa.array(p.term)), pa.array(p.weights(answer))],
                        names=[id_col, no_col, "term", "w"])

    kind = texts.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(no_col, T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType())])
    return with_answers(texts, answer, n, make, schema)


def query_weights(texts: DataFrame, answer: DataFrame, n: int) -> DataFrame:
    """query_id, tid (the term's hash), qw: TF-IDF weights of queries over the terms of the corpus."""
    def make(p: Postings, answer: pa.Table) -> pa.Table:
        w = p.weights(answer)
        known = np.flatnonzero(w > 0)
        return pa.table([p.ids.take(pa.array(p.at[known])), pa.array(p.keys.view(np.int64)[p.term[known]]), pa.array(w[known])], names=["query_id", "tid", "qw"])

    schema = T.StructType([T.StructField("query_id", texts.schema["id"].dataType), T.StructField("tid", T.LongType()), T.StructField("qw", T.DoubleType())])
    return with_answers(texts, answer, n, make, schema)


def blocks(texts: DataFrame, answer: DataFrame, n: int, dims: int | None) -> DataFrame:
    """A part as one row of ``search``'s blocks of chunks: block, n, ids and numbers of its chunks, and, packed, hashed
    counts (if ``dims``) and the postings of the queries' terms: hashes, idf and texts of the terms, place and count of each
    posting, and the chunks' norms."""
    def make(p: Postings, answer: pa.Table) -> pa.Table:
        idf, norm, asked = p.idf(answer)
        counts = WH.counts_packed(p.every, p.words.md5(), p.n, dims) if dims else None
        hit = asked[p.term]
        lexical = (p.keys[asked].view(np.int64), idf[asked], p.texts[asked], WH.small(p.at[hit]), WH.small(p.tf[hit]), norm)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, p.n], pa.int32()), x)
        return pa.table({"block": pa.array([int(left)], pa.int64()) for left in answer["part"][:1].to_pylist()} | {
            "n": pa.array([p.n], pa.int32()), "doc_ids": one(p.ids), "chunk_nos": one(p.nos), "packed": pa.array([WH.pack((counts, lexical))], pa.binary())})

    schema = T.StructType([T.StructField(c, k) for c, k in (("block", T.LongType()), ("n", T.IntegerType()), (
        "doc_ids", T.ArrayType(texts.schema["id"].dataType)), ("chunk_nos", T.ArrayType(T.IntegerType())), ("packed", T.BinaryType()))])
    return with_answers(texts, answer, n, make, schema)
