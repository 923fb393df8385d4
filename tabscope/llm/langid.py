"""Language identification: binary n-gram classifiers for the bits of error-correcting language codewords."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Hashed n-gram features (n = 1, 2, 3), a power of two.
BUCKETS = 4096
#: Learning rows in all and per language, at most: the rows with the smallest hash of their doc_id.
MAX_ROWS, MAX_PER_LANGUAGE = 4000, 500
#: Share of the best language below which a prediction is flagged as ambiguous.
AMBIGUOUS = 0.6

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square-rooted counts of a whole text's letter n-grams; None if it has no letter."""
    if not text or not any(c.isalpha() for c in text):
        return None
    code = np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    count, h = np.zeros(BUCKETS), np.zeros(len(code), dtype=np.uint64)
    for n in range(3):
        h = h[:len(code) - n] * np.uint64(1_000_003) + code[n:] + np.uint64(n)
        bucket = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        count += np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
    x = np.sqrt(count)
    return (x / np.linalg.norm(x)).astype(np.float32)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of +1 and -1, one row each: all different splits for few languages, else the random code of largest
    smallest distance among some."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 6:
        columns = [[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for i in range(k)] for c in range(1, 2 ** (k - 1))]
        return np.array(columns).T
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(60):
        code = rng.choice([-1, 1], size=(k, int(np.ceil(15 * np.log2(k)))))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        distance = (code.shape[1] - code @ code.T + 2 * code.shape[1] * np.eye(k)).min()
        if distance > best[0]:
            best = (distance, code)
    return best[1]


@dataclass
class Model:
    """``languages`` in order, their ``code`` words, and per bit the classifier's column of ``weights``, ``bias`` and ``trust``."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Share of each language (rows: texts), by loss-weighted decoding: a bit's logistic loss counts by its trust."""
        if self.code.shape[1] == 0:
            return np.ones((len(x), len(self.languages)))
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]) @ self.trust * self.code.shape[1] / 2
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return odds / odds.sum(axis=1, keepdims=True)


def learn(x: np.ndarray, language: list[str], rounds: int = 150, rate: float = 40.0, decay: float = 1e-4) -> Model:
    """One logistic classifier per code bit, by accelerated gradient descent; languages weigh the same."""
    languages = sorted(set(language))
    y = np.array([languages.index(v) for v in language], dtype=int)
    code = codewords(len(languages))
    bits = code.shape[1]
    w, b = np.zeros((BUCKETS, bits)), np.zeros(bits)
    if bits == 0:
        return Model(languages, code, w, b, np.zeros(0))
    sign = code[y]
    weight = (1 / (np.bincount(y) * len(languages)))[y][:, None]
    step_w, step_b, look_w, look_b = w.copy(), b.copy(), w, b
    for t in range(rounds):
        pull = -sign * weight / (1 + np.exp(np.clip(sign * (x @ look_w + look_b), -30, 30)))
        new_w, new_b = look_w - rate * (x.T @ pull + decay * look_w), look_b - rate / 10 * pull.sum(axis=0)
        look_w, look_b = new_w + t / (t + 3) * (new_w - step_w), new_b + t / (t + 3) * (new_b - step_b)
        step_w, step_b = new_w, new_b
    right = (np.sign(x @ step_w + step_b) == sign) * weight
    trust = np.maximum(right.sum(axis=0) - 0.5, 0.01)
    return Model(languages, code, step_w.astype(np.float32), step_b, trust / trust.sum())


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 3 (null: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _with_features(docs: DataFrame) -> DataFrame:
    at, names = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(at).to_pylist()]
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([None if r is None else r.tobytes() for r in rows], pa.binary())], names=[*names, "x"])

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("x", T.BinaryType())]))


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, per_language: int = MAX_PER_LANGUAGE) -> Model:
    """Model from text and non-null ``lang`` of documents that are not held out, at most ``per_language`` of a language.

    Chosen by the smallest hash of the doc_id among the rows of a language, so the sample is bounded and the same in
    every run; with many languages each gets an equal share of ``max_rows``. Texts without a letter teach nothing.
    """
    small_batches(docs.sparkSession)
    able = docs.where(F.coalesce(remainder(F.col("doc_id")) != 1, F.lit(False)) & F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"))
    n = max(1, able.agg(F.count_distinct("lang")).first()[0])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = able.withColumn("r", rank).where(F.col("r") <= min(per_language, max(1, max_rows // n))).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows ids, or one per language
    rows = _with_features(texts).where("x IS NOT NULL").groupBy("doc_id", "lang").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in rows], dtype=np.float32).reshape(-1, BUCKETS)
    return learn(x, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row, from its whole text alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(2).to_pylist()]
            known = [i for i, r in enumerate(rows) if r is not None] if model.languages else []
            name, score = ["und"] * len(rows), [0.0] * len(rows)
            if known:
                share = model.shares(np.stack([rows[i] for i in known]))
                for i, best, s in zip(known, share.argmax(axis=1).tolist(), share.max(axis=1).tolist()):
                    name[i], score[i] = model.languages[best], s
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(score, pa.float64()),
                                              pa.array([s < AMBIGUOUS for s in score], pa.bool_())],
                                             names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def languages(docs: DataFrame) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text, lang), learned from its labelled rows that are not held out.

    A row is held out if crc32 of its doc_id as text is 1 modulo 3; rows with a null doc_id are neither held out nor
    learned from. Null, empty and letterless texts are ``und`` with score 0, as is every text if nothing was learned;
    one learned language has score 1. Repeated rows are returned as often as they come, extra columns are ignored and
    an empty table gives no rows. ``score`` is the best language's share; ``ambiguous`` flags a share under 0.6.
    """
    return predict(docs, fit(docs))
