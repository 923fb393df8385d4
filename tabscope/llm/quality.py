"""Quality rules: text measures and a learned decision list of threshold conjunctions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["chars_per_word", "symbols_per_word", "dup_lines_per_line", "repeat_words_per_word", "upper_words_per_word",
          "bangs_per_word", "pipes_per_word", "stops_per_word", "same_as_previous_per_word", "distinct_words_per_word",
          "commonest_word_per_word"]
#: Labelled rows that the rules are learned from, at most; the rows with the smallest hash of their doc_id.
MAX_LABELS = 20_000


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in runs of ``window`` (a power of two) words that occur twice or more, the first occurrence included.

    Runs are compared exactly: each doubling numbers the distinct pairs of neighbouring half-runs.
    """
    if len(ids) <= window:
        return 0
    code, step = ids.astype(np.int64), 1
    while step < window:
        distinct, code = np.unique(code[:-step] * (int(code.max()) + 1) + code[step:], return_inverse=True)
        if len(distinct) == len(code):
            return 0
        step *= 2
    again = np.bincount(code)[code] > 1
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:-window] += again
    edge[window:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: str | None) -> list[float]:
    """COUNTS then RATIOS of one whole text; all 0 for a null or wordless text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    blank = " \t\n\v\f\r"
    word_chars = len(text) - sum(text.count(c) for c in blank)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip(blank)]
    dup = 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    repeat = repeat_words(ids)
    if not n:
        return [0, 0, symbols, 0, 0] + [0.0] * len(RATIOS)
    return [n, word_chars, symbols, dup, repeat,
            word_chars / n, symbols / n, dup / len(lines), repeat / n, sum(map(bytes.isupper, words)) / n,
            text.count("!") / n, text.count("|") / n, text.count(".") / n, float((ids[1:] == ids[:-1]).sum()) / n,
            len(number) / n, float(np.bincount(ids).max()) / n]


def measured(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """``docs`` with one more column, a struct of the COUNTS (long) and RATIOS (double) of the whole text."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATIOS)
    names = COUNTS + RATIOS
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t) for t in batch.column(at).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, into])

    struct = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in RATIOS])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, struct)]))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.at_least else x < self.threshold

    def sql(self, prefix: str = "") -> str:
        return f"{prefix}{self.feature} {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: reject. ``hits`` and ``misses``: labelled rows of either class that it covered."""

    conditions: tuple[Condition, ...]
    hits: int
    misses: int

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for c in self.conditions:
            out &= c.holds(x[:, names.index(c.feature)])
        return out

    def sql(self, prefix: str = "") -> str:
        return " AND ".join(c.sql(prefix) for c in self.conditions)


def _best_condition(x: np.ndarray, bad: np.ndarray, names: list[str]) -> Condition | None:
    """The threshold condition of largest FOIL gain on the rows that the rule covers so far."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below = np.concatenate([[0], np.cumsum(b)])[cuts]
        for at_least, p, n in ((True, p0 - below, len(b) - cuts - (p0 - below)), (False, below, cuts - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], Condition(name, at_least, float((v[cuts[k] - 1] + v[cuts[k]]) / 2)))
    return best[1]


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 24, max_conditions: int = 4,
                min_precision: float = 0.95, min_hits: int = 5, seed: int = 11) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows not yet covered, prune it on the rest.

    A rule grows by the condition of largest FOIL gain until it covers no good row; pruning cuts it to the prefix
    with the best (hits - misses) / (hits + misses) on the pruning rows. Learning ends at the first rule that
    covers fewer than ``min_hits`` bad rows or is right less often than ``min_precision`` on them.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    to_grow = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    while len(rules) < max_rules and (left & bad).sum() >= min_hits and (left & ~bad).any():
        inside, grown = left & to_grow, []
        while len(grown) < max_conditions and bad[inside].any() and (~bad[inside]).any():
            c = _best_condition(x[inside], bad[inside], names)
            if c is None:
                break
            grown.append(c)
            inside = inside & c.holds(x[:, names.index(c.feature)])
        if not grown:
            break
        worth = []
        for k in range(1, len(grown) + 1):
            on = Rule(tuple(grown[:k]), 0, 0).covers(x, names) & left & ~to_grow
            p, n = int((on & bad).sum()), int((on & ~bad).sum())
            worth.append((p - n) / (p + n) if p + n else -1.0)
        conditions = tuple(grown[:int(np.argmax(worth)) + 1])
        on = Rule(conditions, 0, 0).covers(x, names) & left
        rule = Rule(conditions, int((on & bad).sum()), int((on & ~bad).sum()))
        if rule.hits < min_hits or rule.hits < min_precision * (rule.hits + rule.misses):
            break
        rules.append(rule)
        left &= ~on
    return rules


def base_failed(m: str = "measures") -> Column:
    return F.expr(f"{m}.n_words < 20 OR 100 * {m}.n_repeat_words > 30 * {m}.n_words")


def fit_rules(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, **learning) -> list[Rule]:
    """Rules from the ``quality`` (0 bad, 1 good) of at most ``max_labels`` labelled documents (``labels``: doc_id, quality).

    The rows with the smallest hash of their id are taken, so the choice is the same in every run; documents that
    fail the base rules are left out. No labels, or labels of one class only: no rules.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id")  # at most max_labels ids
    rows = (measured(texts).where(~base_failed()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("measures").alias("m"))
            .select("doc_id", "quality", *(f"m.{r}" for r in RATIOS)).orderBy("doc_id").toPandas())
    return learn_rules(rows[RATIOS].to_numpy(float).reshape(-1, len(RATIOS)), rows["quality"].to_numpy() == 0, RATIOS, **learning)


def rule_number(rules: list[Rule], m: str = "measures") -> Column:
    """The ordered conditional expression: number (from 1) of the first rule that rejects, else null."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {r.sql(m + '.')} THEN {i}" for i, r in enumerate(rules, 1)) + " END")


def judged(docs: DataFrame, rules: list[Rule], into: str = "measures") -> DataFrame:
    """``docs`` (text) with the struct ``into``: COUNTS, RATIOS, ``base_failed``, ``rule``, ``kept``.

    Null, empty and wordless texts have no words, so they fail the base rules. Every input row gives one row;
    extra columns pass through untouched.
    """
    return measured(docs, into=into).withColumn(into, F.col(into).withField("base_failed", base_failed(into)).withField(
        "rule", rule_number(rules, into))).withColumn(into, F.col(into).withField("kept", F.expr(
            f"NOT {into}.base_failed AND {into}.rule IS NULL")))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, COUNTS, ``base_failed``, ``kept``, ``rule`` and RATIOS."""
    out = judged(docs.select("doc_id", "text"), fit_rules(docs, labels))
    return out.select("doc_id", *(f"measures.{c}" for c in COUNTS), "measures.base_failed", "measures.kept", "measures.rule",
                      *(f"measures.{r}" for r in RATIOS))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, with its own columns."""
    into = "measures"
    while into in docs.columns:
        into += "_"
    return judged(docs, fit_rules(docs, labels), into).where(f"{into}.kept").select(docs.columns)
