import re
from collections import Counter

import numpy as np
import pytest

from tabscope.llm import queries as Q
from tabscope.llm.quality import COUNTS, keep_good, learn_rules, measures, quality_verdicts

SF = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)]


@pytest.mark.parametrize("text", [None, "", "  \n", "a b c d e f g h a b c d e f g h", "x " * 9, "x\n\nx\n \nx", "É|é\x0b<b>\x85 ü",
                                  "a b c d e f g h i a b c d e f g h", "w " * 40000])
def test_counts(text):
    assert measures(text)[:5] == (brute(text) if text is None or len(text) < 1000 else [40000, 40000, 0, 0, 40000])


def test_learns_conjunctions_and_leaves_good_rows():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] < 0.4)
    rules = learn_rules(x, bad, ["a", "b", "c"])
    out = np.zeros(3000, dtype=bool)
    for r in rules:
        out |= r.covers(x, ["a", "b", "c"])
    assert (out & bad).sum() > 0.9 * bad.sum() and (out & ~bad).sum() < 0.01 * len(x)
    assert learn_rules(x, np.zeros(3000, dtype=bool), ["a", "b", "c"]) == []
    assert learn_rules(x[:0], bad[:0], ["a", "b", "c"]) == []


def test_edge_rows(spark):
    good = "plain words that differ one from the other go on here until twenty of them have been put in this single line"
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (4, "a b c d e f g h " * 9), (5, good + " w" * 30000)]
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, measures string, kept double")
    labels = spark.createDataFrame([(3, 1), (4, None), (9, 0)], "doc_id long, quality int")
    got = quality_verdicts(df, labels).select("doc_id", *COUNTS, "base_failed", "kept").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].kept and not by[1].kept and by[1].base_failed and by[4].base_failed and not by[4].kept and by[None].kept
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and sorted([r.doc_id for r in kept.collect()], key=repr) == [3, 3, None]
    assert quality_verdicts(df.limit(0), labels.limit(0)).count() == 0


def test_query_against_brute_force_and_labels(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.op1_quality_rules(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        counts = brute(text[r.doc_id])
        assert [r[c] for c in COUNTS] == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert r.kept == (not r.base_failed and r.rule is None)
    judged = [(r.kept, quality[r.doc_id]) for r in rows if r.doc_id in quality and not r.base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.97 * len(judged)
