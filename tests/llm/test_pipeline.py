import re

import corpus_pipeline as C
from tabscope.llm import queries as Q

from .test_pii_mixing import luhn
from .test_quality import brute
from .test_simhash import brute_classes
from .test_tokens import check_packed

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, []
    for i, (name, stage) in enumerate(C.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{scratch}/{i}")
        docs = spark.read.parquet(f"{scratch}/{i}")
        rows = docs.collect()
        assert name == "best-fit packing" or docs.columns == columns
        text = {r.doc_id: r.text for r in before}
        if name == "quality rules":
            kept = {r.doc_id for r in rows}
            failed = {d for d, t in text.items() for c in [brute(t)] if c[0] < 20 or 100 * c[4] > 30 * c[0]}
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert not kept & failed and all(d in kept for d in text if labels.get(d) == 1 and d not in failed)
        elif name == "simhash near-dedup":
            assert sorted(r.doc_id for r in rows) == sorted({c for _, _, c in brute_classes([(r.doc_id, r.text) for r in before])})
        elif name == "pii surrogates":
            assert len(rows) == len(before)
            assert not [m for r in rows for m in re.findall(r"[\w.+-]+@[\w.-]+\.\w+|\b\d{16}\b", r.text) if m in text[r.doc_id] and ("@" in m or luhn(m) and m[0] == "4")]
        elif name == "mix sources":
            size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in text.items()}
            assert all(r.text == text[r.doc_id] for r in rows)
            assert abs(sum(size[r.doc_id] for r in rows) - sum(size.values())) < 0.2 * sum(size.values())
        else:
            check_packed(rows, [(r.doc_id, r.text) for r in before], 4096)
    whole = Q.pipeline(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_stages_with_nulls_repeats_long_texts_and_clashing_columns(spark, scratch):
    """Every stage keeps its columns; null texts and texts under 20 words go at the first, of copies one row stays."""
    words = [f"word{i}" for i in range(400)]
    clean = " ".join(words[:60])
    rows = [(None, None, None, None, None, 1, "a"), (1, None, "en", None, 0, 2, "b"), (2, "", "en", "web", 0, 3, "c"), (3, " \n\t ", None, "web", 4, 4, "d"),
            (4, clean, "en", "web", len(clean), 5, "e"), (4, clean, "en", "web", len(clean), 5, "e"), (None, clean, None, None, None, 6, "f"),
            (5, clean[::-1], "de", "wiki", 9, None, None), (6, clean[::-1], "de", None, 9, 7, "g"),
            (7, " ".join(f"{a}{b}" for a in words for b in "abcdefghij" * 10), "fr", "books", 1, 8, "h")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, kept string"
    for i, data in enumerate((rows, [])):
        docs = spark.createDataFrame(data, schema)
        for j, (name, stage) in enumerate(C.STAGES):
            out = stage(spark, docs, SF)
            assert name == "best-fit packing" or out.columns == docs.columns
            out.write.parquet(f"{scratch}/{i}-{j}")
            docs = spark.read.parquet(f"{scratch}/{i}-{j}")
            ids = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
            if not data:
                assert ids == []
            elif name == "quality rules":
                assert not set(ids) & {"1", "2", "3"} and set(ids) <= {"4", "5", "6", "7", "None"} and ids.count("4") in (0, 2)
                docs = spark.createDataFrame(data, schema)  # the next stages meet the nulls as well
            elif name == "simhash near-dedup":
                # the wordless rows are one class (least id 1), the copies of 4 one row, 5 goes before 6
                assert ids == ["1", "4", "5", "7"]
                docs = spark.createDataFrame(data, schema)
            elif name == "pii surrogates":
                assert len(ids) == len(rows)
                assert sorted(str(r.text) for r in docs.collect()) == sorted(str(r[1]) for r in rows)
            elif name == "mix sources":
                assert set(ids) <= {str(r[0]) for r in rows}
                docs = spark.createDataFrame(data, schema)
            else:
                assert {str(r[0]) for r in rows} == set(ids) and docs.where("length > 4096").isEmpty()
