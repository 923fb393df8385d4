import re
from collections import defaultdict

import duckdb
import pytest

from pyspark.sql import functions as F

from tabscope.llm import mixing, pii
from tabscope.llm import queries as Q

SF = "/root/testdata/sf0.001"


def luhn(s):
    digits = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


ROWS = [(1, "mail a.b@mail7.example.com, A.B@mail7.example.com; +1 (988) 555-2485 or (988) 555-2485 or 988-555-2485."),
        (2, "card 4845168114407329, 4845 1681 1440 7329, not 9807915762804490; ip 97.51.17.173, v 1.2.3.4.5"),
        (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x'), (None, "a.b@mail7.example.com"),
        (4, "Mr. John Smith met Mrs Alice Smith and Dr. Smith; Елена Иванова. Herr Müller"), (4, "Mr. John Smith"), (4, "Mr. John Smith"),
        (5, None), (6, ""), (7, "clean text, 12 of 345"), (8, "x " * 40000 + "97.51.17.173 " + "y" * 100000)]


def test_surrogates(spark):
    df = spark.createDataFrame([(d, t, len(t or ""), "m", 1) for d, t in ROWS], "doc_id long, text string, n_chars int, pii_map string, n int")
    out = pii.replace_entities(df, count_into="found")
    assert out.columns == [*df.columns, "found"]
    rows = out.collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        assert r.n_chars == len(r.text or "")
    assert len(rows) == len(ROWS)
    one = got[1][0].text
    mails = re.findall(r"[\w.]+@[\w.]+", one)
    assert mails[0].lower() == mails[1].rstrip(".").lower() and mails[0] != "a.b@mail7.example.com" and mails[1][0].isupper()
    assert got[None][0].text == mails[0]
    phones = re.findall(r"\(?\d{3}\)?[ -]555-\d{4}", one)
    assert len(phones) == 3 and len({re.sub(r"\D", "", x) for x in phones}) == 1 and "2485" not in one
    cards = re.search(r"card (\d{16}), (\d{4} \d{4} \d{4} \d{4}), not 9807915762804490; ip (\S+), v 1.2.3.4.5", got[2][0].text)
    assert cards[1] == cards[2].replace(" ", "") and luhn(cards[1]) and cards[1] != "4845168114407329"
    assert got[8][0].text.endswith(cards[3] + " " + "y" * 100000) and cards[3] != "97.51.17.173"
    assert re.fullmatch(r'token = "[0-9a-f]{40}" x', got[3][0].text) and "04dbebab" not in got[3][0].text
    people = [r for r in got[4] if "met" in r.text][0].text
    first, second, third = re.findall(r"(?:Mr\.|Mrs|Dr\.) (?:\w+ )?(\w+)", people)
    assert first == second == third and "Smith" not in people and "Müller" not in people and "Елена" not in people
    assert re.search(r"Mr\. (\w+)", people)[1] in pii.GIVEN[("m", "latin")] and re.search(r"Mrs (\w+)", people)[1] in pii.GIVEN[("f", "latin")]
    assert {r.text for r in got[4] if "met" not in r.text} == {re.match(r"Mr\. \w+ \w+", people)[0]}
    assert got[5][0].text is None and got[6][0].text == "" and got[7][0].text == ROWS[9][1] and got[7][0].found == 0
    assert pii.replace_entities(df.limit(0)).count() == 0
    other = pii.replace_entities(df, key="another").where("doc_id = 3").first().text
    assert other != got[3][0].text


def test_cards_beside_other_digits(spark):
    card = "4845168114407329"
    texts = [f"card {card} 123", "4845 1681 1440 7329 12/27", f"ref 7 {card}", "ref 4 4845 1681 1440 7329 x", f"{card} {card}", f"12345 123-45-6789 {card} 12abc",
             "48451681 14407329", "2023 07 988-555-2485 9", f"{card} 12345 97.51.17.173", "9807915762804490 123", "1 2 " * 20000 + card]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.replace_entities(df, count_into="n").orderBy("doc_id").collect()
    got, n = [r.text for r in rows], [r.n for r in rows]
    new = re.fullmatch(r"card (\d{16}) 123", got[0])[1]
    spaced = " ".join(new[i:i + 4] for i in range(0, 16, 4))
    assert luhn(new) and new != card and got[1] == f"{spaced} 12/27" and got[2] == f"ref 7 {new}" and got[3] == f"ref 4 {spaced} x"
    assert got[4] == f"{new} {new}" and got[6] == f"{new[:8]} {new[8:]}" and got[9] == texts[9] and got[10] == "1 2 " * 20000 + new
    assert re.fullmatch(rf"12345 9\d\d-\d\d-\d{{4}} {new} 12abc", got[5]) and "123-45-6789" not in got[5]
    assert re.fullmatch(r"2023 07 \d{3}-555-\d{4} 9", got[7]) and "2485" not in got[7]
    assert got[8].startswith(f"{new} 12345 ") and "97.51" not in got[8]
    assert n == [1, 1, 1, 1, 2, 2, 1, 1, 2, 0, 1]


def test_entities_are_taken_whole(spark):
    long, jwt = "aB3" * 234, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"
    texts = [f"token={long} end", f"token: {jwt}. Next", "+14155552671", "+4915112345678,", "415 555 2671", "+1 (743) 555-3824 2023", "743-555-3824",
             "+49 151 12345678 2023", "secret=" + "q7" * 20000, "+33 1 23 45 67 89 2023", "+1 415 555 2671 4845168114407329"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.replace_entities(df).orderBy("doc_id").collect()]
    assert all(len(a) == len(b) and a != b for a, b in zip(texts, got))
    assert long[512:] not in got[0] and got[0].endswith(" end") and got[1].endswith(". Next")
    assert not any(part in got[1] for part in jwt.split("."))
    digits = [re.sub(r"\D", "", x) for x in got]
    assert digits[2] == "1" + digits[4] and digits[4] != "4155552671" and "12345678" not in got[3]
    assert got[5].endswith(" 2023") and digits[5] == "1" + digits[6] + "2023" and got[7].endswith(" 2023") and got[9].endswith(" 2023")
    assert "q7" * 20 not in got[8] and digits[10][:11] == digits[2] and luhn(digits[10][11:]) and "4845168114407329" not in got[10]


def test_collisions_are_drawn_again(spark, monkeypatch):
    units = spark.createDataFrame([(f"ssn:{i}00-00-0000",) for i in range(10, 30)] + [("ssn:95",)], "unit string")
    monkeypatch.setattr(pii, "surrogate", lambda unit, key, attempt: (F.lit(90) + F.conv(F.substring(F.md5(F.concat_ws("|", unit, attempt.cast("string"))), 1, 6), 16, 10).cast("long") % 25).cast("string"))
    got = [r.surrogate for r in pii.assign(units, "k").collect()]
    assert len(got) == 21 == len(set(got)) and "95" not in got


def test_rounds_settle_as_drawn_one_by_one(spark, monkeypatch):
    import hashlib
    names = [f"ssn:{i}00-00-0000" for i in range(10, 30)] + ["ssn:95"]
    monkeypatch.setattr(pii, "surrogate", lambda unit, key, attempt: (F.lit(90) + F.conv(F.substring(F.md5(F.concat_ws("|", unit, attempt.cast("string"))), 1, 6), 16, 10).cast("long") % 25).cast("string"))
    want, attempt = {}, 0
    while todo := sorted(set(names) - set(want)):
        fixed = set(want.values()) | {n.split(":")[1] for n in names}
        for unit in todo:
            drawn = str(90 + int(hashlib.md5(f"{unit}|{attempt}".encode()).hexdigest()[:6], 16) % 25)
            if drawn not in fixed and drawn not in [d for u, d in want.items() if u in todo]:
                want[unit] = drawn
        attempt += 1
    got = {r.unit: r.surrogate for r in pii.assign(spark.createDataFrame([(n,) for n in names], "unit string"), "k").collect()}
    assert attempt > 2 and got == want


def test_files_follow_the_rows_not_the_partitions(spark, monkeypatch):
    written = []

    def counted(df, name, write=pii.materialize):
        out = write(df, name)
        written.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(pii, "materialize", counted)
    texts = [(i, f"mail user{i}@host{i % 7}.example.com or call (988) 555-{1000 + i}") for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    keys = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = pii.replace_entities(df, count_into="n").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.text for r in rows}) == 600 and all(r.n == 2 for r in rows)
    assert written[0][1] <= 3 and all(n == 1 for name, n in written[1:]) and len(written) < 6


def test_query_leaves_nothing_and_changes_only_entities(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    loose = re.compile(r"[\w.+-]+@[\w.-]+\.\w+|\+1 \(\d{3}\) 555-\d{4}|\b4\d{15}\b|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-f]{40}\b")
    originals = {m for t in text.values() for m in loose.findall(t)}
    seen = {}
    for r in Q.op8_pii_surrogates(spark, SF).collect():
        old, new = loose.findall(text[r.doc_id]), loose.findall(r.text)
        assert loose.sub("#", text[r.doc_id]) == loose.sub("#", r.text) and len(old) == len(new)
        for a, b in zip(old, new):
            if a[0] == "4" and a.isdigit() and not luhn(a):
                assert a == b
                continue
            assert b not in originals and seen.setdefault(a, b) == b and seen.setdefault((b,), a) == a
            assert luhn(b) if a.isdigit() else True


def test_no_python_in_native_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (pii.replace_entities(docs), mixing.mix_table(docs), mixing.mixed_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_mix_matches_sql(spark):
    con = duckdb.connect()
    want = con.execute(mixing.ORACLE.format(docs=f"'{SF}/documents.parquet'")).fetchall()
    assert sorted(want) == sorted(map(tuple, Q.op9_mix_sources(spark, SF).collect()))


ODD = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (None, "q", None), (3, "", "empty"), (4, "w " * 30000, "long"), (5, "one", "y"), (None, "r s", None)]


def test_mix_edges(spark):
    df = spark.createDataFrame([(*r, 7, "k") for r in ODD], "doc_id long, text string, source string, size int, mix_key string")
    rows = mixing.mix_table(df).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?)", ODD)
    assert sorted(con.execute(mixing.ORACLE.format(docs="d")).fetchall(), key=repr) == sorted(map(tuple, rows), key=repr)
    assert all(r.taken <= 3 * r.size for r in rows) and len(rows) == len(ODD)
    mixed = mixing.mixed_documents(df, into="position")
    assert mixed.columns == [*df.columns, "position"]
    got = mixed.collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and all(0 <= r.position <= 1 for r in got)
    assert sum(len((r.text or "").split()) for r in got) == sum(r.taken for r in rows)
    assert mixing.mix_table(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_curriculum_follows_its_schedule(spark):
    rows = [(i, "w w w w", "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(df, weights=(1, 1, 1), slopes=(0.8, 0.0, -0.8), into="t").toPandas()
    early = got[got.t < 0.25].source.value_counts()
    assert early["a"] == pytest.approx(1000 * (0.8 * 0.0625 + 0.2 * 0.25), abs=5) and early["b"] == pytest.approx(250, abs=5)
    assert early["c"] == pytest.approx(1000 * (-0.8 * 0.0625 + 1.8 * 0.25), abs=5)


def test_targets_are_met_within_a_document(spark):
    words = lambda n: "w " * n
    null_ids = [(None, words(8), "hot") for _ in range(1000)]
    own_ids = [(i, words(8), "hot") for i in range(1000)]
    repeated = [(i % 3, words(8), "hot") for i in range(1000)]
    for rows in (null_ids, own_ids, repeated):
        df = spark.createDataFrame(rows + [(10_000 + i, words(8), "more") for i in range(2000)], "doc_id long, text string, source string").repartition(7)
        table = mixing.mix_table(df).collect()
        for source_size in {r.source_size for r in table}:
            mine = [r for r in table if r.source_size == source_size]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8
        mixed = mixing.mixed_documents(df)
        assert mixed.count() == sum(r.copies for r in table)
        con = duckdb.connect()
        con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        con.executemany("INSERT INTO d VALUES (?, ?, ?)", [tuple(r) for r in df.collect()])
        want = con.execute(f"SELECT doc_id, copies, count(*) FROM ({mixing.ORACLE.format(docs='d')}) GROUP BY ALL").fetchall()
        assert sorted(want, key=repr) == sorted(((d, c, n) for (d, c), n in __import__('collections').Counter((r.doc_id, r.copies) for r in table).items()), key=repr)
