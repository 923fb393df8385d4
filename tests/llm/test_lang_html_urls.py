import html
import re
import zlib

import numpy as np

from tabscope.llm import htmltext as H
from tabscope.llm import langid as L
from tabscope.llm import queries as Q
from tabscope.llm import urls as U

SF = "/root/testdata/sf0.001"


def test_codewords_are_distinct_and_apart():
    for k in (2, 3, 4, 6, 9, 20):
        code = L.codewords(k)
        assert code.shape[0] == k and (np.abs(code.sum(axis=0)) < k).all()
        apart = [int((code[i] != code[j]).sum()) for i in range(k) for j in range(i)]
        assert min(apart) >= (2 ** (k - 2) if k <= 6 else 0.25 * code.shape[1])


def test_language_query_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = Q.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_edges(spark):
    learn = [i for i in range(20, 60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(learn[0], "the cat sat on the mat", "en"), (learn[1], "der Hund und die Katze", "de"), (3, None, "en"), (4, "12 + 3!", "de"), (5, "", None),
            (6, "the dog", None), (None, "die Katze", "de"), (6, "the dog", None), (8, "word " * 50000, "en"), (9, "²½", "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = L.languages(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (3, 4, 5, 9)] == ["und"] * 4 and by[3].score == 0
    assert by[6].lang_pred == "en" and by[None].lang_pred == "de" and by[None].held_out is False
    assert L.languages(df.limit(0)).count() == 0
    none = L.languages(df.withColumn("lang", df.lang.substr(9, 1)).where("lang <> ''")).collect()
    assert none == []
    one = L.languages(df.where("lang = 'en' OR doc_id = 6")).collect()
    assert {r.lang_pred for r in one if r.doc_id == 6} == {"en"}


def gold(page):
    inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.S)[1]).replace("<br>", " ")
    blocks = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1|div)[^>]*>", inner)]
    return "\n\n".join(x for x in blocks if x)


def test_html_query_returns_the_articles(spark):
    page = {r.page_id: (r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = Q.op7_html_extraction(spark, SF).collect()
    assert len(rows) == len(page)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (page[r.page_id][0], gold(page[r.page_id][1]), len(r.text))


OTHER = ('<html><body><div class="top"><a href=/>Home</a> | <a>News</a></div><div id="content"><h1>Big title here</h1><p>First paragraph of the story, with '
         'some words\n in it and a stop. Another sentence follows here, as one expects.</p><div class="ad">Buy now cheap</div><ul><li>one point of it<li>two</ul>'
         '<p>Second &amp; last paragraph of it all, long enough to be one.</p></div><div class="sidebar"><ul><li><a>Link one</a><li><a>Link two</a></ul></div>'
         '<section class="comments"><div class="comment"><p>I like this, said a reader in a long comment.</p></div></section><form><p>Sign up</p></form>'
         '<script>var a = "<p>no</p>";</script><footer>Copyright</footer></body></html>')


def test_html_other_layouts_and_edges(spark):
    rows = [(r.page_id, r.url, r.html, "t") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(1000, "u", OTHER, "t"), (1001, None, None, "t"), (None, "u", "", "t"), (1002, "u", "<div>" * 3000 + "deep" + "<b>" * 3000, "t"), (1003, "u", "<" * 3000, "t"),
             (1004, "u", "<!-- open", "t"), (1005, "u", "<script>x", "t"), (1000, "u", OTHER, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    text = by[1000].text
    assert text.startswith("Big title here\n\nFirst paragraph of the story, with some words in it and a stop. Another")
    assert "Second & last paragraph of it all" in text and "Buy now" not in text and "reader" not in text and "Copyright" not in text and "Link" not in text
    assert by[1001].text == "" == by[None].text == by[1004].text == by[1005].text
    assert H.main_text(df.limit(0)).count() == 0


def test_html_without_the_end_of_head(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert all("</head>" in h for _, _, h in pages)
    cut = spark.createDataFrame([(i, u, h) for i, u, h in pages] + [(10_000 + i, u, h.replace("</head>", "")) for i, u, h in pages], "page_id long, url string, html string")
    by = {r.page_id: r.text for r in H.main_text(cut).collect()}
    assert all(by[10_000 + i] == by[i] != "" for i, _, _ in pages)
    for inner in ("<body><p>Body text", "<p>Body text", "Body text"):
        units = H.units_of(H.parse(f"<html><head><title>x</title>\n<meta charset=u><style>s</style>{inner}"))
        assert [u.text for u in units if u.text] == ["Body text"]


def test_like_siblings_of_a_long_article():
    at = H.FEATURES.index("like_siblings")
    units = H.units_of(H.parse("<div>" + "<p>a</p>" * 900 + "<h2>b</h2>" * 100 + "</div>"))
    like = {u.tag: row[at] for u, row in zip(units, H.features(units))}
    assert like["p"] == 0.9 and like["h2"] == 0.1


def test_decoding_keeps_no_node_without_its_parent():
    units = H.units_of(H.parse("<div><p>a</p><div><p>b</p></div></div>"))
    odds = np.array([0.1, 1.0, 1.0, -3.0, 2.0])
    assert H.decode(units, odds) == [True, True, True, False, False]
    assert H.decode(units, np.array([0.1, 1.0, 1.0, -1.0, 2.0])) == [True] * 5


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(host):])[0]
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


def test_url_query(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        url = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
        rows = Q.op5_url_filters(spark, sf).collect()
        assert len(rows) == len(url)
        for r in rows:
            host, path, rule = brute_url(url[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]) and r.verdict == (rule[1] if rule else r.verdict)
            assert r.verdict in ("allow", "block") and (rule or (r.verdict == "block") == (r.purity is not None and r.purity >= U.PURITY))


def test_templates(spark):
    rules = [("block", "h.a", "/bad/x"), ("allow", "h.a", "/good/x"), ("block", "h.a", "/worse/x")]
    rows = [f"http://h.a/{d}/x{i}" for d in ("bad", "good", "worse") for i in range(12)] + [f"http://h.a/{d}/y{i}" for d in ("bad", "good", "worse", "new") for i in range(4)]
    rows += [f"http://h.a/u/{chr(97 + i % 26)}{chr(97 + i // 26)}/z" for i in range(60)]
    rows += [None, "none", "http://h.a", "x://H.A/bad/q/" + "s/" * 2000, "://", "http://h.a?q=/bad/x"]
    df = spark.createDataFrame([(i if i else None, u, 1, "s") for i, u in enumerate(rows)], "page_id long, url string, n int, s1 string")
    got = U.filter_urls(df, rules).collect()
    assert len(got) == len(rows)
    verdict = {(r.host, r.path): r for r in got}
    assert verdict["h.a", "/bad/y1"].verdict == "block" and verdict["h.a", "/bad/y1"].template == "/bad|worse/*"
    assert verdict["h.a", "/good/y1"].verdict == "allow" and verdict["h.a", "/new/y1"].verdict == "allow"
    assert verdict["h.a", "/u/aa/z"].template == "/u/*/z"
    assert verdict["h.a", ""].verdict == "allow" and verdict["", ""].verdict == "allow"
    assert U.filter_urls(df.limit(0)).count() == 0


def test_url_branches_at_any_number_of_children(spark):
    from tabscope.llm import urls as U
    for k in (20, 21, 60):
        pages = [(f"http://example.com/de/x{i}", i) for i in range(40)] + [(f"http://example.com/s{chr(97 + j % 26)}{chr(97 + j // 26)}/p{i}", 1000 + 10 * j + i)
                                                                          for j in range(k - 1) for i in range(10)]
        df = spark.createDataFrame([(n, u) for u, n in pages], "page_id long, url string")
        got = {r.page_id: r.verdict for r in U.filter_urls(df).collect()}
        assert {v for i, v in got.items() if i < 1000} == {"block"} and {v for i, v in got.items() if i >= 1000} == {"allow"}
