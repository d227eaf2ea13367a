"""Urls, main text and vectors against plain versions, odd inputs, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import ann, html, topk, urls

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_rules_and_parts(spark):
    rows = [
        (1, "https://A.Example.ORG/es/x?q#f", ""), (2, "http://example.org/en/12", ""), (3, "http://notexample.org/es/", ""), (4, "HTTP://x.com/fr/1", ""), (5, "http://com/de/", ""),
        (6, "http://b.net/es/", ""), (7, None, None), (8, "no scheme/x", ""), (9, "x://h://i/j", ""), (10, "http://example.org?es/", ""), (10, "http://example.org?es/", ""),
    ]
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages(spark, rows).withColumn("HOST", F.lit(1))).collect()}
    assert found == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("notexample.org", "/es/", "org/", "allow"),
        4: ("x.com", "/fr/1", "com/fr/", "allow"), 5: ("com", "/de/", "com/de/", "block"), 6: ("b.net", "/es/", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("h:", "//i/j", None, "allow"), 10: ("example.org", "", None, "allow"),
    }
    assert urls.judge(pages(spark, [])).count() == 0


def test_aliases_inherit_blocks(spark):
    link = lambda to: f'<head><link href="{to}" rel="canonical"></head>'
    rows = [
        (1, "http://a.net/1", link("http://b.net/2")), (2, "https://b.net/2#x", '<meta http-equiv="Refresh" content="0; url=http://bad.com/de/3">'), (3, "http://c.net/4", link("/5")),
        (4, "http://c.net/5", None), (5, "http://d.org/6", link("http://a.net/1")), (6, "http://e.net/q?x=1", link("//a.net/1")), (7, "http://e.net/q?x=2", ""),
    ]
    found = {r["page_id"]: (r["verdict"], r["inherited"]) for r in urls.judge(pages(spark, rows)).collect()}
    assert found == {1: ("block", True), 2: ("block", True), 3: ("allow", False), 4: ("allow", False), 5: ("allow", False), 6: ("block", True), 7: ("allow", False)}
    log = spark.createDataFrame([("http://c.net/5", "http://a.net/1")], "a string, b string")
    assert {r["page_id"] for r in urls.judge(pages(spark, rows), more_edges=log).where("inherited").collect()} == {1, 2, 3, 4, 6}


def test_every_alias_tag_counts(spark):
    bad = "http://bad.com/de/1"
    heads = {
        1: f'<link rel="alternate canonical" href="{bad}">', 2: f'<link rel=canonical href=/none><link href={bad} rel=canonical>',
        3: f'<meta http-equiv=refresh content="9"><meta content="0; URL=\'{bad}\'" http-equiv="refresh">', 4: '<base href="http://bad.com/de/"><link rel="canonical" href="1">',
        5: f'<!-- <link rel="canonical" href="{bad}"> -->', 6: f'<script>"<link rel=canonical href={bad}>"</script>', 7: f'<link rel="notcanonical" href="{bad}">',
        8: '<link rel="canonical" href="http://bad.com/de/1?a=1&amp;b=2">', 9: f'<link data-rel="canonical" href="{bad}">', 10: f'<link title="a > b" rel="canonical" href="{bad}">',
    }
    rows = [(k, f"http://a.net/{k}", h) for k, h in heads.items()]
    assert {r["page_id"] for r in urls.judge(pages(spark, rows)).where("inherited").collect()} == {1, 2, 3, 4, 8, 10}


def test_article_text_that_recurs_on_a_host_stays(spark):
    for n in (4, 8):
        rows = [(k, f"http://h.net/{k}", f"<div>Site name</div><article><p>Own {k} text.</p><p>House style line.</p></article><div>Contact us</div>") for k in range(n)]
        found = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
        assert found == {k: f"Own {k} text.\n\nHouse style line." for k in range(n)}


def test_empty_elements_part_no_word():
    assert text_of("<article><p>super<wbr>cali<img src=x>fragile<br>two</p></article>") == "supercalifragile two"


def test_nearest_of_wide_vectors_without_structure(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(size=(3000, 96))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "vec_id long, v array<double>")
    found = ann.nearest(table, F.col("vec_id") % 300 == 0, "vec_id", "v", 10).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    hit = 0
    for r in found:
        order = np.argsort(((values - values[r["query_id"]]) ** 2).sum(1), kind="stable")
        hit += len(set(order[1:11].tolist()) & set(r["v"]))
    assert len(found) == 10 and hit >= 95


def text_of(page):
    return "\n\n".join(x.text for x in html.leaves(html.parse(page)))


def test_main_text_of_marked_pages():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div class='cookie-notice'>ok</div>"
        "<article><header><h1>Head &amp; tail</h1></header><p>One<br>two &nbsp; <b>bold</b>text<p>Next &lt;tag&gt; <script>var t='</p>';</script>end"
        "<ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table><aside>side</aside><div class='ad'>buy</div><form>f</form>"
        "<section id='comments'><article>nice</article></section></article><footer>&copy;</footer></body></html>"
    )
    assert text_of(page) == "Head & tail\n\nOne two boldtext\n\nNext <tag> end\n\na\n\nb\n\n1 2"
    assert text_of("<body><div class=sidebar>x</div><div><p>only body") == "only body"
    assert text_of("a < b and <b>c</b> &am &#65;") == "a < b and c &am A" and text_of("") == "" and text_of("<!-- never closed <p>x") == ""
    assert text_of("<div>" * 500 + "deep" + "</div>" * 500) == "deep"


def test_tree_matching():
    a, b = html.parse("<div><p>x</p><p>y</p></div><p>z</p>"), html.parse("<div><p>x</p><ul><li>q</li></ul><p>y2</p></div><p>z</p>")
    size, pairs = html.align(a, b)
    assert [(x.text, y.text) for x, y in pairs if x.text == y.text] in ([("x", "x"), ("z", "z")], [("z", "z"), ("x", "x")]) and size >= 8


def test_constant_nodes_are_template(spark):
    rows = [(i, f"http://h.net/{i}", f"<body><div>Read our daily letter</div><p>Story {i} about {i * 7}</p><div>Filed under news</div></body>") for i in range(8)]
    rows += [(100 + i, "http://few.net/", "<p>the same page</p>") for i in range(9)] + [(200, None, None), (201, "http://h.net/x", "")]
    found = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows).withColumn("TEXT", F.lit(1))).collect()}
    assert all(found[i] == f"Story {i} about {i * 7}" for i in range(8))
    assert all(found[100 + i] == "the same page" for i in range(9)) and found[200] == found[201] == "" and len(found) == len(rows)
    assert html.extract(pages(spark, [])).count() == 0


def vectors(spark, n=700, width=12):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=width)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)] + [(9_000, None), (9_001, [1.0, None]), (9_002, [float("nan")] * width), (9_003, [0.0] * width), (9_004, [1.0])]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "vec_id long, v array<float>").withColumn("score", F.lit("clash")), rows


@pytest.mark.parametrize("search", [topk.top_products, ann.nearest])
def test_vectors_of_clashing_columns_and_none(spark, search):
    rows = [(k, [float(k % 7 + 1), float(k % 5)]) for k in range(60)] + [(None, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>")
    odd = table
    for name in ("_q", "_v", "id", "vector", "block", "query_id", "rank", "score"):
        odd = odd.withColumn(name, F.lit("clash"))
    plain, clash = (sorted(map(tuple, search(t, F.col("vec_id") % 20 == 0, "vec_id", "v", 3).collect())) for t in (table, odd))
    assert plain == clash and len(plain) == 9
    for none in (table.limit(0), table.where("vec_id % 20 != 0"), table.withColumn("v", F.lit(None).cast("array<double>"))):
        assert search(none, F.col("vec_id") % 20 == 0, "vec_id", "v", 3).count() == 0


def test_exact_top_k(spark):
    table, rows = vectors(spark)
    scaled = table.withColumn("w", F.transform("v", lambda x: 256 * x.cast("double")))
    found = {}
    for r in topk.top_products(scaled, F.col("vec_id") % 50 == 0, "vec_id", "w", 5).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    real = {i: np.floor(256 * np.pad(np.float32(v).astype(float), (0, 12 - len(v)))).astype(int) for i, v in rows if v and None not in v and not np.isnan(v).any()}
    assert set(found) == {i for i in real if i % 50 == 0}
    for q in found:
        best = sorted((-int(real[q] @ v), i) for i, v in real.items() if i != q)[:5]
        assert [found[q][k] for k in range(1, 6)] == [(i, -s) for s, i in best]
    assert topk.top_products(scaled.limit(0), F.col("vec_id") % 50 == 0, "vec_id", "w", 5).count() == 0
    assert topk.top_products(scaled.where("vec_id in (0, 1)"), F.col("vec_id") == 0, "vec_id", "w", 5).count() == 1


def test_bounded_reading_keeps_every_winner():
    rng = np.random.default_rng(9)
    for _ in range(20):
        values = rng.integers(-40, 40, (300, 5))
        lists = np.argsort(values, 0)
        place = np.argsort(lists, 0).astype(np.int16)
        query = rng.integers(-3, 4, 5).astype(float)
        score = values @ query
        for floor in (-np.inf, np.sort(score)[-20]):
            rows = topk.no_random_access(query, values.astype(float), place, np.sort(values, 0).astype(float), 6, floor)
            assert set(np.flatnonzero(score >= np.sort(score)[-6])) <= set(rows)


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64])
def test_bounded_reading_of_many_queries_at_once(kind):
    rng = np.random.default_rng(11)
    for high in (2, 40):  # with many ties, and with few
        values, queries = rng.integers(-high, high, (700, 6)), rng.integers(-high, high, (50, 6))
        queries[0] = 0
        place = np.argsort(np.argsort(values, 0, kind="stable"), 0).astype(np.int16)
        scores = queries @ values.T
        kth = np.sort(scores, 1)[:, -6]
        for floors in (np.full(50, np.iinfo(np.int64).min), np.sort(scores, 1)[:, -20]):
            keep = topk.no_random_access(queries.astype(kind), values.astype(kind), place, np.sort(values, 0).astype(kind), 6, floors)
            assert keep.shape == scores.shape and keep[scores >= kth[:, None]].all()
    assert keep.mean() < 0.2  # most rows fall


def test_nearest(spark):
    table, rows = vectors(spark)
    found = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0, "vec_id", "v", 10).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    real = {i: np.pad(np.float32(v).astype(float), (0, 12 - len(v))) for i, v in rows if v and None not in v and not np.isnan(v).any() and any(v)}
    hits = 0
    for q, got in found.items():
        best = sorted((float(np.sqrt(((real[q] - v) ** 2).sum())), i) for i, v in real.items() if i != q)[:10]
        hits += len({i for _, i in best} & {i for _, i, _ in got})
        assert [r for r, _, _ in sorted(got)] == list(range(1, 11)) and all(abs(s - np.sqrt(((real[q] - real[i]) ** 2).sum())) < 1e-9 for _, i, s in got)
    assert set(found) == {i for i in real if i % 100 == 0} and hits >= 0.95 * 10 * len(found)
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0, "vec_id", "v", 10).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == names and 0 < docs.count() <= before, name
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_a_stub_page_does_not_hide_the_template(spark):
    page = "<body><div>Read our daily letter</div><p>Story {0} about {0}7</p><div>Filed under news</div></body>"
    rows = [(i, f"http://h.net/{i}", page.format(i)) for i in range(60)] + [(100, "http://h.net/a", "<html></html>"), (101, "http://h.net/b", "x"), (102, "http://h.net/c", "<p>404")]
    rows += [(200 + i, f"http://two.net/{i}", page.format(i)) for i in range(2)] + [(300 + i, f"http://lack.net/{i}", page.format(i).replace("<div>Filed under news</div>", "" if i == 3 else "<div>Filed under news</div>")) for i in range(9)]
    found = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
    assert all(found[i + at] == f"Story {i} about {i}7" for at, n in ((0, 60), (200, 2), (300, 9)) for i in range(n))
    assert (found[100], found[101], found[102]) == ("", "x", "404")


def test_a_single_word_does_not_leave_out_the_article(spark):
    body = "<p>The body of a long story that goes on for some time"
    assert text_of(f"<div class='page has-sidebar'><article>{body}</article></div>") == text_of(f"<div class='content no-sidebar'>{body}</div>") == body[3:]
    assert text_of(f"<article>{body}<h2 id='related-work'>Related work</h2><section id='social-history'>Guilds</section></article>") == f"{body[3:]}\n\nRelated work\n\nGuilds"
    assert text_of(f"<div id='main-title'>Title</div><div>{body}</div>") == f"Title\n\n{body[3:]}"
    assert text_of(f"<article>Teaser</article><div>{body}</div>") == f"Teaser\n\n{body[3:]}"
    assert text_of(f"<form><div class='widget'><main>{body}</main></div></form>") == body[3:]
    assert text_of(f"<div class='sidebar-left'><article>Teaser</article></div><div class='related-posts'>More</div><div>{body}</div>") == body[3:]
    assert text_of(f"<div id='comments'>{'nice ' * 50}</div><main>{body}</main><div class='sidebar'><article>Teaser</article></div>") == body[3:]
    menu = "<div>" + "A long menu that every page of the host has. " * 9 + "</div>"
    rows = [(i, f"http://h.net/{i}", f"<body>{menu}<article><p>Story {i}</p></article><div>by {i}</div></body>") for i in range(6)]
    assert {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()} == {i: f"Story {i}" for i in range(6)}


def test_links_as_a_browser_reads_them(spark):
    from concordat.llm import urls

    heads = [
        ('<link rel=canonical href="../en/1">', "http://a.com/en/1"),
        ("<link rel='canonical' href=./y>", "http://a.com/x/y"),
        ('<link rel="canonical" href="http://b.com/p&#x2F;q&#38;r&amp;s">', "http://b.com/p/q&r&s"),
        ('<meta http-equiv="refresh" content="0; http://b.com/z">', "http://b.com/z"),
        ('<meta http-equiv="refresh" content="0;url=\'/w\'">', "http://a.com/w"),
        ('<link title="a href=http://no.com/" rel=canonical href=//c.com/k>', "http://c.com/k"),
        ('<link rel=canonical href="mailto:me@b.com">', None),
        ('<textarea><link rel=canonical href="http://no.com/"></textarea>', None),
        ('<link rel="canonical" href="http://d.com/a/b/../../../c/./">', "http://d.com/c/"),
        ("<link rel=canonical href=http://e.com/long " + "x " * 500_000 + ">", "http://e.com/long"),
        ("<meta " + "'x' " * 250_000 + 'http-equiv=refresh content="1;http://e.com/m">', "http://e.com/m"),
        ("<base " + "y" * 1_000_000 + ' href="http://f.com/k/"><link rel=canonical href=v>', "http://f.com/k/v"),
    ]
    rows = [(k, f"http://a.com/x/p{k}", head) for k, (head, _) in enumerate(heads)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
    found = {r["a"]: r["b"] for r in urls.alias_edges(pages).collect()}
    assert found == {f"a.com/x/p{k}": target.split("://")[1] for k, (_, target) in enumerate(heads) if target}
    clash = pages.selectExpr("page_id", "url", "html", "1 as _at", "2 as _node", "3 as _bad", "4 as _rule", "5 as at", "6 as own")
    assert set(clash.columns) < set(urls.judge(clash).columns) and urls.judge(clash).where("_rule = 4 and own = 6").count() == len(heads)


def test_depth_drops_no_article(spark):
    from concordat.llm import html

    def page(depth, nested):
        inner = "".join(f"<form><div class={nested}>" for _ in range(20)) if nested else "<form>"
        story = "<article><h1>Title</h1><p>" + "All of the story, word for word. " * 20 + "</p><form>Subscribe</form></article>"
        return "<html><body>" + "<div id=x>" * depth + inner + story + "</div>" * depth + "</body></html>"

    rows = [(k, f"http://h{k}.com/", page(*kind)) for k, kind in enumerate((d, n) for d in (5, 57, 58, 59, 60, 61, 62, 63, 200, 3000) for n in ("", "sidebar"))]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    wanted = "Title\n\n" + ("All of the story, word for word. " * 20).strip()
    plain = {k: t for k, t in found.items() if k % 2 == 0}
    assert set(plain.values()) == {wanted}, {k: t[:40] for k, t in plain.items()}
    assert len(found) == len(rows)


def best_match(a, b):
    """Simple tree matching by its definition: for lists of children every pair of first ones is left out or matched."""
    if a.label != b.label:
        return 0
    if a.label == "#":
        return 1 + (a.text == b.text)
    table = {}
    for i in range(len(a.children) - 1, -1, -1):
        for j in range(len(b.children) - 1, -1, -1):
            both = best_match(a.children[i], b.children[j]) + table.get((i + 1, j + 1), 0)
            table[i, j] = max(table.get((i + 1, j), 0), table.get((i, j + 1), 0), both)
    return 1 + table.get((0, 0), 0)


def test_matching_of_random_trees():
    rng = random.Random(9)

    def tree(depth, width, texts):
        node = html.Node(rng.choice("ab") if depth < 3 else "a")
        for _ in range(rng.randrange(width)):
            leaf = depth == 0 or rng.random() < 0.4
            node.children.append(html.Node("#", rng.choice(texts)) if leaf else tree(depth - 1, 5, texts))
        return node

    for turn in range(400):
        a, b = (tree(3, *((7, "uvwxyz") if turn % 4 else (40, "xxxxxxxyz"))) for _ in "ab")  # wide trees share texts that are frequent
        size, pairs = html.align(a, b)
        assert size == best_match(a, b)
        places = [{id(x): k for k, x in enumerate(html.leaves(t))} for t in (a, b)]
        met = sorted((places[0][id(x)], places[1][id(y)]) for x, y in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(met, met[1:], strict=False))  # in order, no leaf twice


def test_pages_of_ten_thousand_blocks(spark):
    """Three pages of one host that share a text in every second block: each keeps what is its own."""
    block = lambda k, i: f"<div><p>page {k} says {i}</p><p>Reply</p></div>"
    rows = [(k, "http://h.com/a", "<body><div>Site name</div>" + "".join(block(k, i) for i in range(10_000)) + "</body>") for k in range(3)]
    found = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
    for k in range(3):
        assert [t for t in found[k].split("\n\n") if t != "Reply"] == [f"page {k} says {i}" for i in range(10_000)]
