import io
import json

import pytest
from pyspark.sql import functions as F

from pagewright import cli
from pagewright.operators import dates as DT
from pagewright.operators import measures as M
from pagewright.operators import nodes as N
from pagewright.operators import simplify as S
from pagewright.operators.dom import body_of, parse
from pagewright.operators.extract import Page, extract_articles, extract_page, json_ld, prepare
from pagewright.options import ExtractOptions

TEXT = "This is a paragraph of real content, long enough to count, with commas, clauses and an end. " * 3
PAGE = f"""<!DOCTYPE html><html lang="en"><head><title>A fine story about rivers | The Site</title><meta name="author" content="Jane Doe"></head><body>
<nav><ul><li><a href="/1">Home</a><li><a href="/2">News</a></ul></nav><div class="sidebar"><a href="/x">promo promo promo</a></div>
<article><h1>A fine story about rivers</h1><p>{TEXT}<p>{TEXT}<div class="share"><a href="#">Share</a></div><p>Short line. End.</p>
<ul><li>one thing<li>another thing<li>third</ul><script>var t = '</p>';</script></article><footer>&copy; The Site</footer></body></html>"""


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>x", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>x"),
        ("<table>a<tr>b<td>1</table>", "ab<table><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<p>a<b>b<p>c</b>d", "<p>a<b>b</b></p><p><b>c</b>d</p>"),
        ("a</div>b", "ab"),
        ("<script>'</p>'</script>x &amp; y", "<script>'</p>'</script>x &amp; y"),
        ("", ""),
    ],
)
def test_tree(source, expected):
    root = parse(source)
    got = body_of(root).inner_html()
    head = "".join(c.outer_html() for c in root.elements()[0].elements())
    assert head + got == expected


def test_extraction():
    a = extract_page(PAGE)
    assert a["title"] == "A fine story about rivers" and a["byline"] == "Jane Doe" and a["lang"] == "en" and a["error"] is None
    texts = [b["text"] for b in a["plain_text"]]
    assert sum(t.startswith("This is a paragraph") for t in texts) == 2
    assert not any(w in " ".join(texts) for w in ("Home", "promo", "Share", "©", "var t"))
    assert a["content"].startswith('<div id="readability-page-1" class="page">') and "sidebar" not in a["content"]
    assert extract_page(PAGE) == a


def test_digests_and_indexes():
    a = extract_page(PAGE, ExtractOptions(content_digests=True, node_indexes=True))
    assert "data-content-digest" in a["plain_content"] and 'data-node-index="0"' in a["plain_content"]
    assert all(len(b["content_digest"]) == 64 and b["node_index"].startswith("0.") for b in a["plain_text"])


def test_odd_pages():
    assert extract_page(None)["error"].startswith("[validation")
    assert extract_page("")["title"] is None
    e = extract_page("<html><head><title>404 Not Found</title></head><body><h1>404 Not Found</h1><p>Gone.</p></body></html>")
    assert e["content_type"] == 4 and "Return to homepage" in e["content"]
    assert extract_page("<body>just text without a title</body>")["error"] is None
    assert extract_page(PAGE, ExtractOptions(max_elements=3))["error"] == "[validation:extract] document too large"
    assert extract_page(PAGE * 30, ExtractOptions(timeout=1e-9))["error"].startswith("[timeout")
    assert extract_page(PAGE, ExtractOptions(content_type=3))["content_type"] == 3
    assert extract_page("<div>" * 5000 + "x")["error"] is None or "nested" in extract_page("<div>" * 5000 + "x")["error"]


def test_important_links_are_kept_on_request():
    page = PAGE.replace("<footer>", '<footer><a href="/more">More information</a>')
    assert "/more" not in extract_page(page)["content"]
    assert "/more" in extract_page(page, ExtractOptions(preserve_important_links=True))["content"]


def test_linked_data():
    ld = '{"@context": "https://schema.org", "@type": "NewsArticle", "headline": "Head", "author": {"name": "A B"}, "datePublished": "2023-01-02T03:04:05Z"}'
    page = PAGE.replace("</head>", f'<script type="application/ld+json">{ld}</script></head>')
    assert json_ld(parse(page)) == {"title": "Head", "byline": "A B", "date": "2023-01-02T03:04:05Z"}
    a = extract_page(page)
    assert a["byline"] == "A B" and a["date"].isoformat() == "2023-01-02T03:04:05+00:00"


@pytest.mark.parametrize(
    "html, kind",
    [
        ('<table role="presentation"><tr><td>x</td></tr></table>', "layout"),
        ("<table><thead><tr><th>a</th></tr></thead><tr><td>1</td></tr></table>", "data"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", "data"),
        ('<table class="menu"><tr><td><a href="/">x</a></td></tr></table>', "nav"),
        ("<table><tr><td>x</td></tr></table>", "layout"),
    ],
)
def test_table_kinds_agree(spark, html, kind):
    table = body_of(parse(html)).find("table")
    assert M.table_class(table) == kind
    nodes = N.dom_nodes(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    assert [r["kind"] for r in N.tables(nodes).collect()] == [kind]


def test_relational_scores_equal_those_of_the_tree(spark):
    html = PAGE.replace("<nav>", "<div>").replace("</nav>", "</div>")
    root = parse(html)
    prepare(root)
    body = body_of(root)
    order = {id(n): i for i, n in enumerate([body, *body.walk()])}
    page = Page(root, {"title": ""}, ExtractOptions(), None)
    scored = [n for n in body.walk() if n.tag in ("section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre")]
    want = {order[k]: round(s, 6) for k, (_, s) in page.scores(scored, body).items()}
    nodes = N.dom_nodes(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    got = {r["node_id"]: round(r["score"], 6) for r in N.candidate_scores(nodes).collect()}
    assert got == want and got
    assert N.siblings_of_top(nodes, N.candidate_scores(nodes)).where("is_top").count() == 1


def test_tables_of_pages(spark):
    pages = spark.createDataFrame([(1, PAGE, "a"), (1, PAGE, "b"), (2, None, "c"), (3, "", "d")], "page_id bigint, html string, title string")
    out = extract_articles(pages)
    assert out.columns[0] == "page_id" and out.count() == 4
    assert extract_articles(pages.limit(0)).count() == 0
    assert N.dom_nodes(pages).select("page_id").distinct().count() == 1
    eight = {str(r) for r in extract_articles(pages.repartition(8)).collect()}
    assert eight == {str(r) for r in extract_articles(pages.coalesce(1)).collect()}


def test_headings_links_blocks_indexes(spark):
    html = '<h1>a</h1><h4>b</h4><ol><li>x</li></ol><p>y <a href="/1">Read more</a><a href="/1">again</a></p><div><p>z</p></div>'
    nodes = N.dom_nodes(spark.createDataFrame([(1, html)], "page_id bigint, html string")).cache()
    assert [(r["level"], r["kept_level"]) for r in N.headings(nodes).orderBy("node_id").collect()] == [(1, 1), (4, 2)]
    assert [(r["href"], r["important"]) for r in N.links(nodes).collect()] == [("/1", True)]
    kinds = [(r["kind"], r["text"], r["metadata"]) for r in N.typed_blocks(nodes).orderBy("place").collect()]
    assert [k for k, _, _ in kinds] == ["paragraph", "paragraph", "heading", "heading", "list-item"] and kinds[-1][2] == {"list-type": "ordered"}
    index = {r["node_id"]: r["node_index"] for r in N.node_indexes(nodes).collect()}
    assert index[0] == "0" and index[1] == "0.1" and index[4] == "0.3.1"
    assert N.main_content(nodes).count() == 1
    sel = spark.createDataFrame([("a", "a", None, None, "href", 2), ("b", None, "href", "/1", "href", 3)], "selector string, tag string, attribute string, word string, value_of string, score int")
    assert [(r["value"], r["score"], r["selectors"]) for r in N.selector_scores(nodes, sel).collect()] == [("/1", 10, ["a", "b"])]


def test_images(spark):
    html = '<article><figure><img src="/river.jpg" alt="x"><figcaption>A river</figcaption></figure></article><img src="/spacer.gif"><img src="/a.jpg" width="10" height="10">'
    nodes = N.dom_nodes(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    got = [(r["src"], r["caption"], r["relevant"]) for r in N.images(nodes).orderBy("node_id").collect()]
    assert got == [("/river.jpg", "A river", True), ("/spacer.gif", None, False), ("/a.jpg", None, False)]
    own = [S.is_relevant_image(n) for n in body_of(parse(html)).find_all("img")]
    assert own == [True, False, False]


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<p>a<br><br>b<br>c</p>", "<div><p>a</p><p>b c</p></div>"),
        ("<p>1<hr></p>", "<div><p>1</p><hr/></div>"),
        ("<div>bare <p>x</p> tail</div>", "<div><div><p>bare</p><p>x</p><p>tail</p></div></div>"),
        ("H<sub>2</sub>O <q>hi</q>", '<div>H_2O "hi"</div>'),
        ("<!-- c --><foo>x</foo><p></p>", "<div>x</div>"),
    ],
)
def test_simplify(source, expected):
    got = S.simplify(source)
    assert got == expected and S.simplify(got).count("<p>") == got.count("<p>")


def test_structure_and_fallbacks():
    assert S.preserve_structure("<h1>a</h1><h4>b</h4><li>x</li><li>y</li>") == "<h1>a</h1><h2>b</h2><ul><li>x</li><li>y</li></ul>"
    assert S.repair("x").startswith("<html><head></head><body>")
    assert S.text_with_fallback(PAGE).startswith("A fine story")
    assert S.list_paragraph_blocks(body_of(parse("<p>p</p><ul><li>a<li>b</ul>"))) == ["p", "* a, * b, "]


def test_page_dates_and_bylines():
    html = '<meta property="article:published_time" content="2023-03-27T15:04:05Z"><span class="date">March 1, 2020</span>'
    assert DT.page_date(html).isoformat() == "2023-03-27T15:04:05+00:00"
    assert DT.page_date('<span class="date">27th March 2023</span>').day == 27
    assert DT.page_date("<p>none</p>") is None
    assert DT.page_byline('<span class="byline">By Ann Lee | Writer</span>') == "Ann Lee"
    assert DT.page_byline("<p>Written by Michael Lee</p>") == "Michael Lee"
    assert DT.page_byline("<p>none</p>") == ""


def test_command_line(tmp_path, capsys, monkeypatch):
    page = tmp_path / "a.html"
    page.write_text(PAGE)
    assert cli.main(["--input", f"{page},{tmp_path}/missing.html", "--compact"]) == 0
    out = capsys.readouterr()
    assert json.loads(out.out)["title"] == "A fine story about rivers" and "missing" in out.err and "\\u003c" in out.out
    assert cli.main(["--input", str(page), "--format", "text", "--output-dir", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o" / "a.txt").read_text().endswith("\n\n")
    monkeypatch.setattr("sys.stdin", io.StringIO(PAGE))
    assert cli.main(["--format", "html"]) == 0 and "<h1>" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--format", "xml"])


def test_files_and_sinks(spark, tmp_path):
    from pagewright.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text(PAGE)
    pages = files.pages_from_files(spark, str(tmp_path / "in"))
    articles = extract_articles(pages, keep=("path",))
    for form in files.FORMATS:
        files.write_articles(articles, str(tmp_path / form), form)
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()[0])["title"] == "A fine story about rivers"
    (written,) = (tmp_path / "text").rglob("a.txt")
    assert written.read_text().endswith("\n\n")
    with pytest.raises(ValueError):
        files.output_column("xml")


def test_stream(spark, tmp_path):
    from pagewright.streaming import articles as A

    rows = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, PAGE)], "page_id bigint, html string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = A.article_stream(A.page_stream(spark, str(tmp_path / "in"), rows.schema))
    A.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_errors(spark):
    from pagewright import errors

    assert str(errors.PageError("parse", "read", "bad", ValueError("x"))) == "[parse:read] bad: x"
    df = spark.createDataFrame([("[parse:read] bad",), (None,)], "error string")
    assert [r[0] for r in df.select(errors.is_error_type("error", "parse")).collect()] == [True, False]
    calls = []
    assert errors.with_fallback(lambda: errors.with_retry(lambda: calls.append(1) or 1 / 0, pause=0), lambda: "f") == "f" and len(calls) == 3


def test_deep_pages():
    deep = "<div>" * 3000 + f"<p>{TEXT}</p>" + "</div>" * 3000
    rows = N.page_nodes(deep)
    assert any(r["tag"] == "p" and r["text"].startswith("This is") for r in rows) and max(r["depth"] for r in rows) <= 512
    assert TEXT.strip() in extract_page(deep)["plain_content"]
    for r in N.page_nodes(PAGE):
        if r["tag"] == "body":
            body = body_of(parse(PAGE))
            prepare(body.parent)
            assert r["html_bytes"] == len(body.outer_html().encode())


def test_each_page_once(spark):
    from pagewright.operators.pages import once

    rows = [(1, "u", "a", 5), (1, "u", "b", 3), (1, "v", "b", 3), (2, "u", "c", 1), (3, None, None, None), (3, None, None, None), (None, "x", "y", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, fetched_at int")
    got = sorted(map(tuple, once(df).collect()), key=str)
    assert len(got) == 4 and got == sorted(map(tuple, once(df.orderBy(F.desc("html"))).collect()), key=str)
    assert [r for r in got if r[0] == 1][0][2:] == ("b", 3)
    assert once(df.limit(0)).count() == 0


def test_files_of_articles(spark, tmp_path):
    from pagewright.sources.files import write_articles

    rows = [("dir/a.html", "<p>a</p>", [("x",)]), ("b.html", None, [])]
    df = spark.createDataFrame(rows, "path string, content string, plain_text array<struct<text:string>>")
    write_articles(df, str(tmp_path / "h"), "html")
    assert (tmp_path / "h" / "dir" / "a.html").read_text() == "<p>a</p>" and (tmp_path / "h" / "b.html").read_text() == ""
    write_articles(df, str(tmp_path / "t"), "text")
    assert (tmp_path / "t" / "dir" / "a.txt").read_text() == "x\n\n"
