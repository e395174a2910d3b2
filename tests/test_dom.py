import pytest

from heronry.functions import dom

PAGE = """<html><head><meta name="citation_author" content="A"><meta name="citation_author" content="B"><meta name="citation_title" content="T">
<meta name="dc.Creator" content="C"><meta name="dc.creator" content="D"><meta property="og:description" content="O"></head>
<body><section class="Abstract main" id="Abs1"><p class="Para">Text <b>bold</b></p></section><a class="show-pdf" href="/x.pdf">PDF</a>
<div id="my-outer" class="outer"><div id="my-inner" class="inner" mdata="one">in</div></div>
<div id="div1" class="c0" attr-one="one"></div><div class="c0" attr-one="two" mdata=two></div>
<h4>Abstract</h4><p>After<p>Next<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table><script>var x = "</p>";</script></body></html>"""


@pytest.fixture(scope="module")
def tree():
    return dom.parse(PAGE)


def texts(tree, css):
    return [n.text() for n in dom.select(tree, css)]


def test_attributes(tree):
    assert dom.select_one(tree, "meta[name=citation_title]").attrs["content"] == "T"
    assert "content_" not in dom.select_one(tree, 'meta[name="citation_title"]').attrs
    assert [n.attrs["content"] for n in dom.select(tree, 'meta[name="citation_author"]')] == ["A", "B"]
    assert [n.attrs["attr-one"] for n in dom.select(tree, ".c0")] == ["one", "two"]
    assert dom.select_one(tree, "[mdata]").attrs["mdata"] == "one"
    assert dom.select_one(tree, "[mdata=two]").attrs["attr-one"] == "two"


def test_nesting(tree):
    outer = dom.select_one(tree, ".outer")
    assert outer.attrs["id"] == "my-outer"
    assert dom.select_one(outer, ".inner").attrs["id"] == "my-inner"
    assert texts(tree, "section#Abs1 > p.Para") == ["Text bold"]
    assert texts(tree, "body > p.Para") == []
    assert texts(tree, "h4 + p") == ["After"]
    assert texts(tree, ".abstract") == [] and texts(tree, '[class="Abstract"]') == [] and len(texts(tree, ".Abstract")) == 1
    assert texts(tree, "b, a.show-pdf") == ["bold", "PDF"]


def test_implied_ends(tree):
    assert texts(tree, "li") == ["1", "2"] and texts(tree, "td") == ["a", "b", "c"]
    assert texts(tree, "script") == ['var x = "</p>";']


def test_bad_selectors(tree):
    for css in ("", "a >", "a:hover", "[", "a,,b >", ":not(a b)", ":not()"):
        with pytest.raises(dom.SelectorError):
            dom.select(tree, css)


def test_case_variations():
    assert dom.case_variations("A.B.C") == ["A.B.C", "A.B.c", "A.b.C", "A.b.c", "a.B.C", "a.B.c", "a.b.C", "a.b.c"]
    assert dom.case_variations("DC.Creator")[0] == "DC.Creator" and len(dom.case_variations("DC.Creator")) == 8
    assert [n.attrs["content"] for n in dom.select(dom.parse(PAGE), dom.meta_selector("DC.Creator"))] == ["C", "D"]


def test_tidy():
    out = dom.tidy("<html><body><h4>Abstract</h4><p>One <b>two</b>\n three</p></body></html>").split("\n")
    assert out == ["<html>", "    <body>", "        <h4>", "            Abstract", "        </h4>", "        <p>", "            One <b>two</b> three", "        </p>", "    </body>", "</html>"]


def test_outer():
    assert dom.outer_html(dom.parse('<p a="1&amp;2">x<br>y')) == '<p a="1&amp;2">x<br />y</p>'


def test_more_selectors():
    tree = dom.parse("<ul><li a=xy class='c d'>1<li>2<li id=q>3</ul><p lang=en-GB>z")
    want = {"li:not(.c)": "23", "li ~ li": "23", "li + li": "23", "[a^=x]": "1", "[a$='y']": "1", "[a*=q]": "", "[class~=d]": "1", "li:first-child": "1", "li:last-child": "3", "li:not(#q):not([a])": "2", "ul ~ p": "z", "[lang|=en]": "z", "li:not(.c, #q)": "2"}
    assert {css: "".join(texts(tree, css)) for css in want} == want


def test_deep_pages():
    """Neither depth nor tags that are never closed cost more than a walk of the page."""
    n = 100_000
    page = "<div>" * n + "<p>x</p>" + "<span>" * n + "<a href=y>z"
    tree = dom.parse(page)
    assert len(dom.select(tree, "div div > p")) == 1 and len(dom.select(tree, "div span > a, q")) == 1
    assert dom.outer_html(tree).count("<div>") == n and dom.tidy(page).count("<div>") == n
    assert len(dom.select(dom.parse("<a><b>" * 20_000), "a > b a b")) == 19_999


def test_matches_below_a_node_see_what_is_above(tree):
    assert [n.text() for n in dom.select(dom.select_one(tree, "section"), "body section > p b")] == ["bold"]


def test_pages_that_fail_are_control_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from heronry.operators import extract

    d = spark.createDataFrame([(1, "http://export.arxiv.org/1", "200", "<feed><entry>" * 300 + "x"), (2, "http://a.b/c", "200", "<div>" * 50_000 + '<meta name="citation_title" content="T">'), (3, "http://a.b/d", "200", None)], "page_id long, url string, status string, html string")
    rows = {r.page_id: r for r in extract.with_candidates(d).collect()}
    assert len(rows) == 3 and all(r.control is None for r in rows.values()) and rows[2].candidates and not rows[3].candidates
    bad = spark.range(1).select(extract.css_text(F.lit("<p>x"), F.lit("p >")).alias("t"), extract.css_control("p >").alias("c"), extract.css_texts(F.lit("<p>x<b>y"), F.array(F.lit("p"), F.lit("b"))).alias("m")).first()
    assert bad.t is None and bad.c.code == "halt" and "p >" in bad.c.msg and extract.css_control("p > a") is None and bad.m == [["xy"], ["y"]]
