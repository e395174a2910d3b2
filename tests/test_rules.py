"""What each rule makes of a page written for it."""

import pytest

from heronry.operators.extract import gather
from heronry.plans.extraction import canonical_fields, extract_fields
from heronry.plans.rules import GENERAL, RULES

LONG = "We study a thing. " * 15
META = '<meta name="citation_title" content="T"><meta name="citation_author" content="A"><meta name="citation_author" content="B"><meta name="citation_pdf_url" content="/x.pdf">'
DC = '<meta name="DC.Title" content="T"><meta name="dc.Creator" content="A"><meta name="dc.creator" content="B">'
FEED = f"""<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><summary>{LONG}</summary>
<link href="http://e.org/a"/><link type="application/pdf" href="http://e.org/x.pdf"/></entry></feed>"""
PAGES = {
    "arxiv": ("http://export.arxiv.org/api/query?id_list=1", FEED),
    "sciencedirect": ("https://www.sciencedirect.com/a/b", f'{META}<meta property="og:description" content="cut"><div class="Abstracts">{LONG}</div><a class="author">A</a>'),
    "acm": ("https://dl.acm.org/doi/1", f'{DC}<div class="abstractInFull">{LONG}</div><a title="PDF" href="/x.pdf">p</a>'),
    "aclweb": ("https://www.aclweb.org/a/1", f'{META}<div class="acl-abstract">Abstract {LONG}</div>'),
    "ijcai": ("https://www.ijcai.org/p/1", f'{META}<div class="col-md-12">{LONG}</div>'),
    "mitpress": ("https://www.mitpressjournals.org/d", f'{DC}<a class="show-pdf" href="/x.pdf">p</a><p class="abstractInFull">{LONG}</p>'),
    "oup": ("https://academic.oup.com/x", f'{META}<section class="abstract"><p class="chapter-para">{LONG}</p></section>'),
    "nips": ("https://papers.nips.cc/p", f"{META}<h4>Abstract</h4><p>{LONG}</p>"),
    "iospress": ("https://content.iospress.com/a", f'{META}<div data-abstract="{LONG}"></div>'),
    "digitalhumanities": ("http://digitalhumanities.org/x", f'<h1 class="articleTitle">T</h1><div class="author">A</div><div class="author">B</div><div id="abstract">{LONG}</div>'),
    "kybernetika": ("https://www.kybernetika.cz/x", f'<div class="ar_title">T</div><div class="authors"><a>A</a><a>B</a></div><p class="abstract">{LONG}</p>'),
    "ieee": ("https://ieeexplore.ieee.org/document/1", f'<script>\nxplGlobal.document.metadata={{"title":"T","abstract":"{LONG}","authors":[{{"name":"A"}},{{"name":"B"}}],"pdfPath":"/x.pdf"}};\n</script>'),
    "springer": ("https://link.springer.com/article/1", f'{META}<script type="application/ld+json">x{{"headline":"T","description":"{LONG}","author":[{{"name":"A"}},{{"name":"B"}}]}}</script>'),
    "neurips": ("https://proceedings.neurips.cc/p", f"{META}<div><h4>Abstract</h4><p></p><p>{LONG}</p></div><div>other</div>"),
    "isca": ("https://www.isca-speech.org/a", f'<div class="w3-card"><h3>T</h3><h5>A, B</h5><p>{LONG}</p><a href="x.pdf">pdf</a></div>'),
    "lrec": ("http://www.lrec-conf.org/s", f'<table><tr><th>Title</th><td>T</td></tr><tr><th>Authors</th><td>A, B</td></tr><tr><th>Abstract</th><td>{LONG}</td></tr><tr><th>Full Paper</th><td><a href="/x.pdf"><b>x</b></a></td></tr></table>'),
    "cogsci": ("https://cogsci.mindmodeling.org/p", f"<h2>Abstract</h2><blockquote><p>{LONG}</p></blockquote>"),
    "general": ("https://somewhere.org/p/q/r", f'<meta name="DC.Title" content="T"><meta name="citation_author" content="A"><meta name="description" content="{LONG}"><meta name="citation_pdf_url" content="../x.pdf">'),
}


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in PAGES.items()], "page_id string, url string, html string")
    out: dict = {}
    for r in canonical_fields(pages, RULES).orderBy("page_id", "seq").collect():
        out.setdefault(r.page_id, {}).setdefault(r.name, []).append((r.value, r.evidence))
    return out


@pytest.mark.parametrize("name", PAGES)
def test_rule(found, name):
    fields = found[name]
    if name != "cogsci":
        assert fields["title"][0][0] == "T"
    assert fields["abstract"][0][0].startswith("We study a thing.")
    authors = [v for v, _ in fields.get("author", [])]
    assert authors in ([], ["A"], ["A", "B"]) if name in ("sciencedirect", "acm", "mitpress", "general") else authors == ([] if name in ("arxiv", "isca", "lrec", "cogsci") else ["A", "B"])
    if "pdf-link" in fields:
        assert fields["pdf-link"][0][0].startswith("http") and fields["pdf-link"][0][0].endswith("x.pdf")


def test_both_ways_to_the_canonical_fields_agree(spark):
    from heronry.operators.evidence import canonical

    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in PAGES.items()], "page_id string, url string, html string")
    rows = lambda d: sorted(map(str, d.select("page_id", "seq", "name", "value", "evidence").collect()))
    assert rows(canonical(extract_fields(pages, RULES))) == rows(canonical_fields(pages, RULES))


def test_evidence_of_general(found):
    value, evidence = found["general"]["title"][0]
    assert evidence[:3] == ["url:host:somewhere.org", "url:path1:p", "url:path2:q"] and 'select:$(meta[name="DC.Title"])' in evidence
    assert "clean: trim extra space" not in evidence and value == "T"


def test_cleaning_leaves_its_trace(found):
    assert "clean: starts w/'abstract'" in found["aclweb"]["abstract"][0][1]


def test_required_key_missing_gives_nothing(spark):
    page = PAGES["aclweb"][1].replace("citation_pdf_url", "other")
    pages = spark.createDataFrame([(1, "https://aclweb.org/x", page), (2, "https://aclweb.org/x", None), (3, None, "<p>x")], "page_id long, url string, html string")
    assert extract_fields(pages).count() == 0


def test_status_and_order(spark):
    pages = spark.createDataFrame([(1, *PAGES["nips"], "404"), (2, *PAGES["nips"], "200")], "page_id long, url string, html string, status string")
    assert {r.page_id for r in extract_fields(pages).collect()} == {2}


def test_springer_attempts_by_address(spark):
    html = PAGES["springer"][1].replace("headline", "x") + f'<meta property="og:description" content="{LONG}"><section id="Abs1"><p class="Para">{LONG}</p></section>'
    pages = spark.createDataFrame([(1, "https://link.springer.com/chapter/1", html), (2, "https://link.springer.com/article/1", html), (3, "https://link.springer.com/book/1", html)], "page_id long, url string, html string")
    names = {}
    for r in extract_fields(pages).collect():
        names.setdefault(r.page_id, set()).add(r.name)
    assert names == {1: {"title", "author", "pdf-link", "abstract-clipped", "abstract"}, 2: {"title", "author", "pdf-link", "abstract"}}


def test_path_segment_is_evidence_too(spark):
    # a key is tried on every evidence string, those of the address included
    pages = spark.createDataFrame([(1, "https://s.org/abstract/x/y", f'<meta name="DC.Title" content="T"><meta name="citation_author" content="{LONG}">')], "page_id long, url string, html string")
    assert {r.name for r in extract_fields(pages).collect()} == {"title", "abstract", "author"}


def test_unknown_kind():
    with pytest.raises(ValueError):
        gather("<p>", (("none",),))
    assert GENERAL.attempts[0].keys()[1] == (["description", "abstract"], True, "abstract")
