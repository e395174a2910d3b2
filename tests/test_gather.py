"""Pages are gathered from without a selector for each way to write a name, and a batch is unpacked in small parts."""

import pyarrow as pa

from heronry.functions import dom
from heronry.operators import extract
from heronry.plans.rules import GENERAL

PAGE = "".join(f'<meta {a}="{n}" content="{i}">' for i, n in enumerate(("DC.Title", "dc.title", "Dc.tITLE", "dC.Title", "DCxTitle", "DC.Titles", "og:title", "DC.Title\n")) for a in ("name", "property"))


def test_metas_are_those_that_the_selector_finds():
    tree = dom.parse(PAGE)
    for name in ("DC.Title", "dc.title", "og:title", "OG:Title", "x"):
        for attr in ("name", "property"):
            assert dom.metas_named(dom.select(tree, "meta"), name, attr) == dom.select(tree, dom.meta_selector(name, attr))


def test_no_selector_is_written_out_for_metas(monkeypatch):
    monkeypatch.setattr(dom, "meta_selector", None)
    assert [t for t, _ in extract.gather(PAGE, (("meta", "DC.Title", "name"), ("meta_all", "A" * 64, "name")))] == ["0"]
    extract.gather(PAGE, GENERAL.specs)


def test_batches_are_unpacked_in_parts(spark):
    n = 3 * extract.PART + 1
    parts = list(extract._parts((pa.array(range(n)), pa.array(["x"] * n))))
    assert [len(p[0]) for p in parts] == [extract.PART] * 3 + [1] and [x for p in parts for x in p[0]] == list(range(n))
    d = spark.range(n).selectExpr("id AS page_id", "'http://a.org/p/' || id AS url", "'200' AS status", "CASE WHEN id % 7 <> 0 THEN '<meta name=\"description\" content=\"d' || id || '\">' END AS html").coalesce(1)
    got = {r.page_id: [x.text for x in r.candidates] for r in extract.with_candidates(d).collect()}
    assert got == {i: [f"d{i}"] if i % 7 else [] for i in range(n)}
