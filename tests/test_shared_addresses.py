"""Pages of one address: each note has its own answer and each page its own files, and a corpus keeps the first response whole."""

import pytest
from pyspark.sql import functions as F

from heronry.plans import queries
from heronry.sources import corpus, entries
from heronry.streaming import loops


@pytest.fixture(scope="module")
def pages(spark):
    """Pages 11 to 40 in pairs of one address, the larger number first."""
    rows = [(i, f"http://a.org/{(i + 1) // 2}", f"<p>page {i}") for i in range(40, 10, -1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4, "page_id")


def test_files_of_pages_of_one_address(pages):
    got = queries._files(pages).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in got} == {i: 5 if i % 10 == 0 else 4 for i in range(11, 41)}


def test_notes_of_one_address_have_their_own_page(pages):
    ids = [i for i in range(11, 41) if i % 4 != 1]
    there = lambda i: i % 3 != 0
    _, status, changed = queries._loop(pages)
    got = sorted((int(r.id), r.httpStatus) for r in status.collect())
    assert got == [(i, (404 if i % 5 == 0 else 200) if there(i) else None) for i in ids]
    fields = sorted((int(r.noteId), r.fieldType) for r in changed.collect())
    assert fields == [(i, f) for i in ids if there(i) and i % 5 for f in (("pdf",) if i % 2 == 0 else ("abstract", "pdf"))]


def test_notes_that_share_an_address_share_one_page(spark):
    notes = spark.createDataFrame([("n1", 1, "http://a.org/1", True), ("n2", 2, "http://a.org/1", True)], "id string, number long, url string, validUrl boolean")
    cursors = spark.createDataFrame([], loops.CURSORS)
    fields = spark.createDataFrame([], "noteId string, fieldType string, contentHash string")
    answers = spark.createDataFrame([("http://a.org/1", None, "404", "x"), ("http://a.org/1", None, "200", "x"), ("http://a.org/1", None, None, None)], "url string, response_url string, status string, html string")
    _, status, _ = loops.extraction_step(notes, cursors, answers, fields, 0)
    assert sorted((r.id, r.httpStatus) for r in status.collect()) == [("n1", 200), ("n2", 200)]


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_corpus_keeps_one_response_of_an_address(spark, pages, tmp_path, overwrite):
    root = str(tmp_path)
    n = entries.save_responses(queries._fetched(pages), root, overwrite, ties=("page_id",)).where("written and name = 'response-body'").count()
    assert n == 15
    kept = {r.html for r in corpus.read_pages(spark, root).select(F.trim("html").alias("html")).collect()}
    assert kept == {f"<p>page {i + overwrite}" for i in range(11, 40, 2)}
