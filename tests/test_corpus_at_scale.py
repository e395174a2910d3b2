"""A corpus is listed and read by tasks: the driver holds no names, and files that Spark's own readers pass over as empty are there."""

import hashlib
import json

import pytest

from heronry.sources import corpus


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """60 entries; every fifth body is empty, and the metadata of some isn't JSON or has a byte order mark."""
    top = tmp_path_factory.mktemp("corpus")
    for i in range(60):
        h = hashlib.sha1(str(i).encode()).hexdigest()
        d = top / h[0] / h[1] / h[2] / f"{h}.d"
        (d / "cache").mkdir(parents=True)
        (d / "response-body").write_bytes(b"" if i % 5 == 0 else f"é{i}\r\n".encode())
        meta = json.dumps({"requestUrl": f"u{i}", "responseUrl": f"u{i}", "status": "200", "fetchChain": []})
        (d / "metadata.json").write_text({7: "no", 8: "", 9: f"﻿{meta}"}.get(i, meta))
        (d / ".response-body-x").write_text("draft")
    (top / "_drafts" / "j").mkdir(parents=True)
    (top / "_drafts" / "j" / "response-body").write_text("draft")
    return str(top)


def entry(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def body(i):
    return "" if i % 5 == 0 else f"é{i}\r\n"


def test_all_pages_are_read_also_the_empty_ones(spark, root):
    got = {r.page_id: (r.url, r.status, r.html) for r in corpus.read_pages(spark, root).collect()}
    assert got == {entry(i): (None, None, body(i)) if i == 7 else (f"u{i}", "200", body(i)) for i in range(60) if i != 8}


def test_the_driver_lists_no_files(spark, root):
    for d in (corpus.read_pages(spark, root), corpus.list_artifacts(spark, root)):
        assert d.inputFiles() == []  # no plan has an index of files, which the driver would hold


def test_the_planner_takes_no_corpus_for_small(spark, root):
    for d in (corpus.read_text(spark, root), corpus.read_metadata(spark, root), corpus.list_artifacts(spark, root)):
        plan = d._jdf.queryExecution().optimizedPlan()
        assert int(str(plan.stats().sizeInBytes())) > 2**50 and "Repartition" not in plan.toString()  # else it would be broadcast, or again by AQE


def test_names_and_lengths(spark, root):
    got = {(r.entry, r.length) for r in corpus.list_artifacts(spark, root, corpus.RESPONSE_BODIES).collect()}
    assert got == {(entry(i), len(body(i).encode())) for i in range(60)}


def test_small_pieces_and_a_flat_folder(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "MOST_NAMES", 3)
    monkeypatch.setattr(corpus, "MOST_BYTES", 4)
    assert corpus.read_text(spark, root).count() == 60
    for i in range(20):
        (tmp_path / f"{entry(i)}.d").mkdir()
        (tmp_path / f"{entry(i)}.d" / "response-body").write_text(body(i))
    assert {r.entry for r in corpus.read_text(spark, str(tmp_path)).collect()} == {entry(i) for i in range(20)}


def test_patterns_and_missing_folders_are_left_to_spark(spark, root):
    assert corpus.read_text(spark, f"{root}/[0-9a-f]", "response-{body,frame}*").count() == 48  # Spark's readers pass over empty files
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_text(spark, f"{root}/none")
