"""The corpus as a sink, the way from a server through the corpus to fields, posts, schedules, settings and fixtures."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heronry import config
from heronry.operators import schedule as sc
from heronry.plans.extraction import canonical_fields
from heronry.sources import corpus, entries, feeds, fixtures

from .test_feeds import server  # noqa: F401  a fixture

ENTRY = "0/1/2/" + "0" * 40 + ".d"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "entry string, subdir string, name string, content string")


def test_files_are_written_once(spark, tmp_path):
    root = str(tmp_path)
    d = files(spark, (ENTRY, "cache", "a.txt", "é1"), (ENTRY, ".", "b.txt", "2"), (ENTRY, ".", "c.txt", None), (None, ".", "d.txt", "4"))
    assert sorted((r.name, r.written) for r in entries.write_texts(d, root).collect()) == [("a.txt", True), ("b.txt", True), ("c.txt", False)]
    assert not any(r.written for r in entries.write_texts(d, root).collect())
    again = files(spark, (ENTRY, "cache", "a.txt", "new"))
    assert [r.written for r in entries.write_texts(again, root, overwrite=True).collect()] == [True]
    assert (tmp_path / ENTRY / "cache" / "a.txt").read_text() == "new" and sorted(os.listdir(tmp_path / ENTRY)) == ["b.txt", "cache"]
    for bad in ((ENTRY, "elsewhere", "x", "1"), ("../x.d", ".", "x", "1")):
        with pytest.raises(Exception, match="no artefact folder|outside the corpus"):
            entries.write_texts(files(spark, bad), root).collect()
    one = entries.write_json(files(spark, (ENTRY, ".", "j.json", None)), root, F.struct(F.lit(1).alias("a"))).collect()
    assert one[0].written and json.loads((tmp_path / ENTRY / "j.json").read_text()) == {"a": 1}
    assert corpus.expand_dir(spark, str(tmp_path / ENTRY)).first().files == ["b.txt", "j.json"]


def test_read_modify_write(spark, tmp_path):
    d = spark.createDataFrame([(ENTRY, 1)] * 10, "entry string, by long")
    count = lambda before, row: {"count": before["count"] + row["by"]} if before else {"count": 0}
    assert [r.written for r in entries.update_json(d, str(tmp_path), "n.json", count, "cache").collect()] == [True] * 10
    got = entries.read_json(d.select("entry").distinct(), str(tmp_path), "n.json", "cache").first().content
    assert json.loads(got) == {"count": 9}
    same = entries.update_json(d.limit(1), str(tmp_path), "n.json", lambda before, _: dict(before), "cache").collect()
    assert not same[0].written and entries.read_json(d.limit(1), str(tmp_path), "none.json").first().content is None


def test_folders_are_made_and_emptied(spark, tmp_path):
    (tmp_path / "keep").mkdir()
    (tmp_path / "keep" / "x").write_text("x")
    d = spark.createDataFrame([(ENTRY,), ("keep",)], "entry string")
    made = entries.ensure_dirs(d.where(F.col("entry") == ENTRY), str(tmp_path)).collect()
    assert {r.subdir for r in made} == set(corpus.ARTIFACT_DIRS) and sum(r.written for r in made) >= 4
    (tmp_path / ENTRY / "cache" / "y").write_text("y")
    assert {r.entry: r.written for r in entries.clean_entries(d, str(tmp_path)).collect()} == {ENTRY: True, "keep": False}
    assert os.listdir(tmp_path / ENTRY) == [] and (tmp_path / "keep" / "x").exists()


def test_from_server_to_fields(spark, server, tmp_path):  # noqa: F811
    url, _ = server
    page = '<meta name="citation_title" content="T"><meta name="citation_author" content="A"><meta name="citation_pdf_url" content="/x.pdf"><meta name="description" content="%s">' % ("We study a thing. " * 15)
    urls = spark.createDataFrame([(f"{url}/a",), (f"{url}/missing",), ("http://127.0.0.1:1/x",)], "url string")
    get = lambda u: (*(r := feeds.http_get(u))[:2], page, {**r[3], "frames": ["<p>whole frame"]})
    fetched = feeds.fetch(urls, get)
    root = str(tmp_path / "corpus")
    assert entries.save_responses(fetched, root).where("written").count() == 10  # five files of two pages
    folder = tmp_path / "corpus" / spark.range(1).select(corpus.entry_dir(F.lit(f"{url}/a")).alias("e")).first().e
    assert sorted(os.listdir(folder)) == ["metadata.json", "request-headers.json", "response-body", "response-frame-0", "response-headers.json"]
    assert (folder / "response-frame-0").read_text() == "<p>whole frame" and json.loads((folder / "metadata.json").read_text())["status"] == "200"
    pages = corpus.read_pages(spark, root)
    assert sorted(r.status for r in pages.collect()) == ["200", "404"]
    got = {r.name for r in canonical_fields(pages).collect()}
    assert {"title", "author", "abstract", "pdf-link"} <= got
    assert entries.clean_entries(spark.createDataFrame([(str(folder.relative_to(tmp_path / "corpus")),)], "entry string"), root).first().written and corpus.read_pages(spark, root).count() == 1


def test_posts_are_tried_again(spark, tmp_path):
    rows = spark.createDataFrame([("n1", "abstract", "v"), ("n2", "pdf", "w")], "noteId string, fieldType string, value string")
    log = str(tmp_path / "log")

    def send(body):
        with open(log, "a") as f:
            f.write(f"{body['noteId']}\n")
        if body["noteId"] == "n1" and open(log).read().count("n1") == 1 or body["noteId"] == "n2":
            raise OSError("down")

    got = {r.noteId: r.control for r in feeds.post(feeds.outbox(rows, "me"), send).collect()}
    assert got["n1"] is None and got["n2"].code == "continue" and sorted(open(log).read().split()) == ["n1", "n1", "n2", "n2"]
    ids = {json.loads(r.body)["id"] for r in feeds.outbox(rows.union(rows), "me").collect()}
    assert len(ids) == 2  # a repeat has the same id


def test_service(server):  # noqa: F811
    url, _ = server
    service = feeds.Service(url, "user", "word")
    assert service.login() is None  # this server has no login
    assert len(service.call("notes", limit=2)["notes"]) == 2
    with pytest.raises(OSError):
        service.post_edit({"id": "x"})


def test_schedules():
    start = datetime(2024, 1, 31, 10, 7, 30)  # a Wednesday
    times = lambda text, n=2: [t.strftime("%d %H:%M:%S") for t in sc.parse_schedule(text).next_times(start, n)]
    assert times("every 5 minutes") == ["31 10:10:00", "31 10:15:00"]
    assert times("every 2 hours after 12:00 before 15:00") == ["31 12:00:00", "31 14:00:00"]
    assert times("at 10:15 am and 1:30 pm", 3) == ["31 10:15:00", "31 13:30:00", "01 10:15:00"]
    assert times("at 09:00 every weekday", 3) == ["01 09:00:00", "02 09:00:00", "05 09:00:00"]
    assert times("at 23:00 on the last day of the month") == ["31 23:00:00", "29 23:00:00"]
    assert times("on Monday at 12:00 also at 12:00 every weekend", 3) == ["03 12:00:00", "04 12:00:00", "05 12:00:00"]
    assert sc.trigger_period("every 30 sec") == "30 seconds" and sc.trigger_period("at 10:00") is None
    for text, at in (("", 0), ("never", 0), ("every 5 minutes or so", 16), ("at 25:00", 0), ("at 13:00 pm", 0)):
        assert sc.parse_schedule(text).error == at and sc.explain(text)[1] == f">  {text}"
    assert sc.explain("every hour") == []
    clock, ran = [start], []
    due = sc.run_on_schedule("every 5 minutes", lambda: ran.append(clock[0]), 2, lambda: clock[0], lambda s: clock.append(clock.pop() + timedelta(seconds=s)))
    assert ran == due == sc.parse_schedule("every 5 minutes").next_times(start, 2)


def test_settings(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "config-test.json").write_text('{"root": "x"}')
    testing = {config.VARIABLE: "test"}
    assert config.settings(tmp_path / "a" / "b", testing) == {"root": "x"} and config.settings(tmp_path, {}) == {}
    assert config.required({"root": "x"}, "root") == "x" and config.is_testing(testing) and not config.is_testing({})
    with pytest.raises(KeyError):
        config.required({}, "root")
    with pytest.raises(ValueError):
        config.mode({config.VARIABLE: "other"})
    assert config.text_or_none(tmp_path / "none") is None and config.time_of_day(datetime(2024, 1, 1, 3, 4, 5)) == "03.04.05"


def test_fixtures(spark):
    notes = fixtures.fake_notes(spark, 50)
    times = [r.updatedAt for r in fixtures.write_times(notes, ["number"], "2024-02-01").orderBy("number").collect()]
    assert times == sorted(times) and (times[0] - datetime(2024, 1, 18)).total_seconds() < 3 * 3600 and all((b - a).total_seconds() < 3 * 3600 for a, b in zip(times, times[1:], strict=False))
    assert sorted(r.status for r in fixtures.responses(spark, "http://x/").collect()) == ["200", "200", "404", "500"]


def test_commands(spark):
    from heronry.functions.process import piped, run_one

    d = spark.createDataFrame([("b\na",), (None,)], "t string")
    got = d.select(piped(F.col("t"), ["sort"]).alias("r")).collect()
    assert tuple(got[0].r) == (["a", "b"], [], 0) and got[1].r is None
    assert run_one(["sh", "-c", "echo x >&2; exit 3"], "", 5) == ([], ["x"], 3)
    assert run_one(["sleep", "9"], "", 0.2)[2] is None and run_one(["no-such-command"], "", 1)[2] is None


def test_no_fetch(spark):
    urls = corpus.with_entries(spark.createDataFrame([("http://a.b/c",)], "url string"), "/r/")
    row = feeds.fetch(urls, feeds.no_fetch).first()
    assert (row.response_url, row.status, row.body, row.control) == ("http://a.b/c", "", "", None)
    assert urls.first().entry_path == f"/r/{urls.first().entry}" and urls.first().initial_url == "http://a.b/c"


def test_command_line(spark, server, tmp_path, capsys):  # noqa: F811
    from heronry.cli import main

    url, _ = server
    (tmp_path / "urls.txt").write_text(f"{url}/a\n# no\n{url}/b\n")
    said = lambda *args: (main([str(a) for a in args]), capsys.readouterr().out)
    assert said("list-urls", "--file", tmp_path / "urls.txt") == (0, f"{url}/a\n{url}/b\n")
    assert said("spider", "--file", tmp_path / "urls.txt", "--out", tmp_path / "corpus", "--corpus") == (0, "8 files written\n")
    assert main(["extract", "--pages", str(tmp_path / "corpus"), "--corpus", "--out", str(tmp_path / "fields")]) == 0
    assert said("clean", "--file", tmp_path / "urls.txt", "--corpus", tmp_path / "corpus")[1] == "2 entries emptied\n"
    assert said("extract-url", "--url", f"{url}/a") == (0, "")  # a page without fields
    assert said("schedule", "every so often")[0] == 1 and len(said("schedule", "every 5 minutes", "--count", "3")[1].split("\n")) == 4
    root = tmp_path / "logs"
    assert said("set-cursor", "--root", root, "--role", "extract-fields", "--note", "n1", "--number", "1")[1] == "extract-fields\tn1\t1\tavailable\n"
    assert said("lock-cursor", "--root", root, "--role", "extract-fields")[1] == "extract-fields\tn1\t1\tlocked\n"
    notes = spark.createDataFrame([(f"n{i}", i, f"http://a.org/{i}", True) for i in (1, 2)], "id string, number long, url string, validUrl boolean")
    pages = spark.createDataFrame([("http://a.org/2", None, "200", '<meta name="citation_title" content="T"><meta name="description" content="%s">' % ("We study a thing. " * 15))], "url string, response_url string, status string, html string")
    notes.write.parquet(str(tmp_path / "notes"))
    pages.write.parquet(str(tmp_path / "pages"))
    assert said("run-extraction", "--notes", tmp_path / "notes", "--pages", tmp_path / "pages", "--root", root)[1] == "1 fields changed\n"
    assert said("show-cursors", "--root", root)[1] == "extract-fields\tn2\t2\tavailable\n"
    report = said("monitor", "--root", root)[1]
    assert "Recorded Note Count: 1" in report and "extractor:success: 1" in report
