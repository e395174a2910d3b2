"""Small operators that no query stands for: corpus folders, records, tables, observations, settings."""

import json

import pytest
from pyspark.sql import functions as F

from heronry import cli, config
from heronry.operators import flow
from heronry.sources import corpus, entries

URLS = ("http://a.org/1", "http://b.org/2")


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path / "corpus")
    d = spark.createDataFrame([(u,) for u in URLS], "url string").select(corpus.entry_dir(F.col("url")).alias("entry"), "url")
    files = d.select("entry", F.explode(F.array(*(F.struct(F.lit(s).alias("subdir"), F.lit(n).alias("name"), c.alias("content")) for s, n, c in (
        (".", "metadata.json", F.to_json(F.struct(F.col("url").alias("requestUrl"), F.col("url").alias("responseUrl"), F.lit("200").alias("status")))),
        (".", "response-body", F.concat(F.lit("<p>\n"), "url")), ("cache", "response-body.tidy-norm", F.lit("tidy")), ("cache", "other", F.lit("x")),
    )))).alias("f")).select("entry", "f.*")
    entries.write_texts(files, root).collect()
    return root


def test_corpus_listings(spark, stored):
    assert {r.name for r in corpus.list_normalised(spark, stored).collect()} == {"response-body.tidy-norm"} and corpus.list_normalised(spark, stored).count() == 2
    assert {r.name for r in corpus.list_artifacts(spark, stored, "response-body").collect()} >= {"response-body"}
    assert {(r.responseUrl, r.status) for r in corpus.read_metadata(spark, stored).collect()} == {(u, "200") for u in URLS}
    assert {r.text for r in corpus.read_text(spark, stored).collect()} == {f"<p>\n{u}" for u in URLS}
    assert {(r.url, r.html) for r in corpus.read_pages(spark, stored).collect()} == {(u, f"<p>\n{u}") for u in URLS}


def test_records_and_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_text('1,conf/x,"A, title",http://a.org\n2,,B,\n')
    rows = corpus.read_records(spark, str(tmp_path / "in.csv")).collect()
    assert len(rows) == 2 and "A, title" in tuple(rows[0]) and None in tuple(rows[1])
    (tmp_path / "urls").write_text(" http://a.org/1 \n# no\n\nnot one\nhttp://b.org\n")
    lines = corpus.read_lines(spark, str(tmp_path / "urls"))
    assert lines.count() == 5 and [r.url for r in corpus.url_list(lines).collect()] == ["http://a.org/1", "http://b.org"]


def test_only_a_test_database_is_reset(spark):
    with pytest.raises(ValueError, match="no test database"):
        corpus.reset_tables(spark, "production", {"t": "id int"})
    for _ in range(2):
        corpus.reset_tables(spark, "heronry_test", {"notes": "id string, n int", "marks": "role string"})
        assert spark.table("heronry_test.notes").count() == 0 and spark.table("heronry_test.marks").columns == ["role"]
        spark.createDataFrame([("a", 1)], "id string, n int").write.mode("append").saveAsTable("heronry_test.notes")
    spark.sql("DROP DATABASE heronry_test CASCADE")




def test_observations(spark):
    from pyspark.sql import Observation

    control = F.when(F.col("id") % 4 == 0, flow.control(F.lit("halt"), F.lit("why")))
    d = spark.range(10).withColumn("control", control)
    either, steps = Observation("either"), Observation("steps")
    failed = F.col("control").isNotNull()
    assert flow.tap_either("e", "control")(d).count() == 10 and flow.progress("p", 3)(d).count() == 10
    assert d.observe(either, F.count_if(failed).alias("failed")).observe(steps, F.floor(F.count("*") / 3).alias("steps")).count() == 10
    assert either.get == {"failed": 3} and steps.get == {"steps": 3}


def test_settings(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "config-test.json").write_text(json.dumps({"url": "x"}))
    assert config.find_above("config-test.json", tmp_path / "a/b") == (tmp_path / "config-test.json").resolve() and config.find_above("no such file", tmp_path) is None
    assert config.settings(tmp_path / "a/b", {config.VARIABLE: "test"}) == {"url": "x"} and config.settings(tmp_path, {}) == {}
    assert config.text_or_none(tmp_path / "none") is None and config.required({"a": 0}, "a") == 0
    with pytest.raises(KeyError):
        config.required({}, "a")


def test_preflight(spark, tmp_path, capsys):
    assert cli.main(["preflight", "--folder", str(tmp_path)]) == 0 and "ok 10" in capsys.readouterr().out
