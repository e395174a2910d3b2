import pytest
from pyspark.sql import functions as F

from heronry.functions import cleaning, diff, lines, scalars, urls
from heronry.operators import flow, sequences, state, summary
from heronry.sources import corpus


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


LINES = ["apple", "banana", "cherry", "apple", "horse", "banana", "monkey", "cherry", "cat"]


@pytest.mark.parametrize(("patterns", "at"), [(["apple"], 0), (["banana"], 1), (["apple", "banana"], 0), (["apple", "horse"], 3), (["banana", "mon"], 5), (["cherry", ".*", "horse"], 2), ([], -1), (["cat", "x"], -1)])
def test_multi_match(spark, patterns, at):
    assert one(spark, lines.multi_match_index(arr(*LINES), patterns)) == at


def test_no_match(spark):
    assert one(spark, lines.grep_drop_until(arr(*LINES), "zebra")) == []
    assert one(spark, lines.grep_take_until(arr(*LINES), "zebra")) == LINES
    assert one(spark, lines.multi_take_until(arr(*LINES), ["zebra"], True)) == []
    assert one(spark, lines.drop_n(arr("a"), 3)) == []


def test_flow(spark):
    even = lambda x: F.when(x % 2 == 0, x + 1)
    nine = F.sequence(F.lit(1), F.lit(9))
    assert one(spark, flow.for_each_do(nine, even)) == [3, 5, 7, 9]
    assert one(spark, flow.collect_fanout(F.lit(4), even, lambda x: F.when(x > 5, x), lambda x: x * 2)) == [5, 8]
    assert one(spark, flow.each_or_else(F.lit(3), even, lambda x: x * 10)) == 30
    assert one(spark, flow.each_or_else(F.lit(3))) is None
    assert one(spark, flow.take_while_success(F.lit(4), even, lambda x: x > 3)) == 4
    assert one(spark, flow.take_while_success(F.lit(4), even, lambda x: x > 4)) is None


@pytest.mark.parametrize(("text", "ok"), [("http://a.b/c", True), (" http://a.b", False), ("http://a b", False), ("no-url", False), ("http://", False), ("mailto:x", True), (None, False), ("HTTP://A", True)])
def test_is_url(spark, text, ok):
    assert one(spark, urls.is_url(F.lit(text).cast("string"))) is ok


def test_url_parts(spark):
    assert one(spark, urls.url_evidence(F.lit("http://u@H.org:80/a/b/c?d#e"))) == ["url:host:u@h.org:80".replace("u@", ""), "url:path1:a", "url:path2:b"]
    assert one(spark, urls.url_evidence(F.lit("http://h.org/"))) == ["url:host:h.org", "url:path1:undefined", "url:path2:undefined"]
    assert urls.resolve("/x", "http://a.b/c") == "http://a.b/x" and urls.resolve("x y", "http://a.b") is None and urls.resolve("x", None) is None


def test_scalars(spark):
    assert one(spark, scalars.hash_path(F.lit("http://example.com"))).startswith("8/9/d/89d")
    assert one(spark, scalars.interval_ms(F.lit("3d+2h+5m+10s+23z"))) == 3 * 86_400_000 + 2 * 3_600_000 + 5 * 60_000 + 10_000 + 23
    assert one(spark, scalars.interval_ms(F.lit("none"))) is None
    assert one(spark, scalars.strip_margin(F.lit("  |a\n b\n|c"))) == "a\n b\nc"
    assert one(spark, scalars.pad_end(F.lit("abcdef"), 3)) == "abcdef"
    assert one(spark, scalars.brace_slice(F.lit("x{a}y}z"))) == "{a}y}" and one(spark, scalars.brace_slice(F.lit("x"))) is None
    assert one(spark, scalars.js_trim(F.lit(" ﻿ a  \n"))) == "a"
    assert one(spark, scalars.format_time(F.lit(1704258429000))) == "3 Jan 2024 5:7:9"


def test_cleaning(spark):
    long = "word " * 60
    r = one(spark, cleaning.apply_rules(F.lit(f"ABSTRACT  {long}\nmore References [1]")))
    assert r.value == f"{long.strip()} more ".replace("  ", " ") and r.fired == ["starts w/'abstract'", "clip @ 'References'", "starts w/non-word", "remove newlines", "trim extra space"] or r.fired[0] == "starts w/'abstract'"
    assert one(spark, cleaning.clean_abstract(F.lit("short"))) == ""
    assert one(spark, cleaning.clean_abstract(F.lit(long + "References a\nb"))).endswith("References a b")


def test_diff():
    def apply(a, b):
        changes = diff.diff_chars(a, b)
        assert "".join(v for k, v, _ in changes if k != "add") == a and "".join(v for k, v, _ in changes if k != "remove") == b
        return changes

    assert apply("abcabba", "cbabac") and apply("", "x") == [("add", "x", 1)] and apply("", "") == [] and apply("abc", "abc") == [("same", "abc", 3)]
    assert sum(n for k, _, n in apply("kitten", "sitting") if k != "same") == 5


def test_sequences(spark):
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate("aabbc")], "k int, i int, v string")
    assert [(r.v, r.n) for r in sequences.run_lengths(d, ["k"], ["i"], "v").orderBy("run").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    f = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.1, 1.2, 2.3, 2.4])], "k int, i int, v double")
    assert [(r.v, r.n) for r in sequences.run_lengths(f, ["k"], ["i"], "v", F.floor("v")).orderBy("run").collect()] == [(1.1, 2), (2.3, 2)]
    t = spark.createDataFrame([(0, i, v) for i, v in enumerate("{ a b c } { d } { e }".split() + ["{", "x"])], "k int, i int, v string")
    assert [r.text for r in sequences.stanzas(t, ["k"], ["i"], "v", F.col("v") == "{", F.col("v") == "}").orderBy("stanza").collect()] == ["{abc}", "{d}", "{e}"]
    n = spark.range(1, 11).select(F.lit(0).alias("k"), "id")
    assert [r["items"] for r in sequences.chunks(n, ["k"], ["id"], "id", 3).orderBy("chunk").collect()] == [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10]]
    assert [r["items"] for r in sequences.chunks(n.filter("id < 9"), ["k"], ["id"], "id", 3, True).orderBy("chunk").collect()] == [[1, 2, 3], [5, 6, 7], []]


def test_state(spark):
    notes = corpus.mock_status(spark, 40)
    assert state.next_valid(notes, 0).first().number == 3 and state.prev_valid(notes, 3).first().number == 0
    empty = spark.createDataFrame([], "role string, noteNumber long, lockStatus string")
    first = state.advance_cursor(notes, empty, "extract-fields")
    assert first.first().noteNumber == 0
    assert state.advance_cursor(notes, first, "extract-fields").first().noteNumber == 3
    end = spark.createDataFrame([("extract-fields", 39, "x")], "role string, noteNumber long, lockStatus string")
    assert state.advance_cursor(notes, end, "extract-fields").first().noteNumber == 39
    assert state.move_cursor(notes, first, 0).first().moved is False
    assert state.move_cursor(notes, first, 99).first().moved is False
    assert state.move_cursor(notes, first.limit(0), 1).count() == 0


def test_report(spark):
    rows = corpus.mock_status(spark, 200).withColumn("hasPdfLink", F.lit(False)).withColumn("validResponseUrl", F.col("validUrl")).withColumn("updatedAt", F.lit("2024-01-05").cast("timestamp"))
    text = summary.status_report(rows).first().report
    assert text.startswith("Recorded Note Count: 200\n\nNotes With Abstracts: 23") and "Partially Successful Domains" in text and "    2024-01-05: 200" in text
    assert "host-0                             : 20x: " in text


def test_corpus(spark, tmp_path):
    import hashlib
    import json

    url = "http://example.com"
    h = hashlib.sha1(url.encode()).hexdigest()
    d = tmp_path / h[0] / h[1] / h[2] / f"{h}.d"
    (d / "cache").mkdir(parents=True)
    (d / "response-body").write_text("<p>x\ny")
    (d / "metadata.json").write_text(json.dumps({"requestUrl": url, "responseUrl": url, "status": "200", "timestamp": "t", "fetchChain": []}))
    (d / "cache" / "response-body.tidy-norm").write_text("x")
    root = str(tmp_path)
    assert [r.name for r in corpus.list_artifacts(spark, root, corpus.RESPONSE_BODIES).collect()] == ["response-body"]
    assert [r.name for r in corpus.list_artifacts(spark, root, r"tidy-norm\z", "cache").collect()] == ["response-body.tidy-norm"]
    assert [tuple(r) for r in corpus.read_pages(spark, root).collect()] == [(h, url, "200", "<p>x\ny")]
    assert one(spark, corpus.entry_dir(F.lit(url), root)) == str(d)
    assert one(spark, corpus.valid_entry_path(F.lit(str(d)))) and not one(spark, corpus.valid_entry_path(F.lit("/tmp")))
    with pytest.raises(ValueError):
        corpus.guarded_table_name("prod")


def test_write_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert corpus.write_once(rows, str(tmp_path / "t"), ["id"]) == 2
    assert corpus.write_once(rows, str(tmp_path / "t"), ["id"]) == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_cleaning_a_column_is_cleaning_in_a_fold(spark):
    texts = ["Abstract -- We study. " + "x " * 200 + "Keywords a b", "No abstract available " + "y" * 300, "short", None, "a   b\n" + "z " * 300 + " Full Text: PDF", "Graphical Abstract Download " * 2]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    one = {r.i: (r.value, r.fired) for r in cleaning.with_cleaned(d, "t").collect()}
    two = {r.i: (r.r.value, r.r.fired) for r in d.select("i", cleaning.apply_rules(F.col("t")).alias("r")).collect()}
    assert {i: v for i, v in one.items() if texts[i] is not None} == {i: v for i, v in two.items() if texts[i] is not None} and one[3][0] is None
