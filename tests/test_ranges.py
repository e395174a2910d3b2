"""Ranges against windows over whole keys: hot keys, whole tables, strings with one beginning, ties, nulls."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from heronry.operators import ranges, sequences


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 50)
    monkeypatch.setattr(ranges, "HOT", 100)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", None if i % 41 == 0 else rng.randrange(300), f"http://host/{i:05d}", rng.choice("ab{}x"), rng.random()) for i in range(2000)]
    return spark.createDataFrame(out, "k string, t int, u string, v string, x double")


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("tree", [256, 3])
def test_numbered(rows, small, keys, tree, monkeypatch):
    monkeypatch.setattr(ranges, "TREE", tree)
    r = ranges.Ranges(rows, keys, ["t", "u"], 9)
    assert len(r.bounds) > 4 and r.rows.select("_range").distinct().count() > 4
    want = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "u")) - 1)
    got = ranges.numbered(rows, keys, ["t", "u"], parts=9)
    assert sorted(map(repr, got.select("u", "_i").collect())) == sorted(map(repr, want.select("u", "_i").collect()))


def test_what_is_cut(spark):
    d = spark.range(20_000).select(F.concat(F.lit("http://host/"), "id").alias("s"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("t"), "id")
    for order in (["s"], ["t", "id"], ["t", "s"]):
        largest = ranges.Ranges(d, [], order, 4).rows.groupBy("_range").count().agg(F.max("count")).first()[0]
        assert largest < 8000, order
    assert ranges.Ranges(d.limit(100), [], ["s"], 4).bounds == [] and ranges.numbered(d.limit(0), ["s"], ["id"]).count() == 0


def test_other_kinds(spark, small):
    d = spark.range(600).select((F.col("id") % 3).cast("decimal(9,2)").alias("a"), F.to_date(F.lit("2024-01-01")).alias("b"), F.encode(F.col("id").cast("string"), "utf-8").alias("c"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("id") / 7).alias("f"), "id")
    for order in (["a", "id"], ["b", "f", "id"], ["c"]):
        want = d.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("_i")).collect()
        assert sorted(map(tuple, ranges.numbered(d, [], order, parts=6).select("id", "_i").collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("keys", [["k"], []])
def test_runs_and_stanzas(rows, small, keys, monkeypatch):
    whole = {}
    for cut in (True, False):
        monkeypatch.setattr(ranges, "ROWS", 50 if cut else 10**9)
        runs = sequences.run_lengths(rows, keys, ["t", "u"], "v")
        texts = sequences.stanzas(rows, keys, ["t", "u"], "v", F.col("v") == "{", F.col("v") == "}")
        chunks = sequences.chunks(rows, keys, ["t", "u"], "u", 7)
        whole[cut] = [sorted(map(repr, d.collect())) for d in (runs, texts, chunks)]
    assert whole[True] == whole[False] and all(map(len, whole[True]))


def test_stanzas_follow_the_machine(rows, small):
    order = rows.orderBy("t", "u").collect()
    want, held, inside = [], "", False
    for r in order:
        inside = inside or r.v == "{"
        held += r.v if inside else ""
        if r.v == "}":
            want.append(held)
            held, inside = "", False
    got = sequences.stanzas(rows, [], ["t", "u"], "v", F.col("v") == "{", F.col("v") == "}").orderBy("stanza").collect()
    assert [r.text for r in got] == want
