"""Cursors moved in sets, logs with a compacted base, locks, mergeable folds, generators."""

import random
import re
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from heronry.operators import flow, ranges, sequences, state
from heronry.streaming import loops


@pytest.mark.parametrize("rows", [4096, 20])
def test_cursors_move_each_by_its_own_distance(spark, rows, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", rows)
    monkeypatch.setattr(ranges, "HOT", rows)
    notes = [(n, n % 3 == 0) for n in range(300) if n % 7]
    valid = sorted(n for n, v in notes if v)
    rng = random.Random(1)
    moves = [(f"r{i}", None if i == 0 else rng.randrange(-5, 310), None if i == 1 else rng.randrange(-6, 7)) for i in range(200)]

    def plain(at, k):
        if at is None or not k:
            return at, False
        side = [n for n in valid if n > at] if k > 0 else [n for n in valid if n < at][::-1]
        return (side[abs(k) - 1], True) if len(side) >= abs(k) else (at, False)

    got = state.move_cursors(spark.createDataFrame(notes, "number long, validUrl boolean"), spark.createDataFrame(moves, "role string, noteNumber long, k int"))
    assert {r.role: (r.noteNumber, r.moved) for r in got.collect()} == {role: plain(at, k) for role, at, k in moves}


def test_cursors_advance_in_one_plan(spark):
    notes = spark.createDataFrame([(n, n != 4) for n in range(1, 7)], "number long, validUrl boolean")
    cursors = spark.createDataFrame([("a", 3, "locked"), ("b", 6, "locked"), ("c", 1, "locked")], "role string, noteNumber long, lockStatus string")
    roles = spark.createDataFrame([("a",), ("b",), ("new",)], "role string")
    assert sorted(map(tuple, state.advance_cursors(notes, cursors, roles).collect())) == [("a", 5, "available"), ("b", 6, "locked"), ("c", 1, "locked"), ("new", 1, "available")]


def test_log_with_a_base(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "id string, a int, b string"
    log, plain = loops.Log(spark, path, schema, ["id"], buckets=8), {}
    for batch in range(1, 7):
        rows = [(f"k{(batch * 5 + i) % 11}", batch * 10 + i if i % 2 else None, f"b{batch}" if i % 3 else None) for i in range(6)]
        log.append(spark.createDataFrame(rows, schema), batch)
        for k, a, b in rows:
            old = plain.get(k, (None, None))
            plain[k] = (a if a is not None else old[0], b if b is not None else old[1])
        if batch in (3, 5):
            log.compact(batch)
            log.compact(batch - 1)  # nothing to do
            assert log.compacted() == batch and not list(Path(path).glob(f"batch={batch}"))
        assert {r.id: (r.a, r.b) for r in log.now().collect()} == plain
    some = spark.createDataFrame([("k1",), ("k7",), ("none",)], "id string")
    assert {r.id: (r.a, r.b) for r in log.of(some).collect()} == {k: plain[k] for k in ("k1", "k7") if k in plain}
    plan = log.of(some.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d", plan)  # one key reads one bucket
    log.append(spark.createDataFrame([("k1", 5, "again")], schema), 6)  # batch 6 is done again, over the base
    assert {r.id: r.b for r in log.now(6).collect()} != {} and {r.id: r.b for r in log.of(some).collect()}["k1"] == "again"
    for wrong in (lambda: log.now(5), lambda: log.append(some.withColumn("a", F.lit(1)), 5)):
        with pytest.raises(ValueError, match="part of the base"):
            wrong()


def test_a_compaction_that_is_lost_counts_for_nothing(spark, tmp_path):
    log = loops.Log(spark, str(tmp_path / "log"), "id string, a int", ["id"])
    log.append(spark.createDataFrame([("x", 1)], "id string, a int"), 1)
    (tmp_path / "log/_base/upto=1/bucket=0").mkdir(parents=True)
    assert log.compacted() == -1 and [tuple(r) for r in log.now().collect()] == [("x", 1)]
    log.compact(1)
    assert log.compacted() == 1 and [tuple(r) for r in log.now().collect()] == [("x", 1)]


def test_of_two_lockers_one_wins(spark, tmp_path):
    locks, won, start = loops.Locks(spark, str(tmp_path / "locks")), [], threading.Barrier(8)

    def run(k):
        start.wait()
        if locks.take("fetch-notes", f"worker {k}"):
            won.append(f"worker {k}")

    threads = [threading.Thread(target=run, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and locks.owner("fetch-notes") == won[0] and locks.take("fetch-notes", won[0])
    assert not locks.release("fetch-notes", "another") and locks.release("fetch-notes", won[0])
    assert locks.take("fetch-notes", "another") and locks.take("extract-fields", "another") and locks.owner("none") is None


@pytest.mark.parametrize("keys", [["k"], []])
def test_folds_are_merged_in_order(spark, keys, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 40)
    monkeypatch.setattr(ranges, "HOT", 100)
    rows = [("hot" if i % 4 else f"k{i % 3}", (i * 37) % 1000, None if i % 9 == 0 else chr(97 + i % 26)) for i in range(1000)]
    fold = sequences.Fold("", lambda s, v: s + (v or "-"), lambda a, b: a + b, lambda s: s)  # order matters, and nothing else
    got = sequences.fold_rows(spark.createDataFrame(rows, "k string, i int, v string").repartition(7), keys, ["i"], "v", fold, "string").collect()
    want = {}
    for k, _, v in sorted(rows, key=lambda r: r[1]):
        want[k if keys else ""] = want.get(k if keys else "", "") + (v or "-")
    assert {r.k if keys else "": r.out for r in got} == want
    assert sequences.fold_rows(spark.createDataFrame([], "k string, i int, v string"), keys, ["i"], "v", fold, "string").count() == 0


def test_generators_from_sql_and_frames(spark):
    def down(n):
        if n is None:
            return
        if n < 0:
            raise ValueError("below zero")
        yield from range(n, 0, -1)

    made = flow.generator(spark, "down_from", down, "int")
    d = spark.createDataFrame([(2,), (0,), (None,), (-1,)], "n int")
    got = sorted(map(repr, flow.each_generated(d, made, "n").collect()))
    d.createOrReplaceTempView("numbers_down")
    assert sorted(map(repr, spark.sql("SELECT n, g.* FROM numbers_down, LATERAL down_from(n) g").collect())) == got
    assert [(r.n, r.pos, r.value, r.control and tuple(r.control)) for r in flow.each_generated(d, made, "n").orderBy("n", "pos").collect()] == [(-1, 0, None, ("halt", "below zero")), (2, 0, 2, None), (2, 1, 1, None)]
