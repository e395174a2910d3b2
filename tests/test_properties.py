"""Seeded generators: a status row is valid exactly where its address is, and a host is there exactly where the response is one."""

import random

from pyspark.sql import functions as F

from heronry.functions.urls import host, is_url
from heronry.operators import state


def addresses(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        name = "".join(rng.choice("abcXYZ09-") for _ in range(rng.randint(1, 8))).strip("-") or "h"
        url = f"{rng.choice(['http', 'https', 'HTTP', 'ftp'])}://{name}.{rng.choice(['org', 'com'])}{rng.choice(['', ':80', '/a', '/a/b?c=d#e'])}"
        kind = rng.randrange(5)
        yield [(url, True), (f" {url}", False), (url.replace("://", "//"), False), (f"{url} x", False), ("no-url", False)][kind]


def test_valid_exactly_where_the_address_is(spark):
    rows = [(str(i), i, u, ok) for i, (u, ok) in enumerate(addresses(400, 3))]
    notes = spark.createDataFrame(rows, "id string, number long, url string, ok boolean")
    got = {r.number: r for r in state.note_status(notes).collect()}
    for _, i, u, ok in rows:
        assert got[i].validUrl == ok, u
        assert got[i].url == (u if ok else f"Invalid URL: {u}")


def test_host_exactly_where_the_response_is_an_address(spark):
    rows = list(addresses(400, 4))
    d = spark.createDataFrame(rows, "u string, ok boolean").select("u", "ok", host(F.col("u")).alias("h"), is_url(F.col("u")).alias("v"))
    for r in d.collect():
        assert r.v == r.ok == (r.h is not None), r.u
        assert r.h is None or r.h == r.h.lower() and ":" not in r.h


def test_upserts_are_idempotent(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(20), i, rng.choice("ab")) for i in range(200)]
    d = spark.createDataFrame(rows, "k int, at int, v string")
    newest = state.last_write(d, ["k"], "at")
    want = {k: (at, v) for k, at, v in rows}
    assert {r.k: (r["at"], r.v) for r in newest.collect()} == want
    again = state.upsert(newest, newest, ["k"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, newest.collect()))


def test_workflow(spark):
    d = spark.range(1)
    one = lambda c: d.select(c.alias("x")).first().x
    assert one(state.valid_transition(F.lit("unknown"), F.lit("processing"))) and not one(state.valid_transition(F.lit("fields:posted"), F.lit("unknown")))
    assert one(state.workflow_after(F.lit("spider:begun"), F.lit(True), F.lit(False))) == "extractor:success"
    assert one(state.workflow_after(F.lit("spider:begun"), F.lit(True), F.lit(True))) == "extractor:fail"
    assert len(state.WORKFLOW) == 10 and not one(state.is_workflow_status(F.lit("available"))) and state.CURSOR_ROLES[1] == "extract-fields"
