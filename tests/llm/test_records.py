"""Operators 11, 12 and 13 against brute force, with nulls, ties, repeated rows, hot groups and empty tables."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import prefix_trie as pt
from heronry.llm import warc
from heronry.llm import whitening as wh
from heronry.llm.common import Workspace
from heronry.operators import ranges

from .conftest import prose, with_clashes

# --- 11
PAGES = "page_id long, url string, html string"


def pages():
    rows = [(k, f"http://h{k % 3}.org/{k}", f"<p>{prose(k % 20, 30)} ü 漢</p>") for k in range(60)]
    rows += [(100 + k, "http://hot.org/a b\r\nX: y", "hot") for k in range(40)] + [(139, "http://hot.org/a b\r\nX: y", "hot")] * 5
    rows += [(200, None, None), (201, "u", ""), (None, "u", "only null"), (None, "v", "only null"), (None, "u", "hot"), (202, "big", prose(9, 40_000)), (202, "big", prose(9, 40_000)), (203, "x", "one"), (204, "x", "one"), (204, "y", "one")]
    return rows


def folder(spark):
    return "file://" + Workspace(spark, "test").root.removeprefix("file:")


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    rows = pages()
    d = with_clashes(spark.createDataFrame(rows, PAGES).repartition(4).withColumnRenamed("html", "own_html")).drop("html").withColumnRenamed("own_html", "html")
    place = folder(spark)
    index = warc.write_warc(d, place, least=least, file_bytes=20_000)
    got = warc.read_warc(index, place).collect()
    groups = defaultdict(list)
    for page, url, html in rows:
        groups[html or ""].append((page is not None, page or 0, url is not None, url or ""))
    want = []
    for html, own in groups.items():
        raw = html.encode()
        digest, most = base64.b32encode(hashlib.sha1(raw).digest()).decode(), max(own)
        for k, (there, page, _, _) in enumerate(sorted(own, reverse=True)):
            first = len(raw) < least or k == 0
            to = None if first or not most[0] else most[1]
            want.append((page if there else None, len(raw), digest, "response" if first else "revisit", to, raw if first else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got)
    assert {r.url for r in got if r.page_id == 139} == {"http://hot.org/a%20b%0D%0AX:%20y"}  # no header is slipped in
    # the archives are plain WARC: gzip members one after another, and ids that are told once
    files = sorted(Path(place.removeprefix("file://")).glob("*.warc.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    ids = [x for x in text.split(b"\r\n") if x.startswith(b"WARC-Record-ID")]
    assert len(files) > 2 and len(ids) == len(set(ids)) == len(rows) + len(files) and b"\r\nX: y" not in text
    responses = {x.split(b": ")[1] for x in text.split(b"\r\n") if x.startswith(b"WARC-Record-ID")}
    assert {x.split(b": ")[1] for x in text.split(b"\r\n") if x.startswith(b"WARC-Refers-To: ")} <= responses


def test_selected_records_are_read_by_coalesced_ranges(spark):
    place = folder(spark)
    d = spark.createDataFrame([(k, f"http://a/{k}", prose(k, 50)) for k in range(200)], PAGES).coalesce(1)
    index = warc.write_warc(d, place)
    some = index.where("page_id between 10 and 19 or page_id in (50, 52, 199)")
    assert {(r.page_id, bytes(r.payload).decode()) for r in warc.read_warc(some, place, gap=0).collect()} == {(k, prose(k, 50)) for k in (*range(10, 20), 50, 52, 199)}
    length = index.agg(F.avg("length")).first()[0]
    count = lambda gap, most=warc.RANGE: warc.byte_ranges(some, gap, most).count()
    assert count(10**9) == 1 and count(0) >= count(int(2.5 * length)) and count(10**9, int(3 * length)) > 3
    assert all(r.stop - r.start <= sum(p.length for p in r.places) for r in warc.byte_ranges(some, 0).collect())  # nothing that wasn't asked for
    assert warc.read_warc(some.union(some), place).count() == 13 and warc.read_warc(index.limit(0), place).count() == 0


def test_damaged_records_are_errors(spark):
    whole = warc.record("response", {"WARC-Payload-Digest": "sha1:X", "Page-ID": None}, b"HTTP/1.1 200 OK\r\n\r\nbody")
    fields, block = warc.parsed(whole)
    assert block.endswith(b"body") and "Page-ID" not in fields
    for bad in (whole[:-1], whole[:-6], whole.replace(b"WARC/1.1", b"WARC/0.9"), b""):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    place = folder(spark)
    index = warc.write_warc(spark.createDataFrame([(1, "u", "some payload")], PAGES), place)
    with pytest.raises(Exception, match="payload of|damaged|incorrect|Error"):
        warc.read_warc(index.withColumn("length", F.col("length") - 9), place).collect()
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


# --- 12
EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def plain_whitening(rows, most):
    vectors = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and len(v)]
    fit = np.array(sorted({tuple(x) for _, x in vectors}))
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    e, u = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:most]
    order = order[e[order] > 1e-9 * e.max()]
    return {(i, k + 1): (n, int(sum(int(n * a - s) ** 2 for a, s in zip(x.tolist(), sums.tolist(), strict=True))), float((x - sums / n) @ u[:, j] / np.sqrt(e[j])), e[j] / e.sum()) for i, x in vectors for k, j in enumerate(order)}


def same_whitening(got, want):
    rows = {(r.vec_id, r.component): r for r in got}
    assert rows.keys() == want.keys()
    for k in {c for _, c in want}:
        a, b = (np.array([x for key, x in sorted(d.items()) if key[1] == k]) for d in ({key: r.whitened for key, r in rows.items()}, {key: w[2] for key, w in want.items()}))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert all((r.n, r.deviation) == want[key][:2] and abs(r.explained / want[key][3] - 1) < 1e-9 and r.identity_error < 1e-9 for key, r in rows.items())


@pytest.mark.parametrize("block", [4096, 7])
def test_whitening(spark, block, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK", block)
    monkeypatch.setattr(wh, "FAN", 2)
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(12, 12)) * np.geomspace(3, 0.05, 12)
    rows = [(k, (rng.normal(size=12) @ mix).astype(np.float32).tolist()) for k in range(150)]
    rows += [(1000 + k, rows[3][1]) for k in range(80)] + [(5, rows[7][1])]  # a common vector, and an id of two vectors
    odd = [(2000, None), (2001, [*rows[0][1][:-1], None]), (2002, [*rows[0][1][:-1], float("nan")]), (2003, [*rows[0][1][:-1], float("inf")]), (2004, []), (2005, [1.0])]
    d = spark.createDataFrame([(i, v, None) for i, v in rows[:-1] + odd], EMBEDDINGS).repartition(6)
    same_whitening(wh.whitened(with_clashes(d)).collect(), plain_whitening(rows[:-1], 4))
    twice = wh.whitened(d.union(d.where("vec_id < 10"))).collect()
    assert len(twice) == 4 * (len(rows) - 1 + 10)


def test_whitening_of_few_vectors(spark):
    d = lambda vs: spark.createDataFrame([(k, v, 0) for k, v in enumerate(vs)], EMBEDDINGS)
    assert wh.whitened(d([])).count() == 0 and wh.whitened(d([[1.0, 2.0]] * 5)).count() == 0
    line = [[float(k), 2.0 * k, -1.0] for k in range(6)]  # one direction only
    got = wh.whitened(d(line)).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    same_whitening(got, plain_whitening(list(enumerate(line)), 4))
    assert {r.component for r in wh.whitened(d([[0.5, 1.0], [2.0, -1.0], [0.25, 3.0]])).collect()} == {1, 2}
    with pytest.raises(Exception, match="64 bits|too large"):
        wh.whitened(d([[1e15, 1.0], [-1e15, 2.0]])).collect()


def test_jacobi_is_accurate_for_small_deviations():
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 16):
        u, v = (np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(2))
        sizes = np.geomspace(1, 1e-7, d)
        components, found = wh.jacobi((u * sizes) @ v.T)
        assert np.abs(found / sizes - 1).max() < 1e-8 and np.abs(components @ components.T - np.eye(d)).max() < 1e-13
        assert np.abs(np.abs((components @ v).diagonal()) - 1).max() < 1e-7
    assert wh.jacobi(np.zeros((2, 3)))[1].tolist() == [0, 0, 0]
    assert wh.folded(iter([])) is None


# --- 13
TURNS = "conv_id long, turn int, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for k in range(len(seq) + 1):
            members[tuple(seq[:k])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    for node, cs in members.items():
        subtree, todo = [], [node]
        while todo:
            subtree.append(x := todo.pop())
            todo += children[x]
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in subtree if x)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), sum(not children[x] for x in subtree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(8)
    rows = []
    for c in range(-7, 120):
        for t in range(rng.choice([0, 1, 2, 3, 8, 12])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", rng.choice(["hi", "ü", "so", ""]) if t < 9 else f"x{rng.randrange(3)}"))
    rows += [(c, t, "user", "hi") for c in range(1000, 1060) for t in range(4)]  # a common conversation
    rows += [(2000 + k, t, "user", f"t{t}" if t < 60 or k == 0 else f"own{k}") for k in range(3) for t in range(75)]
    rows += [(3000, None, None, "null first"), (3000, 1, "user", None), (3000, -1, None, None), (None, 1, "user", "no id"), (3005, 0, "a", "b:c"), (3006, 0, "a:b", "c")]
    rng.shuffle(rows)
    return rows


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("hot", [10_000, 30])
def test_prefix_trie(spark, hot, monkeypatch):
    monkeypatch.setattr(ranges, "HOT", hot)
    monkeypatch.setattr(ranges, "ROWS", max(8, hot // 3))
    monkeypatch.setattr(pt, "PIECE_BITS", 3)
    rows = conversations()
    got = pt.rebuilt_trie(with_clashes(spark.createDataFrame(rows, TURNS).repartition(5))).select(*TRIE).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)


def test_prefix_trie_of_little(spark):
    d = lambda rows: spark.createDataFrame(rows, TURNS)
    assert pt.rebuilt_trie(d([])).count() == 0 and pt.rebuilt_trie(d([(None, 1, "a", "b")])).count() == 0
    for rows in ([(5, 0, "user", "x")], [(1, 0, "user", "x")], [(7, 0, None, None), (8, 0, None, None)]):
        assert sorted(map(tuple, pt.rebuilt_trie(d(rows)).select(*TRIE).collect()), key=repr) == plain_trie(rows)


def test_repeated_and_tied_turns_have_one_order(spark):
    rows = [(1, 0, "user", t) for t in "abcab"] + [(2, 0, "user", t) for t in "bacba"]
    turns = lambda rs: sorted((r.conv_id, r.pos, bytes(r.letter)) for r in pt.ordered_turns(spark.createDataFrame(rs, TURNS).repartition(3)).collect())
    found = turns(rows)
    assert found == turns(rows[::-1]) and [x[2] for x in found[:5]] == [x[2] for x in found[5:]] and [x[1] for x in found] == [*range(5)] * 2


def test_names_are_dense(spark):
    d = spark.range(500).select((F.col("id") % 90).alias("a"), (F.col("id") % 7).alias("b")).repartition(6)
    names = pt.dense_names(Workspace(spark, "names"), d, ["a", "b"], "n").collect()
    assert sorted(r.name for r in names) == list(range(len(names))) and len({(r.a, r.b) for r in names}) == len(names)
