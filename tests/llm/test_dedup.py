"""Operators 3, 5 and 9 against brute force, on small documents with copies, near copies and shared passages."""

import random
from collections import defaultdict

import numpy as np
import pytest

from heronry.llm import decontamination as dc
from heronry.llm import odd_sketch as osk
from heronry.llm import suffix_dedup as sd
from heronry.llm.components import connected_components
from heronry.llm.words import WordHashes

from .conftest import DOCS, odd_rows, prose, with_clashes


def edited(text, seed, n):
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """Copies, near copies at all distances (a group of many too), shared passages, repeats inside a text."""
    rows, base = [], prose(7, 150)
    for i in range(60):
        rows.append(edited(base, i, i % 12))
    for k in range(12):
        t = prose(100 + k, 40 + 20 * k)
        rows += [t, t, edited(t, k, 1), edited(t, k + 50, 3), edited(t, k + 99, 6)]
    passage, other = prose(500, 60), prose(501, 90)
    for k in range(15):
        rows.append(f"{prose(600 + k, 30 + k)} {passage} {prose(700 + k, 20)} {other if k % 3 else ''}\n{prose(800 + k, 10)}")
    rows += [" ".join(["loop back again"] * 60), f"{prose(900, 55)}\n{prose(901, 20)}\n{prose(900, 55)}", prose(902, 49), prose(902, 49), prose(903, 50), prose(903, 50)]
    rng = random.Random(5)
    rng.shuffle(rows)
    return [(1000 + 3 * i, t, None, None, None) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "block"), [(4, 512), (5, 512), (5, 8)])
def test_near_duplicates(docs, n, block, monkeypatch):
    monkeypatch.setattr(osk, "BLOCK", block)
    monkeypatch.setattr(osk, "SKETCH_BLOCK", block)
    want = plain_components([r[:2] for r in corpus()], n, 80)
    got = osk.near_duplicates(with_clashes(docs), n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = osk.near_duplicates(with_clashes(odd_docs), 4).collect()
    assert len(got) == len(odd_rows())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[3] == [(1, 3, True)] * 2 and by[0] == by[1] == by[2][:0] + [(0, by[0][0][1], True)] or by[0] == [(0, 0, True)]
    assert sorted(by[None]) == [(0, None, True), (1, None, True)]
    assert osk.near_duplicates(no_docs, 4).count() == 0


def test_sketches_estimate(spark):
    rng = np.random.default_rng(1)
    for share in (0.95, 0.8, 0.6):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            cut = round(1000 * share * 2 / (1 + share))  # in common, so that the similarity is share
            a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:cut], pool[1000 : 2000 - cut]]))
            _, odd = osk.signatures([a, b])
            flips = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
            errors.append(osk.estimate(flips) - share)
            assert share < 0.8 or flips <= osk.most_flips(80)
        assert abs(np.mean(errors)) < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {i: find(i) for i in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_chains(spark, monkeypatch):
    """Whatever the order of ids along a chain, rounds grow as the logarithm of its length, and nothing of a round is left behind."""
    from heronry.llm.common import Workspace, release

    written, settle = [], Workspace.settle
    monkeypatch.setattr(Workspace, "settle", lambda self, df, name, *a, **b: (written.append(name), settle(self, df, name, *a, **b))[1])
    mixed = random.Random(3).sample(range(100_000, 900_000), 3000)
    chains = [list(range(10_000)), [20_000, *range(30_000, 20_000, -1)][:3000], mixed, [9 * 10**6, *range(10**6, 10**6 + 2000)]]
    edges = [e for c in chains for e in zip(c, c[1:], strict=False)] + [(10**7, 10**7 + k) for k in range(1, 500)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()))
    assert got == {i: min(c) for c in [*chains, range(10**7, 10**7 + 500)] for i in c}
    assert len([n for n in written if n.startswith("moved")]) <= 2 * np.log2(10_000)
    root = Workspace.made[-1].root
    left = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = left.getFileSystem(spark._jsc.hadoopConfiguration())
    assert [f.getPath().getName() for f in fs.listStatus(left)] == ["components"]
    release()
    assert not fs.exists(left) and not Workspace.made


def plain_repeats(rows):
    """Words of each document in a window of LEAST words that occurs before."""
    seen, out = set(), defaultdict(set)
    for i, t in sorted((i, t) for i, t in rows if i is not None and t):
        w = t.encode().split()
        for s in range(len(w) - sd.LEAST + 1):
            window = tuple(w[s : s + sd.LEAST])
            if window in seen:
                out[i] |= set(range(s, s + sd.LEAST))
            seen.add(window)
    return out


def test_repeated_passages(docs):
    want = plain_repeats([r[:2] for r in corpus()])
    got, ids = defaultdict(set), {r[0] for r in corpus()}
    for r in sd.repeated_passages(with_clashes(docs)).collect():
        assert not got[r.doc_id] & set(range(r.start_word, r.end_word)) and r.src_doc_id in ids and r.src_doc_id <= r.doc_id
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert dict(got) == want


def test_short_sharers_between_two_copies(spark):
    """Two documents share 50 words, most of them left of the anchor; many others hold the words right of it, or its first 20, in other contexts."""
    seed, at = next((k, a) for k in range(500) if (a := int(sd.owners(sd.grams(WordHashes().of(prose(7000 + k, sd.LEAST).encode().split()), sd.K))[0])) == sd.LEAST - 22)
    passage = prose(7000 + seed, sd.LEAST).split()
    rows = [(1, f"{prose(8001, 40)} {' '.join(passage[at : at + sd.K])} {prose(8002, 40)}"), *((k, f"{prose(8100 + k, 60)} {' '.join(passage)} {prose(8200 + k, 60)}") for k in (2, 3))]
    rows += [(k, f"{prose(8300 + k, 50)} {' '.join(passage[at:])} {prose(8400 + k, 50)}") for k in range(10, 40)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert marked(sd.repeated_passages(docs)) == {3: set(range(60, 110))} == dict(plain_repeats(rows))


def test_without_repeats(docs, odd_docs, no_docs):
    out = sd.without_repeats(with_clashes(docs))
    assert out.columns == with_clashes(docs).columns
    left = {r.doc_id: r.text for r in out.collect()}
    texts = {r[0]: r[1] for r in corpus()}
    # words that come together by a cut can repeat anew, but hardly do
    again = plain_repeats(left.items())
    assert sum(map(len, again.values())) <= 0.01 * sum(len(t.split()) for t in texts.values())
    whole = plain_repeats(texts.items())
    assert all(left[i] == t for i, t in texts.items() if i not in whole) and all(t.split() for t in left.values())
    kept = sd.without_repeats(with_clashes(odd_docs)).collect()
    assert len(kept) == len(odd_rows()) and sorted(str(r.text) for r in kept) == sorted(str(t) for _, t, *_ in odd_rows())
    assert sd.without_repeats(no_docs).count() == 0 and sd.repeated_passages(no_docs).count() == 0


def test_anchors_are_content_selected():
    passage, memo = prose(40, sd.LEAST).encode().split(), WordHashes(20)
    places = []
    for k in range(6):
        words = prose(50 + k, 13 * k + 5).encode().split()
        at, _ = sd.anchors(memo.of([*words, *passage, *prose(60 + k, 30).encode().split()]))
        places.append({int(a) - len(words) for a in at} & set(range(sd.W)))
    assert set.intersection(*places)
    assert len(sd.anchors(memo.of(passage[:-1]))[0]) == 0


def test_cut_words():
    assert sd.cut_words(b"  a b\nc d ", [(1, 3)]) == b"  a d " and sd.cut_words(b"a b", [(0, 2)]) == b""


def items():
    return [(k, prose(2000 + k, n)) for k, n in enumerate([3, 5, 15, 15, 30, 59, 59])] + [(90, None), (91, ""), (92, prose(2002, 15)), (None, "x y z")]


def test_decontamination(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    texts = dict(items())
    rows = [(i, f"{prose(i, 40)} {texts[k].upper() if i % 2 else texts[k]}\n{prose(i + 99, 30)}", None, None, None) for i, k in enumerate([1, 2, 3, 4, 5, 6] * 3)]
    rows += [(100, edited(texts[5], 1, 1), None, None, None), (101, edited(texts[5], 2, 9), None, None, None), (102, prose(4000, 500), None, None, None), (103, texts[4][:-40], None, None, None), (104, f"q {texts[0]} q", None, None, None)]

    def plain(text):
        out = {}
        w = text.encode().lower().split()
        for k, t in texts.items():
            v = (t or "").encode().lower().split()
            n = min(5, len(v))
            if k is None or not v:
                continue
            a = [tuple(v[i : i + n]) for i in range(len(v) - n + 1)]
            for s in range(len(w) - len(v) + 1):
                b = [tuple(w[s + i : s + i + n]) for i in range(len(v) - n + 1)]
                both = sum(min(a.count(x), b.count(x)) for x in set(a))
                if 100 * both >= 80 * (2 * len(a) - both):
                    out[k] = max(out.get(k, 0), both / (2 * len(a) - both))
        return out

    docs = spark.createDataFrame(rows, DOCS)
    got = defaultdict(dict)
    for r in dc.contaminated(with_clashes(docs), bench).collect():
        got[r.doc_id][r.item_id] = r.similarity
    want = {i: p for i, t, *_ in rows if (p := plain(t))}
    assert dict(got) == want and {100, 104} <= set(want) and 102 not in want
    clean = {r.doc_id for r in dc.decontaminated(with_clashes(docs), bench).collect()}
    assert clean == {r[0] for r in rows} - set(want)
    assert dc.contaminated(no_docs, bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0
    assert dc.decontaminated(odd_docs, bench).count() == len(odd_rows())


def test_decontamination_in_cells(spark, monkeypatch):
    """Small cells, and a bitmap that lets everything through, give the same rows."""
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{t} {prose(i, 20)} {t}", None, None, None) for i, t in items() if t] * 3, DOCS)
    rows = lambda: sorted(map(str, dc.contaminated(docs, bench).collect()))
    want = rows()
    monkeypatch.setattr(dc, "ITEMS", 1)
    monkeypatch.setattr(dc, "WINDOWS", 2)
    assert rows() == want and len(want) >= 24
    monkeypatch.setattr(dc, "bitmap", lambda keys: b"\xff" * 8192)
    assert rows() == want


def planted_repeats():
    """Passages whose first K words are first met in other contexts."""
    rows, passage, common = [], prose(3000, 60).split(), prose(3001, 40)
    rows.append(f"{prose(3002, 30)} {' '.join(passage[:47])} {prose(3003, 30)}")
    rows += [f"{prose(3100 + k, 30)} {' '.join(passage)} {prose(3200 + k, 30)}" for k in range(40)]
    for k in range(60):  # two of these share words to the left of the common ones
        rows.append(f"{prose(3300 + k, 30)} {prose(3004, 14) if k in (20, 45) else prose(3400 + k, 14)} {common} {prose(3500 + k, 40)}")
    step, line = prose(3005, 20), prose(3006, 5)  # words that come again within a window
    rows += [f"{prose(3600 + k, 40)} {' '.join(f'{step} {line} {step} {line} {step}'.split()[5:60])} {prose(3700 + k, 40)}" for k in range(6)]
    return [(i, t, None, None, None) for i, t in enumerate(rows)]


def marked(found):
    got = defaultdict(set)
    for r in found.collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    return dict(got)


def test_every_repeated_word_is_found(spark, docs):
    rows = planted_repeats()
    assert marked(sd.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(3))) == plain_repeats([r[:2] for r in rows])
    assert marked(sd.repeated_passages(docs)) == plain_repeats([r[:2] for r in corpus()])


def test_repeats_do_not_depend_on_how_rows_are_dealt(spark):
    """Of the texts with the same K words, which are many, pairs share further ones that the first text has not."""
    head = prose(4000, 40)
    rows = [(k, f"{prose(4100 + k, 35)} {head} {prose(4300 + k % 60, 12)} {prose(4400 + k, 35)}", None, None, None) for k in range(120)]
    docs, found = spark.createDataFrame(rows, DOCS), []
    skew = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    for conf in ({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "1"}, {"spark.sql.autoBroadcastJoinThreshold": "60000", "spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, skew | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        before = {k: spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            found.append(marked(sd.repeated_passages(docs.repartition(6))))
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found == [plain_repeats([r[:2] for r in rows])] * 3


def test_decontamination_of_texts_shorter_than_an_item(spark):
    item = prose(5000, 59).split()
    items = [(1, " ".join(item)), (2, " ".join([*item[:-1], "other"])), (3, " ".join(["la la tum"] * 19)), (4, prose(5001, 4)), (5, prose(5002, 6))]
    rows = [" ".join(item[: 59 - k]) for k in range(16)] + [" ".join(item[k:]) for k in range(1, 16)]
    rows += [" ".join([*item[:20], "alien", *item[21:57]]), " ".join(["la la tum"] * 17), items[4][1].rsplit(" ", 1)[0], items[3][1].rsplit(" ", 1)[0], "a", " ".join(item[2:57]).upper()]

    def similarity(v, w):
        a, b = ([tuple(x[i : i + 5]) for i in range(len(x) - 4)] or [tuple(x)] for x in (v, w))
        both = sum(min(a.count(x), b.count(x)) for x in set(a))
        return both / (len(a) + len(b) - both)

    want = {}
    for i, t in enumerate(rows):
        w = t.lower().split()
        for k, v in ((k, v.split()) for k, v in items):
            best = max(similarity(v, w[s : s + len(v)]) for s in range(max(1, len(w) - len(v) + 1)))
            if best >= 0.8:
                want[i, k] = best
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], DOCS)
    for some in (items, items[:3]):  # with short items and without, as there is a lower bound on what a text must hold
        ids = {k for k, _ in some}
        found = dc.contaminated(docs, spark.createDataFrame(some, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id): r.similarity for r in found} == {x: v for x, v in want.items() if x[1] in ids}
        assert all(r.start_word + r.n_words <= len(rows[r.doc_id].split()) for r in found)
    assert {(2, 1), (2, 2)} <= set(want) and (15, 1) not in want


def test_adjoining_repeats_keep_their_sources(spark):
    p, q = prose(6000, 60).split(), prose(6001, 70).split()
    texts = [" ".join(p), " ".join(q), " ".join(p + q), " ".join(p[:55] + p[-5:] + prose(6002, 9).split()), " ".join(p[:55] + q[-60:])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = sorted((r.doc_id, r.start_word, r.end_word, r.src_doc_id) for r in sd.repeated_passages(docs).collect())
    assert got == [(2, 0, 60, 0), (2, 60, 130, 1), (3, 0, 60, 0), (4, 0, 55, 0), (4, 55, 115, 1)]
    assert {r.doc_id: r.text for r in sd.without_repeats(docs).collect()} == {0: texts[0], 1: texts[1], 3: " ".join(prose(6002, 9).split())}


def test_many_items_under_one_id(spark):
    """Items with a common beginning, most of them under one id, and texts that many items have, are dealt by content."""
    head, texts = prose(9000, 12), [prose(9100 + k, 18) for k in range(60)]
    bench = spark.createDataFrame([(1 if k % 3 else k, f"{head} {t}") for k, t in enumerate(texts)] + [(500 + k, prose(9001, 30)) for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{prose(9200 + k, 10)} {head} {t} {prose(9300 + k, 9)}", None, None, None) for k, t in enumerate(texts)] + [(900, prose(9001, 30), None, None, None)], DOCS)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()}
    assert got == {(k, 1 if k % 3 else k) for k in range(60)} | {(900, 500 + k) for k in range(40)}


def test_elements_make_sets_of_multisets():
    rows = np.array([[5, 3, 5, 5], [1, 2, 3, 4], [7, 7, 8, 8]], np.uint64)
    out = dc.elements(rows)
    assert [len(set(r)) for r in out.tolist()] == [4, 4, 4]
    assert len(set(out[0].tolist()) & set(dc.elements(np.array([[5, 9, 5, 3]], np.uint64))[0].tolist())) == 3
