"""Operators 2, 4, 6 and 8, against plain Python or SQL, and their queries against their SQL."""

import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import regex

from heronry.llm import host_reputation as hr
from heronry.llm import license_scan as ls
from heronry.llm import quality_rules as qr
from heronry.llm import rule_ensemble as re_
from heronry.llm.queries import ORACLE_SQL, QUERIES

from .conftest import DOCS, SYLLABLES, odd_rows, prose, with_clashes
from .notices import NOTICES, PLAIN, SEVERAL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    r = con.execute(ORACLE_SQL[name])
    names = sorted(x[0] for x in r.description)
    order = [[x[0] for x in r.description].index(c) for c in names]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(repr(tuple(x[i] for i in order)) for x in r.fetchall()) == sorted(repr(tuple(x)) for x in df.select(*names).collect())


def test_registered_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


# --- 2
URLS = [
    ("http://WWW.Example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"), ("http://example.com", "example.com", "", None, None), ("x://b.net/es/1?q#f", "b.net", "/es/1", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("http://subnet/fr/", "subnet", "/fr/", None, None), ("http://x.com?y://z/", "x.com", "", None, None), (None, "", "", None, None), ("no url", "", "", None, None),
    ("://É.COM/a#b", "É.com", "/a", "com/", "allow"), ("a://b://c/d", "b:", "//c/d", None, None), ("http://www.example.com.evil.org/en/", "www.example.com.evil.org", "/en/", None, None),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: r for r in hr.judge_urls(with_clashes(pages), none).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or "block")  # nothing labelled: a half, which is above the limit
    assert hr.judge_urls(pages.limit(0), none).count() == 0


def test_reputation_shrinks(spark):
    rows = [("bad.spam.org", 1)] * 60 + [("bad.spam.org", 0)] * 5 + [("one.spam.org", 0)] + [(f"h{i % 20}.fine.org", int(i % 10 == 0)) for i in range(2000)] + [("lonely.fine.org", 1), (None, 1), ("x.org", None)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    hosts = spark.createDataFrame([("bad.spam.org",), ("one.spam.org",), ("new.spam.org",), ("lonely.fine.org",), ("new.fine.org",), ("x.new.de",), ("h1.fine.org",)], "host string")
    known = hosts.union(outcomes.select("host").dropna())
    got = {r.host: r for r in hr.host_posteriors(known, outcomes).collect()}
    assert got["bad.spam.org"].bound > 0.5 > got["h1.fine.org"].mean
    assert got["lonely.fine.org"].mean < 0.5  # one page doesn't make a host
    assert got["new.spam.org"].mean > got["x.new.de"].mean > got["new.fine.org"].mean
    assert got["one.spam.org"].mean < got["new.spam.org"].mean and all(0 <= r.mean <= 1 for r in got.values())


def test_domains(spark):
    d = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "a.b.com", "com", "", "co.uk", "x.y.gov.uk:8080", "me.github.io", "a.com.mx", "192.0.2.7:80", "192.0.2.8", "[2001:db8::1]:80", "a.example.com:443")], "h string")
    got = {r.h: (r.d, r.s) for r in d.select("h", hr.domain_of(d.h).alias("d"), hr.suffix_of(d.h).alias("s")).collect()}
    assert got["a.b.co.uk"] == ("b.co.uk", "co.uk") == got["b.co.uk"] and got["a.b.com"] == ("b.com", "com") and got["com"] == ("com", "com") and got[""] == ("", "")
    assert got["x.y.gov.uk:8080"] == ("y.gov.uk", "gov.uk") and got["me.github.io"] == ("me.github.io", "github.io") and got["a.com.mx"] == ("a.com.mx", "com.mx") and got["a.example.com:443"] == ("example.com", "com")
    assert got["192.0.2.7:80"] == ("192.0.2.7", "") and got["192.0.2.8"] == ("192.0.2.8", "") and got["[2001:db8::1]:80"] == ("[2001:db8::1]", "")


def test_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/7.html"), (2, "http://a.b/x"), (3, None), (4, "http://a.b/8"), (5, "http://c.d/9")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0), (8, 1, 0), (9, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, hr.outcomes_from_labels(pages, labels).collect())) == [("a.b", 0), ("a.b", 1)]


# --- 4
def plain_scan(model, text):
    """Rows of a text, scored paragraph by paragraph without any gate."""
    fits = {f: [set(x) for x in ts] for f, ts in ls.templates().items()}
    out = []
    for k, block in enumerate(regex.split(ls.PARAGRAPH_END, text or "")):
        words = ls.words_of(block)
        for start in range(0, max(1, len(words) - ls.LONGEST // 2), ls.LONGEST // 2):
            piece = words[start : start + ls.LONGEST]
            p, found = model.scores(piece), ls.features(piece)
            best = int(p.argmax())
            if best == len(p) - 1:
                continue
            name, kept = [*model.families, "unlisted"][best], ls.families(model, piece, 0.6, 0.6)
            own = max((len(found & t) / len(t) for t in fits.get(name, [])), default=0.0)
            out += [(k, start, f, f, round(float(q), 5), round(share, 5)) for f, (q, share) in kept.items()]
            if not kept and (p[best] >= 0.6 or own >= 0.6 or (name == "unlisted" and 1 - p[-1] >= 0.95)):
                out.append((k, start, "unknown", name, round(float(p[best]), 5), round(own, 5)))
    return sorted(out)


def scanned(docs):
    got = defaultdict(list)
    for r in ls.scan_licenses(docs).collect():
        got[r.doc_id].append((r.paragraph, r.start_word, r.family, r.predicted, round(r.probability, 5), round(r.template_share, 5)))
    return {i: sorted(rows) for i, rows in got.items()}


def near(a, b):
    return [x[:4] for x in a] == [x[:4] for x in b] and np.allclose([x[4:] for x in a], [x[4:] for x in b], atol=3e-5)


def test_license_scan(spark, odd_docs, no_docs):
    model = ls.train()
    texts = [f"{prose(k, 30)}.\n{t}\n\n{prose(k + 500, 40)}" for k, (_, t) in enumerate(NOTICES)] + [f"{prose(k, 20)}\n * \n{t}\n" for k, t in enumerate(PLAIN)]
    texts += [f"{prose(k, 9)}.\n{t}" for k, (_, t) in enumerate(SEVERAL)]
    texts += [prose(3, 900) + " Licensed under CC BY-NC 4.0 " + prose(4, 900), "a.\n" * 3 + "Licensed under the Frobnicate License", None, "", "no such word", "\n\n1\n\n"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got, want = scanned(with_clashes(docs)), {i: rows for i, t in enumerate(texts) if (rows := plain_scan(model, t))}
    assert got.keys() == want.keys() and all(near(got[i], want[i]) for i in want)  # the gate drops nothing, SQL and plain Python agree
    n = len(NOTICES) + len(PLAIN) + len(SEVERAL)
    assert {r[2] for r in got[n]} == {"cc-by-nc"} and [r[:3:2] for r in got[n + 1]] == [(3, "unknown")]
    assert ls.scan_licenses(no_docs).count() == 0 and ls.scan_licenses(with_clashes(odd_docs)).count() == 0
    twice = scanned(docs.union(docs))
    assert all(sorted(2 * got[i]) == twice[i] for i in got)


def test_licenses_of_unseen_notices():
    """Recall and precision on notices none of which is a template, and on text without a licence."""
    model = ls.train()
    families = lambda t: {r[2] for r in plain_scan(model, t)}
    found = [f in families(t) for f, t in NOTICES]
    wrong = [families(t) - {f, "unknown"} for f, t in NOTICES] + [families(t) - {"unknown"} for t in PLAIN]
    assert np.mean(found) >= 0.95 and not any(wrong) and sum(bool(families(t)) for t in PLAIN) <= 2
    assert [(t, families(t)) for fs, t in SEVERAL if families(t) != fs] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_license_query_on_whole_tables(spark):
    model = ls.train()
    want = {i: rows for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall() if (rows := plain_scan(model, t))}
    got = scanned(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got.keys() == want.keys() and all(near(got[i], want[i]) for i in want)


def test_license_gate_follows_from_the_weights():
    model = ls.train()
    rest = [np.array(w) for f, w in model.weights.items() if not set(f.split()) & set(model.gate)]
    margin = sum(np.maximum(w[:-1] - w[-1], 0) for w in rest) + np.array(model.bias[:-1]) - model.bias[-1]
    assert (margin < 0).all() and not ls.STOP & set(model.gate)


# --- 6
def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def rule_texts():
    line = prose(1, 10)
    return [*(r[1] for r in odd_rows() if not r[1] or len(r[1]) < 10_000), " ".join(["loop"] * 30), f"{line}\n{prose(2, 30)}\n{line}\n{line}", prose(3, 19), prose(3, 20), "# * | <> $ %& " * 9, " ".join("abcdefgh" * 2 + "xyz" + "abcdefghi"), "é " * 25, " a\x0bb\x0cc\r\n d" * 7, "x " * 6]


def test_quality_rules(spark, no_docs):
    texts = rule_texts()
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    rows = qr.quality_rules(with_clashes(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), texts[r.doc_id]
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and (not r.base_failed or not r.kept)
    assert qr.quality_rules(no_docs).count() == 0


def test_rule_ties_pass(spark):
    d = spark.createDataFrame([(15, 100), (16, 100), (0, 0)], "n_symbols long, n_words long")
    assert [r.f for r in d.select(qr.failed((qr.Rule("x", "n_symbols", "n_words", 15),)).alias("f")).collect()] == [False, True, False]


# --- 8
def labelled(spark):
    import random

    rng, rows, labels = random.Random(4), [], []
    for i in range(900):
        good = i % 4 > 0
        t = prose(i, 30 + i % 90)
        if not good:
            t = [" ".join(f"{w}$$$ ***" for w in t.split()), " | ".join(t.split()), " ".join(w for w in t.split()[:20] for _ in range(5))][i % 3]
        rows.append((i, t, None, None, None))
        if rng.random() < 0.8:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (5000, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")


def test_rule_ensemble(spark, odd_docs, no_docs):
    docs, labels = labelled(spark)
    model = re_.train(docs, labels)
    assert 0 < len(model.rules) < 120  # sparse
    rows = re_.classify(with_clashes(docs), model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.97
    stats = {r[0]: r[1:] for r in re_.statistics(docs).select("doc_id", *re_.STATISTICS).collect()}
    x = np.array([stats[r.doc_id] for r in rows])
    assert np.allclose(model.of(x), [r.score for r in rows])  # the compiled column and the plain model agree
    odd = re_.classify(with_clashes(odd_docs), model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    assert re_.classify(no_docs, model).count() == 0
    kept = re_.keep_good(with_clashes(docs), model, 0.5)
    assert kept.columns == with_clashes(docs).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= 0.5}


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    assert re_.train(docs, labels) == re_.train(docs, flipped)


def test_fit_without_rows(spark, no_docs):
    model = re_.train(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert model.rules == () and model.intercept == 0.0


def test_lasso_is_sparse():
    rng = np.random.default_rng(0)
    z = (rng.random((500, 30)) < 0.5).astype(float)
    y = (z[:, 0] + z[:, 1] > 1).astype(float)
    _, w = re_.lasso_logistic(z, y, 0.02)
    assert set(np.flatnonzero(w)) <= {0, 1} and (w[:2] > 0).all() and len(SYLLABLES)
