"""The pipeline against plain versions of its stages, on a corpus with planted cases."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline as cp

from .conftest import DOCS, prose
from .test_dedup import plain_components, plain_repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for i in range(240):
        t = prose(i, 60 + i % 50)
        if i % 6 == 0:
            t = [" ".join(f"{w}$$$ ***" for w in t.split()), " | ".join(t.split())][i // 6 % 2]
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(i % 6 > 0), 0))
    passage, item = prose(9000, 70), prose(9001, 30)
    rows += [(300 + k, rows[1 + k][1], "en", "s", 1) for k in range(3)]  # copies
    rows += [(400 + k, f"{prose(5000 + k, 40)}\n{passage}\n{prose(6000 + k, 40)}", "en", "s", 1) for k in range(4)]
    rows += [(500 + k, f"{prose(7000 + k, 50)} {item} {prose(8000 + k, 50)}", "en", "s", 1) for k in range(3)]
    rows += [(None, prose(9500, 80), None, None, None), (600, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(9999, 20))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs)
    return out


def test_stages(spark, folder):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    good, unique, cut, clean, ids = stages(spark, folder)
    for d in (good, unique, cut, clean):
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    kept = texts(good)
    assert not any(i is not None and i < 240 and i % 6 == 0 for i in kept) and all(i in kept for i in before if i is None or (i < 240 and i % 6) or 300 <= i < 600)

    heads = plain_components([(i, t) for i, t in kept.items() if i is not None], 5, 80)
    left = texts(unique)
    assert set(left) == {i for i in kept if i is None or heads[i][1] == i} and not {300, 301, 302} & set(left)

    shorter, repeats = texts(cut), plain_repeats(left.items())
    assert set(shorter) == set(left) and {i for i in left if shorter[i] != left[i]} == set(repeats) == {401, 402, 403}
    assert all(r.n_chars == len(r.text or "") for r in cut.filter("text is not null").collect())

    assert set(shorter) - set(texts(clean)) == {500, 501, 502}
    rows = ids.collect()
    assert len(rows) == clean.count()
    final = texts(clean)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256((final[r.doc_id] or "").encode()).hexdigest() and len(np.frombuffer(r.ids, "<u4")) == r.n_tokens


def test_run(spark, folder):
    one = {(r.doc_id, r.ids_sha256) for r in cp.run(spark, folder).collect()}
    assert one == {(r.doc_id, r.ids_sha256) for r in stages(spark, folder)[-1].collect()}


def test_columns_that_clash(spark, folder):
    from .conftest import with_clashes

    docs = with_clashes(spark.read.parquet(f"{folder}/documents.parquet"))
    for _, f in cp.STAGES[:-1]:
        out = f(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0


def test_odd_rows(spark, folder, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows and empty tables go through every stage but the one whose decision they are."""
    docs = odd_docs.union(odd_docs.where("doc_id = 50"))
    for _, f in cp.STAGES[:-1]:
        out = f(spark, docs, folder)
        assert out.columns == docs.columns
        none = f(spark, no_docs, folder)
        assert none.columns == no_docs.columns and none.count() == 0
    once = cp.near_dedup(spark, docs, folder).collect()
    assert sorted(str(r.doc_id) for r in once) == sorted(str(i) for i in [*range(10), 50, None, None])  # (3, one) and (50, ...) came twice
    assert cp.passage_dedup(spark, docs.drop("n_chars"), folder).columns == ["doc_id", "text", "lang", "source"]
    assert cp.encode(spark, no_docs, folder).count() == 0
