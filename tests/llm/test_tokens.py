"""Operators 1, 7 and 10 against their libraries."""

import base64
import hashlib
import io
import random
import struct
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
import zstandard

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronry.llm.byte_bpe import encode_documents, load_bpe
from heronry.llm.token_counts import load_tokenizer, spliced_ids, token_counts
from heronry.llm.token_store import SEEK_MAGIC, ShardReader, layout, seek_table, shard_of, store_and_read, write_tokens
from heronry.llm.word_memo import WordIds

from .conftest import DOCS, odd_rows, prose, with_clashes

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(st.sampled_from("ab cdÉé'st <|endoftext|>\n\t12²½!#́\xa0\x85\x00 ﬁİΣ漢▁😀"), max_size=80)


@pytest.fixture(scope="module")
def library():
    return load_tokenizer(WORD)


@lru_cache(maxsize=1)
def tiktoken_of(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(4, 30), st.integers(2, 8))
def test_splices_equal_the_whole(text, window, overlap):
    t = load_tokenizer(WORD)
    assert spliced_ids(t, text, window, overlap) == t.encode(text, add_special_tokens=False).ids


def test_splices_without_any_space(library):
    text = "".join(random.Random(3).choice("abc1!é") for _ in range(3000))
    assert spliced_ids(library, text, 64, 8) == library.encode(text, add_special_tokens=False).ids
    long = prose(5, 20_000)
    assert spliced_ids(library, long) == library.encode(long, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_memo_equals_the_library(text):
    t = load_tokenizer(WORD)
    assert np.frombuffer(WordIds(t, most=50).encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, odd_docs, no_docs, library):
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in odd_rows() if i is not None)
    got = token_counts(with_clashes(odd_docs), WORD, over=100).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got if r.doc_id is not None) == want
    assert len(got) == len(odd_rows()) and all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts(no_docs, WORD).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_equals_tiktoken(text):
    bpe = load_bpe(RANKS, P.PATTERN)
    ids = bpe.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == tiktoken_of(RANKS).encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_every_entry_is_reached_or_listed():
    bpe = load_bpe(RANKS, P.PATTERN)
    assert len(bpe.tokens) == 50_256 and len(bpe.whole) == 0


def test_bpe_documents(spark, odd_docs, no_docs):
    got = encode_documents(with_clashes(odd_docs), RANKS, P.PATTERN, keep_ids=True).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        texts = [t or "" for i, t, *_ in odd_rows() if i == r.doc_id]
        assert hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens
        assert any(np.frombuffer(r.ids, "<u4").tolist() == tiktoken_of(RANKS).encode_ordinary(t) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert encode_documents(no_docs, RANKS, P.PATTERN).count() == 0


def test_store_round_trip(spark, odd_docs, no_docs, library):
    got = store_and_read(with_clashes(odd_docs), WORD).collect()
    want, start = [], 0
    for i, t in sorted(((i, t) for i, t, *_ in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert at == start and [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [w[0] for w in want]
    assert store_and_read(no_docs, WORD).count() == 0


def test_files_are_seekable_zstandard(spark, tmp_path, library):
    docs = spark.createDataFrame([(i, prose(i, 50), None, None, None) for i in range(40)], DOCS)
    files = write_tokens(docs, WORD, f"file://{tmp_path}", shards=3).collect()
    assert sum(f.n_docs for f in files) == 40 and len(files) > 1
    data = open(files[0].path, "rb").read()
    n = struct.unpack("<I", data[-9:-5])[0]
    assert n == files[0].n_docs and struct.unpack("<I", data[-9 - 12 * n - 8 :][:4])[0] == SEEK_MAGIC
    reader = ShardReader(io.BytesIO(data))
    k = n // 2
    assert np.frombuffer(reader.document(k), "<u4").tolist() == [*library.encode(prose(reader.doc_ids[k], 50), add_special_tokens=False).ids, 1]
    size, plain, check = map(int, reader.table[k])
    alone = zstandard.ZstdDecompressor().decompress(data[reader.offsets[k] : reader.offsets[k] + size])
    assert len(alone) == plain and xxhash.xxh64_intdigest(alone) & 0xFFFFFFFF == check
    broken = bytearray(data)
    broken[reader.offsets[k] + size - 1] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        ShardReader(io.BytesIO(bytes(broken))).document(k)
    with pytest.raises(ValueError):
        ShardReader(io.BytesIO(seek_table(np.zeros((0, 3))) + b"x"))


def test_shard_of(spark):
    bounds = [3, 5, 5 + 2, 20, 21]
    rows = spark.range(25)
    got = {r.id: r.s for r in rows.select("id", shard_of(rows.id, bounds).alias("s")).collect()}
    assert got == {i: sum(b < i for b in bounds) for i in range(25)}


def test_shards_follow_the_bytes(spark, tmp_path):
    spark.range(2000).selectExpr("id as doc_id", "repeat('word ', case when id < 100 then 4000 else 100 end) as text").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    plain = layout(docs, 100_000)
    per_shard = docs.groupBy(plain.place(docs.doc_id, docs.text).alias("s")).agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("n")).collect()
    total = sum(r.b for r in per_shard)
    assert plain.shards == len(per_shard) > 15 and max(r.b for r in per_shard) < 3 * total / len(per_shard) and min(r.n for r in per_shard) < 20 < max(r.n for r in per_shard)
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id").join(docs.select("doc_id"), "doc_id").select("doc_id", "text")
    assert layout(joined, 100_000).shards == plain.shards  # whatever the optimizer expects of a join
    assert layout(docs, 10**12).shards <= 3 * spark.sparkContext.defaultParallelism and layout(docs.limit(2), 1).shards <= 2 and layout(docs.limit(0), 10).shards == 1


def test_an_id_with_many_rows_has_several_shards(spark):
    rows = [(7, f"text {k} " * 50) for k in range(300)] + [(k, "short") for k in range(20)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = layout(docs, 10_000)
    at = docs.select("doc_id", parts.place(docs.doc_id, docs.text).alias("s")).collect()
    hot, below, above = ({r.s for r in at if test(r.doc_id)} for test in (lambda i: i == 7, lambda i: i is None or i < 7, lambda i: i is not None and i > 7))
    assert len(hot) > 8 and max(below) < min(hot) and max(hot) < min(above) and max(above) < parts.shards
    tokenizer = load_tokenizer(WORD)
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in store_and_read(docs, WORD).collect())
    assert [r[0] for r in got] == [sum(x[1] for x in got[:i]) for i in range(len(got))] and [r[2] for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert sum(r[1] for r in got) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_other_tokenizers_are_asked_themselves(spark, odd_docs):
    """The memo's split stands for one kind of tokenizer only; with another, texts of any length go to the library."""
    path = P.path("byte_bpe_50k.json")
    tokenizer = load_tokenizer(path)
    got = [(r.doc_id, r.n_tokens) for r in token_counts(odd_docs, path).collect()]
    assert sorted(map(str, got)) == sorted(str((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids))) for i, t, *_ in odd_rows())
