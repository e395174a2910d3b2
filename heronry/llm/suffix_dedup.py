"""Repeated passages by a sparse suffix array: suffixes at minimisers, sorted, compared with their neighbours, and extended right and left.

1. Suffixes are retained only where the hash of their first ``K`` words is the least in a window of ``W`` neighbours.  W + K - 1 =
   ``LEAST``: each passage of LEAST words has one such place, its anchor, chosen by its own words alone.  A suffix stands for the
   passages that it is the anchor of, which start one word after another; they are its reach.
2. Suffixes whose first K words occur nowhere else are dropped.
3. The others are sorted by these words, then by their reach, then by place.  A suffix with the reach of its neighbour before it is a repeat of the first one in that run, whole.
4. The first suffix of each run, where the same K words have other reaches too, is compared word by word.  Sorted by their words to the right, neighbours' longest
   common prefixes part the suffixes into intervals that agree in so many words; sorted by their words to the left, from the suffix backwards, they give those that agree so far to the
   left.  A passage is an interval of each, l words to the left and LEAST - l to the right: of all suffixes in both the first has it first, in the others it is a repeat.
   Every shared passage is covered so, also one that neighbours in one order alone don't share.
5. A document's repeats of one source are merged.

Sorted suffixes are cut into ranges where the same K words are common, and what neighbours carry on goes over the cuts (see ``heronry.operators.ranges``), so the result does
not depend on how rows are dealt, and no group is gathered in one task.
Words are runs without ASCII white space, compared by case.  Order is by (doc_id, position): of equal passages the first one stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import Workspace, arrow_map, by_bytes, fresh, pieces
from heronry.llm.words import STEP, WordHashes, grams, mixed
from heronry.operators.ranges import Ranges

K, W = 20, 31
LEAST = K + W - 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_U = np.uint64


def owners(first: np.ndarray) -> np.ndarray:
    """The anchor of each passage of LEAST words, from the hashes of all K words; these never go back."""
    view = np.lib.stride_tricks.sliding_window_view(first, W)
    return np.concatenate([view[lo : lo + 8192].argmin(axis=1) + np.arange(lo, min(lo + 8192, len(view))) for lo in range(0, len(view), 8192)])


def passages(first: np.ndarray) -> np.ndarray:
    """A hash of each passage of LEAST words, from those of the K words at its start, after these, and at its end."""
    n = len(first) - W + 1
    return mixed(mixed(first[:n] * STEP + first[K : K + n]) * STEP + first[LEAST - K : LEAST - K + n])


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hash of K words there) of the retained suffixes; none in texts of fewer than LEAST words."""
    if len(hashes) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = grams(hashes, K)
    at = np.unique(owners(first))
    return at, first[at]


def periodic(hashes: np.ndarray, at: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
    """Repeats where the same K words start again less than W words on: of the text itself, shifted by their period; found here, exactly."""
    order = np.lexsort((at, h))
    p, g = at[order], h[order]
    goes_on = (g[1:] == g[:-1]) & (p[1:] - p[:-1] < W)
    gap, where, spans = (p[1:] - p[:-1])[goes_on], p[:-1][goes_on], set()
    for d in np.unique(gap).tolist():
        breaks = np.concatenate([[-1], np.flatnonzero(hashes[d:] != hashes[:-d]), [len(hashes) - d]])
        k = np.unique(np.searchsorted(breaks, where[gap == d]))
        spans |= {(int(a) + 1 + d, int(b) + d) for a, b in zip(breaks[k - 1], breaks[k], strict=True) if b - a - 1 >= LEAST}
    return sorted(spans)


def reaches(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(hash of K words, hash of the reach, its first word, its end, the suffix's own place) of the retained suffixes, and the text's repeats of itself.

    Suffixes with all their passages inside one such repeat go: the same passages are retained where they first occur in the text.
    """
    first = grams(hashes, K)
    owner = owners(first)
    at = np.unique(owner)
    low, high = np.searchsorted(owner, at), np.searchsorted(owner, at, "right") - 1
    own = periodic(hashes, at, first[at])
    if own:
        inside = np.zeros(len(owner), bool)
        for a, b in own:
            inside[a : b - LEAST + 1] = True
        new = np.concatenate([[0], np.cumsum(~inside)])
        some = new[high + 1] > new[low]
        at, low, high = at[some], low[some], high[some]
    whole = passages(first)
    reach = mixed(mixed(whole[low] * STEP + whole[high]) * STEP + (high - low).astype(_U))
    return first[at], reach, low, high + LEAST, at, own


def signature(text: bytes) -> int:
    """Spark's xxhash64 of the text."""
    value = xxhash.xxh64_intdigest(text, seed=42)
    return value - (1 << 64) if value >> 63 else value


def find_anchors(docs: DataFrame) -> DataFrame:
    """(h, reach, doc_id, sig, start, end, at, inside): a retained suffix's reach; or a repeat of a text inside itself, without h and reach.

    sig is a hash of the text.
    """

    def make():
        memo = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, columns = batch.column(0).to_numpy(zero_copy_only=False), [[] for _ in range(8)]
            for first, texts in pieces(batch.column(1)):
                for i, text in enumerate(texts, first):
                    words = text.split()
                    if len(words) < LEAST:
                        continue
                    h, reach, start, end, at, own = reaches(memo.of(words))
                    a, b = np.array(own, np.int64).reshape(-1, 2).T
                    n, none = len(h) + len(own), np.zeros(len(own), np.int64)
                    values = ([h.view(np.int64), none], [reach.view(np.int64), none], [np.full(n, ids[i], np.int64)], [np.full(n, signature(text), np.int64)], [start, a], [end, b], [at, a], [np.zeros(len(h), bool), none == 0])
                    for c, v in zip(columns, values, strict=True):
                        c += v
            if not columns[0]:
                return None
            kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, bool)
            return pa.record_batch([pa.array(np.concatenate(c).astype(t)) for c, t in zip(columns, kinds, strict=True)], ["h", "reach", "doc_id", "sig", "start", "end", "at", "inside"])

        return step

    return arrow_map(by_bytes(docs.select("doc_id", "text")), make, "h long, reach long, doc_id long, sig long, start int, end int, at int, inside boolean")


def contexts(docs: DataFrame) -> DataFrame:
    """(h, doc_id, sig, at, start, end, right, left): the word hashes of suffixes as far as their reach goes, ``left`` backwards; from (doc_id, sig, text, found array<struct<h, at, start, end>>)."""

    def make():
        memo = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, sigs = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "sig"))
            offsets, found = batch.column("found").offsets.to_numpy(), batch.column("found").values
            h, at, low, end = (found.field(n).to_numpy(zero_copy_only=False) for n in ("h", "at", "start", "end"))
            right, left, order = [], [], []
            for first, texts in pieces(batch.column("text")):
                for i, text in enumerate(texts, first):
                    hashes = memo.of(text.split()).view(np.int64)
                    for k in range(offsets[i], offsets[i + 1]):
                        right.append(hashes[at[k] : end[k]])
                        left.append(hashes[low[k] : at[k]][::-1])
                        order.append((i, k))
            rows, own = np.array(order, np.int64).reshape(-1, 2).T
            columns = [h[own], ids[rows], sigs[rows], at[own], low[own], end[own]]
            return pa.record_batch([*map(pa.array, columns), *(pa.array(c, pa.list_(pa.int64())) for c in (right, left))], ["h", "doc_id", "sig", "at", "start", "end", "right", "left"])

        return step

    return arrow_map(by_bytes(docs.select("doc_id", "sig", "text", "found")), make, "h long, doc_id long, sig long, at int, start int, end int, right array<long>, left array<long>")


def common_prefix(a: Column, b: Column) -> Column:
    """How many words the two begin with alike; 0 if one is null."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.coalesce(F.when(other == 0, F.size(a)).otherwise(other - 1), F.lit(0))


def intervals(rows: DataFrame, words: str, lengths: range, name: str) -> DataFrame:
    """``rows`` with array ``name``: for each length the interval of the suffixes sorted by ``words`` that agree in so many of them, as the number of its first row.

    A suffix and its neighbour are in one interval for all lengths up to that of their common prefix.  Numbers are unique within h.
    """
    ranges = Ranges(rows, ["h"], [words, "doc_id", "at"], hot=1000)
    w = ranges.window()
    d = ranges.rows.withColumns({"_k": F.row_number().over(w), "_before": F.lag(words).over(w)})
    d = ranges.with_carried(d, [F.max_by(words, "_k").alias("_last")], {"_neighbour": F.last("_last")})
    d = d.withColumn("_same", common_prefix(F.col(words), F.coalesce("_before", "_neighbour"))).withColumn("_k", F.col("_range").cast("long") * (1 << 40) + F.col("_k")).drop("_before", "_neighbour")
    begun = {n: F.max(F.when(F.col("_same") < n, F.col("_k"))) for n in lengths}
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = d.withColumns({f"_b{n}": c.over(so_far) for n, c in begun.items()})
    own = ranges.with_carried(own, [F.max(f"_b{n}").alias(f"_t{n}") for n in lengths], {f"_c{n}": F.max(f"_t{n}") for n in lengths})
    firsts = F.array(*(F.coalesce(f"_b{n}", f"_c{n}", F.lit(0)).cast("long") for n in lengths))
    return own.select(*rows.columns, firsts.alias(name))


def shared_passages(suffixes: DataFrame, work: Workspace) -> DataFrame:
    """(h, n_left, to_right, to_left, doc_id, sig, start): the passages of suffixes with contexts; passages are equal where the first four are."""
    rows = intervals(suffixes, "right", range(K, LEAST + 1), "to_right").drop("right")
    rows = work.settle(rows, "to_right")
    rows = intervals(rows, "left", range(W), "to_left").drop("left")
    least, most = F.col("at") - F.col("end") + LEAST, F.col("at") - F.col("start")  # words to the left that a passage of the reach has
    each = rows.select("h", "doc_id", "sig", "at", "to_right", "to_left", F.explode(F.sequence(least, most)).alias("n_left"))
    return each.select("h", "n_left", F.get("to_right", LEAST - K - F.col("n_left")).alias("to_right"), F.get("to_left", F.col("n_left")).alias("to_left"), "doc_id", "sig", (F.col("at") - F.col("n_left")).alias("start"))


def merged(spans: DataFrame) -> DataFrame:
    """(doc_id, sig, spans array<struct<start, end, src_doc_id>>): overlapping and touching repeats of one source as one.

    Of two sources' repeats that overlap, the words in both are given to the one that begins first; the other keeps the rest, which is never empty.
    """
    listed = spans.distinct().groupBy("doc_id", "sig").agg(F.collect_list(F.struct("start", "end", "src_doc_id")).alias("spans"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = batch.column("spans")
            start, end, src = (spans.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("start", "end", "src_doc_id"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            order = np.lexsort((end, src, start, row))
            start, end, src, row = start[order], end[order], src[order], row[order]
            far = row << 40  # beyond any position, so that one running maximum does for all documents
            before = np.concatenate([[-1], np.maximum.accumulate(end + far)[:-1]]) - far
            new = end > before
            gap, start, end, src, row = (x[new] for x in (start > before, np.maximum(start, before), end, src, row))
            begins = np.flatnonzero(gap | np.concatenate([[True], src[1:] != src[:-1]]))
            start, end, src, row = start[begins], np.maximum.reduceat(end, begins), src[begins], row[begins]
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in (start, end, src)], ["start", "end", "src_doc_id"]))
            return pa.record_batch([batch.column("doc_id"), batch.column("sig"), lists], ["doc_id", "sig", "spans"])

        return step

    return arrow_map(listed, make, "doc_id long, sig long, spans array<struct<start:long,end:long,src_doc_id:long>>")


def runs_of_equals(suffixes: DataFrame) -> DataFrame:
    """The suffixes with the place of the first one with the same reach (``least``), and whether their own is a later one.

    They are sorted by (h, reach, place) and compared with the neighbour before; the first of a run is carried on along it.
    """
    ranges = Ranges(suffixes, ["h"], ["reach", "doc_id", "start"], hot=1000)
    w, place = ranges.window(), F.struct("doc_id", "start")
    d = ranges.rows.withColumns({"_k": F.row_number().over(w), "_before": F.lag("reach").over(w)})
    d = d.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("_before") != F.col("reach")), F.struct("reach", place.alias("place"))))
    d = d.withColumn("_run", F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a run that goes on over a cut has the first place that was carried, and so has all that a range begins with
    d = ranges.with_carried(d, [F.min_by("_run", "_k").alias("_head"), F.max_by("_run", "_k").alias("_tail")], {"_earlier": F.collect_list(F.struct("_head", "_tail"))})
    carried = F.aggregate(
        F.coalesce("_earlier", F.array().cast("array<struct<_head:struct<reach:bigint,place:struct<doc_id:bigint,start:int>>,_tail:struct<reach:bigint,place:struct<doc_id:bigint,start:int>>>>")),
        F.lit(None).cast("struct<reach:bigint,place:struct<doc_id:bigint,start:int>>"),
        lambda held, r: F.when(held["reach"] == r["_tail"]["reach"], held).otherwise(r["_tail"]),
    )
    d = d.withColumn("_carried", carried)
    least = F.when(F.col("_carried.reach") == F.col("reach"), F.col("_carried.place")).otherwise(F.col("_run.place"))
    return d.select(*suffixes.columns, least.alias("least")).withColumn("later", place > F.col("least"))


def _with_first(work: Workspace, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows with the first place (``least``) of their keys, and whether their own is a later one.

    First places are written, so that the join has a row a key on its other side and nothing else in its stage, and AQE can split a hot key.
    """
    firsts = work.settle(rows.groupBy(*keys).agg(F.min(F.struct("doc_id", "start")).alias("least")), name)
    return rows.join(firsts, keys).withColumn("later", F.struct("doc_id", "start") > F.col("least"))


def repeat_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, spans) of the documents that repeat a passage of LEAST words or more; see the module.

    Null ids are left out of the search, and so are null and empty texts and those under LEAST words.  Rows that repeat an id
    are one document: its text, if they are equal, is no repeat of itself.
    """
    work = Workspace(docs.sparkSession, "suffixes")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    anchored = work.settle(find_anchors(docs), "anchors")
    retained = anchored.where("not inside").drop("inside")
    inside = anchored.where("inside").select("doc_id", "sig", "start", "end", F.col("doc_id").alias("src_doc_id"))
    differ = lambda c: F.min(c) != F.max(c)
    groups = retained.groupBy("h").agg(differ("reach").alias("mixed"), (differ("doc_id") | differ("start")).alias("again")).where("mixed or again").select("h", "mixed")
    groups = work.settle(groups, "groups")
    repeated = work.settle(retained.join(groups, "h"), "repeated")
    placed = work.settle(runs_of_equals(repeated), "placed")
    whole = placed.where("later").select("doc_id", "sig", "start", "end", F.col("least.doc_id").alias("src_doc_id"))
    found = placed.where("mixed and not later").groupBy("doc_id", "sig").agg(F.collect_set(F.struct("h", "at", "start", "end")).alias("found"))
    # a merge join at every size, here and for the cuts: what is shuffled then grows as the input does
    some = docs.withColumn("sig", F.xxhash64("text")).join(found.hint("merge"), ["doc_id", "sig"])
    passages = work.settle(shared_passages(work.settle(contexts(some), "contexts"), work), "passages")
    single = _with_first(work, passages, ["h", "n_left", "to_right", "to_left"], "first_passages").where("later")
    single = single.select("doc_id", "sig", "start", (F.col("start") + LEAST).alias("end"), F.col("least.doc_id").alias("src_doc_id"))
    spans = whole.union(single).union(inside)
    out = work.settle(merged(spans.withColumns({n: F.col(n).cast("long") for n in ("start", "end")})), "spans")
    work.drop("anchors", "groups", "repeated", "placed", "contexts", "to_right", "passages", "first_passages")
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, src_doc_id): a row for each repeat and source; src_doc_id holds the same words earlier on.

    Rows of a document don't overlap; those of adjoining or overlapping repeats touch.
    """
    one = repeat_spans(docs).select("doc_id", F.explode("spans").alias("s"))
    return one.select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), F.col("s.src_doc_id").alias("src_doc_id"))


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the white space after them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = starts[b]
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeats cut from ``text``; all columns stay, rows of which nothing is left go.

    Rows without repeats, null ids and null texts among them, stay as they are.
    """
    schema, names = docs.schema, docs.columns
    cut_id, cut_sig, cut_spans = (fresh(docs, n) for n in ("_cut_id", "_cut_sig", "_cut_spans"))
    spans = repeat_spans(docs).toDF(cut_id, cut_sig, cut_spans).hint("merge")
    joined = docs.join(spans, (docs.doc_id.cast("long") == F.col(cut_id)) & (F.xxhash64(docs.text) == F.col(cut_sig)), "left")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, lists = batch.column("text").to_pylist(), batch.column(cut_spans).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for i, spans in enumerate(lists):
                if spans:
                    raw = cut_words(texts[i].encode(), [(s["start"], s["end"]) for s in spans])
                    texts[i], keep[i] = raw.decode(), bool(raw.split())
            arrays = [pa.array(texts, "string") if n == "text" else batch.column(n) for n in names]
            return pa.record_batch(arrays, names).filter(pa.array(keep))

        return step

    return arrow_map(joined, make, schema)
