"""Operators over ordered sequences: run lengths, chunks, stanzas, slices, folds, request cycles.

Numbering, runs, chunks and stanzas cut a sequence into ranges of its whole order and carry counts or states over the cuts (see ``ranges``), so that a key with most of the
rows, or a table that is one single sequence (no keys), is not one task's work.  Where a key's whole sequence is the result
(``gather``, ``partition_results``, a stanza's text), it is one row and so is put together in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.operators.ranges import Ranges, numbered


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str, by: Column | None = None) -> DataFrame:
    """(keys, run, value, n): adjacent rows of equal ``by`` (the value itself by default) as one, with the first value."""
    ranges = Ranges(df.withColumn("_by", by if by is not None else F.col(value)), keys, order)
    w = ranges.window()
    d = ranges.rows.withColumn("_local", F.row_number().over(w)).withColumn("_prev", F.lag("_by").over(w))
    d = ranges.with_carried(d, [F.max_by(F.struct("_by"), "_local").alias("_last")], {"_carried": F.last("_last")})
    first = F.when(F.col("_carried").isNull(), True).otherwise(~F.col("_by").eqNullSafe(F.col("_carried._by")))
    d = d.withColumn("_new", F.when(F.col("_local") == 1, first).otherwise(~F.col("_by").eqNullSafe(F.col("_prev"))).cast("long"))
    d = ranges.with_carried(d.drop("_prev", "_carried"), [F.sum("_new").alias("_runs")], {"_before": F.sum("_runs")})
    d = d.withColumn("run", F.sum("_new").over(w) + F.coalesce("_before", F.lit(0)))
    return d.groupBy(*keys, "run").agg(F.min_by(value, F.struct("_range", "_local")).alias(value), F.count("*").alias("n"))


def chunks(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, drop_overflow: bool = False) -> DataFrame:
    """(keys, chunk, items): every n rows in order.

    ``drop_overflow`` keeps a defect that some callers rely on: the row that meets a full chunk is lost, and a
    sequence that ends with a full chunk is followed by an empty one.
    """
    stride = n + 1 if drop_overflow else n
    d = numbered(df, keys, order).withColumn("chunk", F.floor(F.col("_i") / stride).cast("long"))
    kept = d.filter(F.col("_i") % stride != n) if drop_overflow else d
    out = kept.groupBy(*keys, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))
    if drop_overflow:
        total = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter((F.col("_n") > 0) & (F.col("_n") % stride == 0))
        empty = total.select(*keys, (F.col("_n") / stride).cast("long").alias("chunk"), F.array().cast(out.schema["items"].dataType).alias("items"))
        out = out.unionByName(empty)
    return out


def stanzas(df: DataFrame, keys: list[str], order: list[str], value: str, starts: Column, ends: Column) -> DataFrame:
    """(keys, stanza, text): rows from a start to the next end, joined; rows outside are dropped, an end alone gives an empty text, an open tail none.

    The machine has two states, outside and inside a stanza.  A start leads inside, an end outside, any other row changes nothing; so the rows of a range, whatever
    their number, are one function of the state: the last start or end among them, or no change.  These are composed over the ranges of a
    key, of which there is a row each, and what comes out is the state in which a range begins.  Numbers of stanzas are carried in the same way, as counts of ends.
    """
    ranges = Ranges(df.withColumn("_s", F.coalesce(starts, F.lit(False))).withColumn("_e", F.coalesce(ends, F.lit(False))), keys, order)
    earlier = ranges.window().rowsBetween(Window.unboundedPreceding, -1)
    d = ranges.rows.withColumn("_leads", F.when(F.col("_e"), F.lit(False)).when(F.col("_s"), F.lit(True)))
    d = d.withColumns({"_at": F.row_number().over(ranges.window()), "_inside": F.last("_leads", ignorenulls=True).over(earlier), "_ends": F.sum(F.col("_e").cast("long")).over(earlier)})
    totals = [F.max_by("_leads", F.when(F.col("_leads").isNotNull(), F.col("_at"))).alias("_state"), F.sum(F.col("_e").cast("long")).alias("_n")]
    d = ranges.with_carried(d, totals, {"_begins": F.last("_state", ignorenulls=True), "_before": F.sum("_n")})
    kept = F.coalesce("_inside", "_begins", F.lit(False)) | F.col("_s")
    d = d.select(*keys, (F.coalesce("_ends", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias("stanza"), F.when(kept, F.struct("_range", "_at", F.col(value).alias("v"))).alias("_row"), "_e").filter("_e or _row is not null")
    out = d.groupBy(*keys, "stanza").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda x: x["v"]), "").alias("text"), F.max("_e").alias("_closed"))
    return out.filter("_closed").drop("_closed")


def slice_rows(df: DataFrame, order: list[str], start: int, length: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(length)


def zip_with_index(df: DataFrame, keys: list[str], order: list[str], begin: int = 0) -> DataFrame:
    d = numbered(df, keys, order, "index")
    return d.withColumn("index", (F.col("index") + begin).cast("long"))


def next_ids(df: DataFrame, order: list[str], taken: DataFrame, name: str = "id", start: int = 0) -> DataFrame:
    """``df`` with ids that go on after the largest of ``taken``, the table of earlier runs (``start`` if it is empty), in order and without gaps."""
    after = taken.agg(F.max(name).alias("m")).scalar()  # one value
    return numbered(df, [], order, name).withColumn("_after", after).withColumn(name, (F.col(name) + F.coalesce(F.col("_after") + 1, F.lit(start))).cast("long")).drop("_after")


def from_batches(df: DataFrame, items: str, order: list[str], limit: int = 0) -> DataFrame:
    """The items of array rows one by one, the first ``limit`` of them (0: all)."""
    d = df.select(*order, F.posexplode(items).alias("pos", "item"))
    return d.orderBy(*order, "pos").limit(limit) if limit > 0 else d


def gather(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, items): a key's values in order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]).alias("items"))


def fold(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(items, start, step)


@dataclass(frozen=True)
class Fold:
    """An aggregate of rows in order, in parts that can be put together: ``merge(a, b)`` of the states of two adjoining stretches is the state of both; ``start`` is that of none."""

    start: Any
    step: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


def fold_rows(df: DataFrame, keys: list[str], order: list[str], value: str, fold: Fold, kind: str, name: str = "out") -> DataFrame:
    """(keys, name): a key's values folded in order; ``kind`` is the result's type.

    A task goes through its rows with one state in hand, a key with most of the rows is folded in ranges, and the ranges' states, a few a key, are merged in order.  Keys with no
    rows are not there; nulls are values like others.
    """
    ranges = Ranges(df.select(*dict.fromkeys([*keys, *order, value])), keys, order)
    place = [*keys, "_range"]
    dealt = ranges.rows.select(*place, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(value).alias("_v"))
    dealt = dealt.repartition(*place).sortWithinPartitions(*place, *(f"_o{i}" for i in range(len(order)))).select(*place, "_v")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    by_key = lambda names: ", ".join(f"`{n}` {kinds[n]}" for n in names)

    def runs(n: int, begin: Callable, more: Callable, end: Callable, names: list[str], last_kind: pa.DataType | None) -> Callable:
        """Goes through rows that are sorted by their first n columns and gives a row for each run of equal ones."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, state, fields = None, None, None
            for batch in batches:
                fields, done = [batch.schema.field(i) for i in range(n)], []
                for *key, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held is not None and key == held[0]:
                        state = more(state, v)
                    else:
                        if held is not None:
                            done.append((*held[0], end(state)))
                        held, state = (key,), begin(v)
                if done:
                    yield pa.record_batch([*(pa.array(c, f.type) for c, f in zip(list(zip(*done, strict=True))[:n], fields, strict=True)), pa.array([d[n] for d in done], last_kind)], names)
            if held is not None:
                yield pa.record_batch([*(pa.array([c], f.type) for c, f in zip(held[0], fields, strict=True)), pa.array([end(state)], last_kind)], names)

        return run

    states = dealt.mapInArrow(runs(len(place), lambda v: fold.step(fold.start, v), fold.step, lambda s: cloudpickle.dumps(s), [*place, "_state"], pa.binary()), f"{by_key(place)}, _state binary")
    merged = states.repartition(*keys) if keys else states.repartition(1)  # without keys a row a range
    merged = merged.sortWithinPartitions(*place).select(*keys, "_state")
    load = cloudpickle.loads
    return merged.mapInArrow(runs(len(keys), load, lambda s, v: fold.merge(s, load(v)), fold.finish, [*keys, name], None), f"{by_key(keys)}{', ' if keys else ''}`{name}` {kind}")


def last_item(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def partition_results(df: DataFrame, keys: list[str], order: list[str], value: str, ok: Column) -> DataFrame:
    """(keys, lefts, rights) in order."""
    side = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(*order, F.col(value).alias("_v"))))), lambda x: x["_v"])
    return df.groupBy(*keys).agg(side(~ok).alias("lefts"), side(ok).alias("rights"))


def difference(a: Column, b: Column) -> Column:
    """Items of a that b lacks, in order, repeats kept."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def sets_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def request_cycle(events: DataFrame, key: str, kind: str, message: str | None = None) -> DataFrame:
    """(key, outcome, blocked): success once request, response and requestfinished are seen, fail once request and requestfailed are; else open."""
    seen = events.groupBy(key).agg(F.collect_set(kind).alias("kinds"), *([F.max(F.col(message).contains("blockedbyclient")).alias("blocked")] if message else [F.lit(False).alias("blocked")]))
    has = lambda *names: F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains("kinds", n))
    outcome = F.when(has("request", "response", "requestfinished"), F.lit("success")).when(has("request", "requestfailed"), F.lit("fail")).otherwise(F.lit("open"))
    return seen.select(key, outcome.alias("outcome"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def fetch_pages(notes: DataFrame, number: str, page_size: int, limit: int = 0, after: int = -1) -> DataFrame:
    """(number, page): what a paged source gives from ``after`` on, with the page each note comes in."""
    d = notes.filter(F.col(number) > after).select(number)
    d = d.orderBy(number).limit(limit) if limit > 0 else d
    return numbered(d, [], [number]).select(number, F.floor(F.col("_i") / page_size).cast("long").alias("page"))
