"""Ranges of a whole order: how a long sequence is cut so that no key, and no table that is one sequence, is one task's work.

Only keys with more than ``HOT`` rows, or more than a quarter of a task's share, are cut; all others are one range.  Bounds are
taken from an even sample of the whole order key (keys first, then the order within them), as a range shuffle takes them, and are
fixed before anything is computed: each branch of a plan gives a row the same range.  They only balance; results don't depend on
them.  What is carried over the cuts has no more rows than there are ranges and keys that are cut, which is why it may be broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, BinaryType, StructField, StructType

#: A range has about so many rows at least, and a key with not more than HOT is never cut.
ROWS, HOT = 4096, 10_000
#: Rows of the sample for each range.
SAMPLED = 60
#: Up to so many bounds are a tree of comparisons in generated code, more are looked up in arrays.
TREE = 256


class Ranges:
    """``rows`` with the number of each row's range in column ``name``; ranges rise with (keys, order).

    Nulls come first, as they do in Spark's orders; null keys are equal.  Rows that are equal in keys and order lie in one range.  ``like``: rows that are cheaper to
    come by and spread alike, for the bounds.  ``hot``: in place of ``HOT``, and ``ROWS`` in proportion.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], parts: int | None = None, name: str = "_range", like: DataFrame | None = None, hot: int | None = None):
        self.keys, self.order, self.name, self.spark = keys, [c for c in order if c not in keys], name, df.sparkSession
        parts = parts or max(2, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        like = df if like is None else like
        whole = like.select(*keys, *self.order)
        self.schema, self.bounds, self.hot = whole.schema, [], None
        n = whole.count()
        hot_rows = hot or HOT
        most = max(hot_rows, n // (4 * parts))
        if keys and n > most:
            hot = like.groupBy(*keys).count().where(F.col("count") > most).select(*keys).collect()  # not more than four a partition
            self.hot = self.spark.createDataFrame(hot, StructType([f for f in self.schema if f.name in keys])) if hot else None
            whole = self._of_hot(whole) if hot else whole.limit(0)
            n = whole.count() if hot else 0
        parts = min(parts, n * HOT // (hot_rows * ROWS)) if n > most else 1
        if parts > 1:
            texts = [F.col(f.name).cast("string") for f in self.schema] if self._plain() else []  # give the same values when they are cast back, whatever the time zone of Python
            some = whole.sample(min(1.0, SAMPLED * parts / n), 11).sort(*whole.columns).select(*whole.columns, F.array(*texts)).collect()  # about SAMPLED rows a range
            cuts = [some[i * len(some) // parts] for i in range(1, parts)] if some else []
            cuts = [b for i, b in enumerate(cuts) if not i or b != cuts[i - 1]]
            self.bounds, self.texts = [tuple(b)[:-1] for b in cuts], [b[-1] for b in cuts]
        self.rows = self._placed(df)

    def _plain(self) -> bool:
        return all(isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, BinaryType) for f in self.schema)

    def _of_hot(self, rows: DataFrame) -> DataFrame:
        return null_safe_join(rows, F.broadcast(self.hot), self.keys, "left_semi") if self.keys else rows

    def _placed(self, df: DataFrame) -> DataFrame:
        """With how many bounds the row has reached; 0 for all keys that aren't cut, which bounds may split but needn't."""
        if not self.bounds:
            return df.withColumn(self.name, F.lit(0))
        if len(self.bounds) <= TREE and self._plain():
            return df.withColumn(self.name, self._tree(self.texts, 0, len(self.bounds)))
        step = math.isqrt(len(self.bounds) - 1) + 1
        groups = [self.bounds[i : i + step] for i in range(0, len(self.bounds), step)]
        key = StructType([StructField(f.name, f.dataType) for f in self.schema])
        held = StructType([StructField("firsts", ArrayType(key)), StructField("groups", ArrayType(ArrayType(key)))])
        table = self.spark.createDataFrame([([g[0] for g in groups], groups)], held).select(F.struct("*"))  # one row
        own, found = F.struct(*(F.col(f.name) for f in self.schema)), F.col("_bounds")
        reached = lambda array: F.size(F.filter(array, lambda b: b <= own))
        coarse = reached(found["firsts"])
        place = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + reached(F.get(found["groups"], coarse - 1)))
        return df.withColumn("_bounds", table.scalar()).withColumn(self.name, place).drop("_bounds")

    def _tree(self, bounds: list[list], lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(self._reached(bounds[mid]), self._tree(bounds, mid + 1, hi)).otherwise(self._tree(bounds, lo, mid))

    def _reached(self, bound: list) -> Column:
        out = F.lit(True)
        for f, text in reversed(list(zip(self.schema, bound, strict=True))):
            c, v = F.col(f.name), F.lit(text).cast(f.dataType)
            above = c.isNotNull() if text is None else F.coalesce(c > v, F.lit(False))
            out = above | (c.eqNullSafe(v) & out)
        return out

    def window(self) -> Window:
        """A key's rows of one range, in order."""
        return Window.partitionBy(*self.keys, self.name).orderBy(*self.order)

    def with_carried(self, rows: DataFrame, totals: list[Column], carry: dict[str, Column]) -> DataFrame:
        """``rows`` with what the ranges before their own carry over, null where there is none.

        ``totals`` are of a key's rows within a range; ``carry`` has window functions of these, each without its window: they get the earlier ranges of the key.
        """
        before = Window.partitionBy(*self.keys).orderBy(self.name).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        each = (self._of_hot(rows) if self.bounds else rows.limit(0)).groupBy(*self.keys, self.name).agg(*totals)
        carried = each.select(*self.keys, self.name, *(c.over(before).alias(n) for n, c in carry.items()))
        if not self.bounds:
            kinds = dict(carried.dtypes)
            return rows.withColumns({n: F.lit(None).cast(kinds[n]) for n in carry})
        return null_safe_join(rows, F.broadcast(carried), [*self.keys, self.name], "left")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi join in which null keys are equal, with the left side's keys."""
    named = right.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns))
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = left.join(named, cond, how)
    return joined if how == "left_semi" else joined.drop(*(f"_r_{c}" for c in on))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "_i", parts: int | None = None) -> DataFrame:
    """``df`` with each row's number within its keys, from 0: the number within its range, and how many rows the ranges before have."""
    ranges = Ranges(df, keys, order, parts)
    rows = ranges.with_carried(ranges.rows, [F.count("*").alias("_n")], {"_before": F.sum("_n")})
    local = F.row_number().over(ranges.window())
    return rows.withColumn(name, (local - 1 + F.coalesce("_before", F.lit(0))).cast("long")).drop("_before", "_range")
