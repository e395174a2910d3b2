"""Character differences and match offsets, as Arrow-batched functions."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def diff_chars(a: str, b: str) -> list[tuple[str, str, int]]:
    """(kind, value, count) of a least edit script, kinds add, remove and same: a greedy search by edit distance.

    What both texts begin and end with is set aside; of the rest, time grows with length times distance, and memory with
    four bytes for each pair of distances.
    """
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    steps = [("same", a[:head])] * (head > 0) + _middle(a[head : len(a) - tail], b[head : len(b) - tail]) + [("same", a[len(a) - tail :])] * (tail > 0)
    out: list[tuple[str, list[str]]] = []
    for kind, text in steps:
        if out and out[-1][0] == kind:
            out[-1][1].append(text)
        else:
            out.append((kind, [text]))
    return [(kind, "".join(parts), sum(map(len, parts))) for kind, parts in out]


def _middle(a: str, b: str) -> list[tuple[str, str]]:
    n, m = len(a), len(b)
    if not n or not m:
        return [("remove", a)] * (n > 0) + [("add", b)] * (m > 0)
    # history[d][i]: how far into a the path on diagonal 2i - d comes with d edits
    history: list[array] = []
    for d in range(n + m + 1):
        was, reach = history[-1] if history else None, array("i", bytes(4 * (d + 1)))
        for i in range(d + 1):
            k = 2 * i - d
            if was is None:
                x = 0
            elif i == 0 or (i < d and was[i - 1] < was[i]):
                x = was[i]
            else:
                x = was[i - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[i] = x
            if x >= n and x - k >= m:
                return _script(a, b, [*history, reach])
        history.append(reach)
    return []


def _script(a: str, b: str, history: list[array]) -> list[tuple[str, str]]:
    x, y, steps = len(a), len(b), []
    for d in range(len(history) - 1, 0, -1):
        i, was = (x - y + d) // 2, history[d - 1]
        down = i == 0 or (i < d and was[i - 1] < was[i])
        px = was[i] if down else was[i - 1]
        py = px - ((2 * i - d) + (1 if down else -1))
        same = x - px - (not down)
        if same > 0:
            steps.append(("same", a[x - same : x]))
        steps.append(("add", b[py]) if down else ("remove", a[px]))
        x, y = px, py
    if x:
        steps.append(("same", a[:x]))
    return steps[::-1]


_CHANGES = ArrayType(StructType([StructField("kind", StringType()), StructField("value", StringType()), StructField("count", IntegerType())]))
_SPANS = ArrayType(ArrayType(IntegerType()))


@F.pandas_udf(_CHANGES)
def _diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "value": v, "count": n} for k, v, n in diff_chars(x, y)] if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


@F.pandas_udf(_SPANS)
def _offsets(s: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([[[m.start(), m.end()] for m in re.finditer(p, x)] if x is not None else None for x, p in zip(s, pattern, strict=True)])


def changes(a: Column, b: Column, brief: bool = False) -> Column:
    """array<struct<kind, value, count>>; ``brief`` leaves out the text of what is the same."""
    out = _diff(a, b)
    return F.transform(out, lambda c: F.struct(c["kind"].alias("kind"), F.when(c["kind"] != "same", c["value"]).alias("value"), c["count"].alias("count"))) if brief else out


#: Items of a block of running sums, and how often sums of blocks are themselves cut into blocks: enough for 64 ** 4 items.
BLOCK, LEVELS = 64, 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; an expression in a lambda would be computed for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(items: Column, levels: int = LEVELS) -> Column:
    """For each integer of an array the sum of those before it, in time linear in their number: within blocks, and over the blocks' sums in the same way."""
    within = lambda a: F.transform(a, lambda _, i: F.aggregate(F.slice(a, F.lit(1), i), F.lit(0), lambda s, v: s + v))
    if levels == 0:
        return _let(items, within)

    def of(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")))
        return _let(F.transform(starts, lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK))), joined)

    def joined(blocks: Column) -> Column:
        before = sums_before(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v)), levels - 1)
        return F.flatten(F.zip_with(blocks, before, lambda b, n: F.transform(within(b), lambda p: p + n)))

    return _let(items, of)


def match_offsets(s: Column, pattern: str) -> Column:
    """[start, end) of every match: from the lengths of the matches and of what lies between them, in the JVM and in time linear in the text.

    A pattern that also matches the empty text has matches that ``split`` passes over; such ones go through Python.
    """
    if re.compile(pattern).search("") is not None or re.search(r"\(\?<?[=!]|\\b|\^|\$|\\[AZzGB]", pattern):
        return _offsets(s, F.lit(pattern))
    found = F.transform(F.regexp_extract_all(s, F.lit(pattern), 0), F.length)
    between = F.transform(F.split(s, pattern), F.length)
    pairs = lambda both: F.zip_with(F.slice(both["between"], F.lit(1), F.size(both["found"])), both["found"], lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    place = lambda pair, before: F.array(before + pair["gap"], before + pair["gap"] + pair["match"])
    spans = _let(F.struct(between.alias("between"), found.alias("found")), lambda both: _let(pairs(both), lambda a: F.zip_with(a, sums_before(F.transform(a, lambda x: x["gap"] + x["match"])), place)))
    return F.when(s.isNotNull(), spans)
