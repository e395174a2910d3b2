"""Dispatch by an index over many rules: a rule is only tried on addresses that hold a piece of text which its pattern demands.

``extract.dispatch`` tries rules one after another, which is right for a few.  Here each rule gives one key, the piece of ``SIZE`` characters of its
required text that fewest other rules have; addresses are cut into their own pieces and joined with the keys, and the few rules found are tried.
The first rule in order wins, as it does there.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 4


def required(pattern: str) -> list[str]:
    """Runs of text that are in whatever the pattern matches; what isn't plain ends a run, and a choice at the top, or flags, leave none."""
    runs, run, i = [], "", 0

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        following = pattern[i + 1 : i + 2]
        if c == "|" or pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
            return []
        if c == "\\":
            if following.isalnum() or not following:
                if following in "QEkpPxucN0123456789" or not following:
                    return []
                end()
            else:
                run += following
            i += 2
        elif c == "[":
            close = re.compile(r"\[\^?\]?(?:\\.|[^\]\\\[])*\]").match(pattern, i)
            if close is None:
                return []
            end()
            i = close.end()
        elif c == "(":
            depth, i = 1, i + 1
            while i < len(pattern) and depth:
                if pattern[i] == "[":
                    return []
                depth += {"(": 1, ")": -1}.get(pattern[i], 0)
                i += 2 if pattern[i] == "\\" else 1
            if depth:
                return []
            end()
        elif c in "?*{":
            run = run[:-1]  # what stands before it may be missing
            end()
            i = pattern.find("}", i) + 1 if c == "{" else i + 1
            if not i:
                return []
        elif c in ".+^$)":
            end()
            i += 1
        else:
            run += c
            i += 1
    end()
    return [r for r in runs if r]


def keys_of(patterns: list[str]) -> list[str | None]:
    """A piece for each pattern that all its matches hold, of those the one that fewest patterns have; None if there is none of that size."""
    pieces = [sorted({r[i : i + SIZE] for r in required(p) for i in range(len(r) - SIZE + 1)}) for p in patterns]
    counts = Counter(x for own in pieces for x in own)
    return [min(own, key=lambda x: (counts[x], x)) if own else None for own in pieces]


def dispatch_many(pages: DataFrame, rules: list[tuple[str, str]], otherwise: str, url: str = "url", name: str = "rule") -> DataFrame:
    """``pages`` with the name of the first of (name, pattern) whose pattern is found in the address, else ``otherwise``, which null addresses get too.

    Distinct addresses are dispatched, so a common one is tried once.  Rules without a key are tried one after another on all.
    """
    spark, keys = pages.sparkSession, keys_of([p for _, p in rules])
    index = spark.createDataFrame([(i, n, p, k) for i, ((n, p), k) in enumerate(zip(rules, keys, strict=True)) if k is not None], "place int, name string, pattern string, piece string")
    once = pages.select(F.col(url).alias("address")).where("address is not null").distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("address") - SIZE + 1))
    held = once.select("address", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("address", i, F.lit(SIZE))))).alias("piece"))
    found = held.join(index, "piece").where(F.expr("address rlike pattern")).groupBy("address").agg(F.min(F.struct("place", "name")).alias("keyed"))
    chain = F.lit(None).cast("struct<place:int,name:string>")
    for i, ((n, p), k) in reversed(list(enumerate(zip(rules, keys, strict=True)))):
        if k is None:
            chain = F.when(F.col("address").rlike(p), F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"))).otherwise(chain)
    first = once.join(found, "address", "left").withColumn("plain", chain)
    first = first.select("address", F.array_min(F.filter(F.array("keyed", "plain"), lambda x: x.isNotNull()))["name"].alias("_first"))
    mine, theirs = (next(f"{'_' * k}{n}" for k in range(99) if f"{'_' * k}{n}" not in pages.columns) for n in ("_address", "_first"))  # names that the pages don't have
    joined = pages.join(first.toDF(mine, theirs), F.col(url) == F.col(mine), "left")
    return joined.withColumn(name, F.coalesce(theirs, F.lit(otherwise))).drop(mine, theirs)
