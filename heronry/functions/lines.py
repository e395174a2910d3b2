"""Line-oriented text queries over arrays of lines, without user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that hold only short tags; lines that are one tag; lines that are one link.
BARE_TAGS = r"\A[ ]*(</?\w{1,4}>[ ]*)+\z"
TAG_LINE = r"\A[ ]+<.*>[ ]*\z"
ANCHOR_LINE = r"\A[ ]+<a href=.*>[ ]*\z"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is referred to: the variable of a function over an array of one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def join_lines(lines: Column, sep: str = " ") -> Column:
    return F.array_join(lines, sep)


def grep(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda x: x.rlike(pattern))


def grep_not(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda x: ~x.rlike(pattern))


def drop_n(lines: Column, n: int) -> Column:
    return F.slice(lines, n + 1, F.greatest(F.size(lines) - n, F.lit(0)))


def _first(lines: Column, pattern: str) -> Column:
    """Number of the first matching line from 1; 0 if there is none."""
    return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True)


def _from(lines: Column, at: Column) -> Column:
    """Lines from number ``at`` (from 1) on."""
    return F.slice(lines, F.greatest(at.cast("int"), F.lit(1)), F.greatest(F.size(lines) - at + 1, F.lit(0)).cast("int"))


def grep_drop_until(lines: Column, pattern: str) -> Column:
    """From the first match on, match included; no match: nothing."""
    at = _first(lines, pattern)
    return F.when(at > 0, _from(lines, at)).otherwise(F.slice(lines, 1, 0))


def grep_take_until(lines: Column, pattern: str) -> Column:
    """Before the first match; no match: everything."""
    at = _first(lines, pattern)
    return F.when(at > 0, F.slice(lines, 1, (at - 1).cast("int"))).otherwise(lines)


def multi_match_index(lines: Column, patterns: list[str]) -> Column:
    """First place (from 0) at which consecutive lines match the patterns in turn; -1 if there is none, or no pattern."""
    if not patterns:
        return F.lit(-1)
    return _once(lines, lambda x: _match_index(x, patterns))


def _match_index(lines: Column, patterns: list[str]) -> Column:
    def fits(i: Column) -> Column:
        out = F.lit(True)
        for k, pattern in enumerate(patterns):
            out = out & F.coalesce(F.get(lines, i + k).rlike(pattern), F.lit(False))
        return out

    places = F.filter(F.transform(lines, lambda _, i: F.when(fits(i), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, F.lit(0)), F.lit(-1))


def multi_drop_until(lines: Column, patterns: list[str], include: bool) -> Column:
    """From the match on, with or without the matched lines; no match: nothing."""
    cut = lambda x, at: F.when(at >= 0, _from(x, at + 1 + (0 if include else len(patterns)))).otherwise(F.slice(x, 1, 0))
    return _once(lines, lambda x: _once(multi_match_index(x, patterns), lambda at: cut(x, at)))


def multi_take_until(lines: Column, patterns: list[str], include: bool) -> Column:
    """Up to the match, with or without the matched lines; no match: nothing, unlike ``grep_take_until``."""
    cut = lambda x, at: F.when(at >= 0, F.slice(x, 1, (at + (len(patterns) if include else 0)).cast("int"))).otherwise(F.slice(x, 1, 0))
    return _once(lines, lambda x: _once(multi_match_index(x, patterns), lambda at: cut(x, at)))


def without_bare_tags(lines: Column) -> Column:
    return grep_not(lines, BARE_TAGS)


def without_tag_lines(lines: Column) -> Column:
    return grep_not(lines, TAG_LINE)


def anchor_lines(lines: Column) -> Column:
    return grep(lines, ANCHOR_LINE)


def anchor_href(line: Column) -> Column:
    """What stands between the last href=" and the next quote."""
    return F.regexp_replace(F.regexp_replace(line, r'(?s)\A.*href="', ""), r'(?s)".*\z', "")


def second_cell(lines: Column, pattern: str) -> Column:
    """The cell after the cell whose text matches: for rows of a heading and a value."""
    after = multi_drop_until(lines, [r"<t[dh]", pattern], False)
    return multi_take_until(multi_drop_until(after, [r"<t[dh]"], False), [r"</t[dh]>"], False)
