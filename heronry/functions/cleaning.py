"""Cleaning of abstracts: ordered rules folded into one Column expression.

``apply_rules`` gives the cleaned text and the names of the rules that changed it.  A rule list is data, so a
caller can extend it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.scalars import js_trim

#: What "." stands for in the rules: anything but a line end; and the end of the text.
DOT, END = r"[^\n\r\x{2028}\x{2029}]", r"\z"
#: Texts that are no abstract.
CATCH_ALLS = (
    r"(?i)home page papers",
    rf"Complexity {DOT} Journal Menu",
    r"(?i)no abstract available",
    rf"(?i)\Adownload{DOT}article",
    r"(?i)open access article",
    r"For authors For reviewers",
    r"(?i)banner art adapted from",
    r"(?i)a collection of accepted abstracts",
)
SHORTEST = 200


@dataclass(frozen=True)
class CleaningRule:
    """``run`` is applied where a guard matches, or always without guards."""

    name: str
    guards: tuple[str, ...]
    run: Callable[[Column], Column]

    def apply(self, s: Column) -> Column:
        if not self.guards:
            return self.run(s)
        hit = s.rlike(self.guards[0])
        for guard in self.guards[1:]:
            hit = hit | s.rlike(guard)
        return F.when(hit, self.run(s)).otherwise(s)


def _strip(pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.regexp_replace(s, pattern, "")


def _after(pattern: str) -> Callable[[Column], Column]:
    """What stands between the first two matches, trimmed; nothing if there is none."""
    return lambda s: js_trim(F.coalesce(F.get(F.split(s, pattern), F.lit(1)), F.lit("")))


def _clip(name: str, pattern: str, guard: str | None = None) -> CleaningRule:
    return CleaningRule(name, (guard or pattern,), _strip(pattern))


#: The rules' names, patterns and order.
ABSTRACT_RULES: tuple[CleaningRule, ...] = (
    _clip("starts w/'abstract'", r"(?i)\Aabstract *"),
    _clip("starts w/'motivation'", r"(?i)\Amotivation *"),
    _clip("clip @ 'References'", rf"(References|REFERENCES){DOT}*{END}", r"References|REFERENCES"),
    _clip("clip @ 'Keywords'", rf"Keywords{DOT}*{END}"),
    _clip("starts w/non-word", r"\A\W+"),
    CleaningRule("clip @ Cite This Paper", (r"(?i)cite this paper abstract",), _after(r"(?i)cite this paper abstract")),
    _clip("clip @ Disqus comments", rf"(?i)comments[\d ]+comments{DOT}*{END}"),
    _clip("clip @ trailing tags <.. />", rf"(?i)<etx{DOT}*{END}"),
    _clip("clip @ trailing <", rf"<{END}"),
    CleaningRule("remove newlines", (), lambda s: F.replace(s, F.lit("\n"), F.lit(" "))),
    CleaningRule("trim extra space", (r" {2,}",), lambda s: F.regexp_replace(s, r" +", " ")),
    _clip("clip @ 'Full Text: PDF'", rf"Full Text:{DOT}*{END}"),
    _clip("clip @ 'Related Material'", rf"Related Material{DOT}*{END}"),
    CleaningRule("clip before /Graphical abstract Download/", (r"(?i)graphical abstract download",), lambda s: js_trim(F.get(F.split(s, r"(?i)graphical abstract download"), F.lit(0)))),
    CleaningRule("Catch-alls: e.g., /^Home Page Papers|^Complexity/..", CATCH_ALLS, lambda s: F.lit("")),
    CleaningRule("/Home Archives/ >> maybe /Abstract.*/", (r"\AHome Archives",), _after("Abstract")),
    CleaningRule("abstract too short", (), lambda s: F.when(F.length(s) < SHORTEST, F.lit("")).otherwise(s)),
)


def apply_rules(s: Column, rules: tuple[CleaningRule, ...] = ABSTRACT_RULES) -> Column:
    """struct<value, fired array<string>>: each rule sees what the ones before it left.

    The fold runs over an array of one element, so that each step is computed once, not once for each later reference.
    """
    none = F.array().cast("array<string>")
    state = F.array(F.struct(s.alias("value"), none.alias("fired")))
    for rule in rules:
        state = F.transform(F.transform(state, _run(rule)), _record(rule))
    return F.get(state, F.lit(0))


def _run(rule: CleaningRule) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["value"].alias("was"), rule.apply(x["value"]).alias("value"), x["fired"].alias("fired"))


def _record(rule: CleaningRule) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["value"].alias("value"), F.when(x["value"] == x["was"], x["fired"]).otherwise(F.array_append(x["fired"], F.lit(rule.name))).alias("fired"))


def with_cleaned(df: DataFrame, text: str, value: str = "value", fired: str = "fired", rules: tuple[CleaningRule, ...] = ABSTRACT_RULES) -> DataFrame:
    """``df`` with the cleaned text and the names of the rules that changed it: as ``apply_rules``, for a column that stands by itself.

    Each rule is a projection of plain columns, which is compiled, where a fold over an array is not.
    """
    names = [text, *(f"_{value}_{i}" for i in range(len(rules)))]
    for rule, before, after in zip(rules, names, names[1:], strict=False):
        df = df.withColumn(after, rule.apply(F.col(before)))
    changed = (F.when(F.col(after) != F.col(before), F.lit(rule.name)) for rule, before, after in zip(rules, names, names[1:], strict=False))
    return df.withColumns({value: F.col(names[-1]), fired: F.array_compact(F.array(*changed))}).drop(*names[1:])


def clean_abstract(s: Column) -> Column:
    return apply_rules(s)["value"]
