"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is built from SQL functions.  Ratios are compared as whole numbers (100 * part against percent * whole),
so that no rounding decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule, and the symbols that count.
SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
WINDOW = 8
#: Common function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    (
        "the of and to in is that it was for on are as with be by at this from or an not a he "
        "der die das und den von zu mit sich des auf ist im dem nicht ein eine als "
        "le la les et en un une du de que qui dans pour par sur au est pas avec "
        "el los las del y por con para se su al lo no una es como"
    ).split()
)


@dataclass(frozen=True)
class Rule:
    """A document fails if 100 * part is above (or below) percent * whole."""

    name: str
    part: str
    whole: str
    percent: int
    above: bool = True

    def fails(self) -> Column:
        part, limit = 100 * F.col(self.part), self.percent * F.col(self.whole)
        return part > limit if self.above else part < limit


#: The base rules, which the contract of the query fixes.
BASE_RULES = (Rule("too short", "n_words", "one", 2000, above=False), Rule("repeated passages", "n_repeat_words", "n_words", 30))
RULES = (
    Rule("symbols to words", "n_symbols", "n_words", 15),
    Rule("too few stop words", "n_stop_words", "n_words", 4, above=False),
    Rule("words too long", "word_chars", "n_words", 1000),
    Rule("words too short", "word_chars", "n_words", 250, above=False),
    Rule("repeated lines", "n_dup_lines", "n_lines", 50),
    Rule("stuttering", "n_echoes", "n_words", 20),
)


def _twice(pairs: str) -> Column:
    """Of sorted (w, i) pairs those whose w is met twice or more."""
    return F.filter(F.col(pairs), lambda x, j: (F.get(F.col(pairs), j - 1)["w"] == x["w"]) | (F.get(F.col(pairs), j + 1)["w"] == x["w"]))


def _repeat_words() -> Column:
    """Words covered by windows that are found twice or more, from the sorted (window, position) pairs."""
    twice = _twice("sorted_windows")
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(starts, nothing, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    return F.coalesce(covered, F.lit(0)).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """The table's input columns for each row of (doc_id, text); a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    # hashes first: windows are written out only where their hash is met again
    heads = F.slice("words", F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(0)))
    windows = F.transform(heads, lambda w, i: F.xxhash64(w, *(F.get(F.col("words"), i + k) for k in range(1, WINDOW))))
    d = d.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get(F.col("words"), i - 1)))).cast("long").alias("n_echoes"),
        "words",
        windows.alias("windows"),
    )
    # most texts repeat no window: only the others pay for the sort
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.transform(F.col("windows"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    d = d.withColumn("sorted_hashes", F.when(repeats, F.sort_array(pairs))).drop("windows")
    written = F.transform(_twice("sorted_hashes"), lambda x: F.struct(F.array_join(F.slice("words", x["i"] + 1, F.lit(WINDOW)), " ").alias("w"), x["i"].alias("i")))
    d = d.withColumn("sorted_windows", F.sort_array(written)).drop("sorted_hashes", "words")
    return d.withColumn("n_repeat_words", _repeat_words()).drop("sorted_windows").withColumn("one", F.lit(1).cast("long"))


def failed(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(rule.fails(), F.lit(False))
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(doc_id, statistics, base_failed, failed_rules, kept) for each row of (doc_id, text).

    Null, empty and white-space texts have 0 words and fail the base rules.  Ties with a threshold pass.
    A row in gives a row out, in one projection without a shuffle; a text's own windows are all that is held at once.
    """
    stats = text_statistics(docs)
    reasons = F.array_compact(F.array(*(F.when(r.fails(), F.lit(r.name)) for r in base + rules)))
    return stats.withColumn("base_failed", failed(base)).withColumn("failed_rules", reasons).withColumn("kept", F.size("failed_rules") == 0).drop("one")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    cond = lambda rules: " OR ".join(f"100 * {r.part} {'>' if r.above else '<'} {r.percent} * {r.whole}" for r in rules)
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM t WHERE len(words) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM w) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY doc_id),
s AS (
  SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS BIGINT) AS n_echoes,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, 1 AS one
  FROM t LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({cond(BASE_RULES)}) AS base_failed, NOT ({cond(BASE_RULES)} OR {cond(RULES)}) AS kept
FROM s"""


SQL = _sql()
