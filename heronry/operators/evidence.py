"""Evidence: which candidates support which field, as array functions without user code or shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.cleaning import apply_rules
from heronry.plans.rules import Rule

KEYS = "array<struct<subs:array<string>,required:boolean,field:string>>"
ATTEMPTS = f"array<struct<url:string,label:string,keys:{KEYS}>>"


def add_evidence(evidence: Column, *items: Column) -> Column:
    return F.concat(evidence, F.array(*items))


def clear_evidence(evidence: Column, pattern: str) -> Column:
    return F.filter(evidence, lambda x: ~x.rlike(pattern))


def save_evidence(candidates: Column, text: Column, ambient: Column, name: str) -> Column:
    """One more candidate, with the ambient evidence and its own; empty text is allowed."""
    one = F.struct(F.size(candidates).cast("int").alias("seq"), F.trim(text).alias("text"), add_evidence(ambient, F.lit(name)).alias("evidence"), F.lit(None).cast("string").alias("resolved"))
    return F.array_append(candidates, one)


def supports(candidate: Column, key: Column) -> Column:
    """Whether any evidence of the candidate matches the key, whatever the case."""
    pattern = F.concat(F.lit("(?i)"), key)
    return F.exists(candidate["evidence"], lambda e: F.rlike(e, pattern))


def candidates_for(candidates: Column, key: Column) -> Column:
    return F.filter(candidates, lambda c: supports(c, key))


def evidence_exists(candidates: Column, subs: Column, required: Column) -> Column:
    return ~required | F.exists(subs, lambda s: F.exists(candidates, lambda c: supports(c, s)))


def rule_table(spark, rules: tuple[Rule, ...]) -> DataFrame:  # type: ignore[no-untyped-def]
    """(rule, attempts): a row a rule of the registry, which bounds it."""
    rows = [(r.name, [(a.url, a.label, a.keys()) for a in r.attempts]) for r in rules]
    return spark.createDataFrame(rows, f"rule string, attempts {ATTEMPTS}")


def chosen_attempt(candidates: Column, attempts: Column, url: Column) -> Column:
    """The first attempt whose address fits and whose required keys all have a candidate; null if there is none."""
    fits = lambda a: (a["url"].isNull() | F.rlike(url, F.coalesce(a["url"], F.lit("")))) & F.forall(a["keys"], lambda k: evidence_exists(candidates, k["subs"], k["required"]))
    return F.get(F.filter(attempts, fits), F.lit(0))


def matched(candidates: Column, attempt: Column) -> Column:
    """array<struct<name, text, resolved, evidence>> in order of key, alternative and candidate; a candidate of two alternatives comes twice."""
    one = lambda k, c: F.struct(k["field"].alias("name"), c["text"].alias("text"), c["resolved"].alias("resolved"), F.array_append(c["evidence"], attempt["label"]).alias("evidence"))
    per_key = lambda k: F.flatten(F.transform(k["subs"], lambda s: F.transform(candidates_for(candidates, s), lambda c: one(k, c))))
    return F.flatten(F.transform(attempt["keys"], per_key))


def _with_cleaned(f: Column) -> Column:
    return F.struct(f["name"].alias("name"), f["text"].alias("text"), f["resolved"].alias("resolved"), f["evidence"].alias("evidence"), F.when(f["name"] == "abstract", apply_rules(f["text"])).alias("cleaned"))


def _record(f: Column, i: Column) -> Column:
    """struct<seq, name, value, evidence> of a match: abstracts are cleaned, which leaves its trace, and links resolved."""
    value = F.when(f["name"] == "abstract", f["cleaned"]["value"]).when(f["name"].startswith("pdf-"), F.coalesce(f["resolved"], F.lit(""))).otherwise(f["text"])
    fired = F.coalesce(F.transform(f["cleaned"]["fired"], lambda x: F.concat(F.lit("clean: "), x)), F.array().cast("array<string>"))
    return F.struct(i.alias("seq"), f["name"].alias("name"), value.alias("value"), F.concat(f["evidence"], fired).alias("evidence"))


def field_arrays(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(page_id, url, fields array<struct<seq, name, value, evidence>>), a row a page that has any; empty values are dropped.

    The rule table is broadcast: it has a row a rule.  Rows stay on their partition, and nothing is shuffled.
    """
    table = F.broadcast(rule_table(pages.sparkSession, rules))
    d = pages.join(table, "rule").withColumn("attempt", chosen_attempt(F.col("candidates"), F.col("attempts"), F.coalesce("url", F.lit(""))))
    d = d.where("attempt is not null").select("page_id", "url", F.transform(matched(F.col("candidates"), F.col("attempt")), _with_cleaned).alias("m"))
    return d.select("page_id", "url", F.filter(F.transform("m", _record), lambda r: r["value"] != "").alias("fields"))


def field_records(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(page_id, url, seq, name, value, evidence), a row a value."""
    return field_arrays(pages, rules).select("page_id", "url", F.explode("fields").alias("f")).select("page_id", "url", "f.*")


def canonical_array(fields: Column) -> Column:
    """The first instance of each field, and every author, in order of the field's first appearance; within one row."""
    names = F.transform(fields, lambda x: x["name"])
    placed = F.transform(fields, lambda x, i: F.struct(F.array_position(names, x["name"]).alias("first"), i.alias("at"), x.alias("f")))
    kept = F.filter(placed, lambda x: (x["f"]["name"] == "author") | (x["first"] == x["at"] + 1))
    return F.transform(F.array_sort(kept), lambda x: x["f"])


def field_map(records: DataFrame) -> DataFrame:
    """(page_id, name, values) in order."""
    d = records.groupBy("page_id", "name").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("v"))
    return d.select("page_id", "name", F.transform("v", lambda x: x["value"]).alias("values"))


def canonical(records: DataFrame) -> DataFrame:
    """As ``canonical_array``, for values that are a row each: the first instance of each field, and every author."""
    from pyspark.sql import Window

    by_name = Window.partitionBy("page_id", "name").orderBy("seq")
    d = records.withColumn("k", F.row_number().over(by_name)).withColumn("first", F.min("seq").over(by_name))
    d = d.where("k = 1 or name = 'author'")
    order = Window.partitionBy("page_id").orderBy("first", "seq")
    return d.select("page_id", F.row_number().over(order).cast("long").alias("seq"), "name", "value", "evidence")


def canonical_abstract(names_values: Column) -> Column:
    """The first ``abstract``, else the first ``abstract-clipped``, of array<struct<name, value>>."""
    first = lambda n: F.get(F.filter(names_values, lambda f: f["name"] == n), F.lit(0))["value"]
    return F.coalesce(first("abstract"), first("abstract-clipped"))


def canonical_pdf_link(names_values: Column) -> Column:
    return F.get(F.filter(names_values, lambda f: f["name"] == "pdf-link"), F.lit(0))["value"]


def evidence_summary(records: DataFrame) -> DataFrame:
    """How many values each evidence string supports."""
    return records.select("name", F.explode("evidence").alias("evidence")).groupBy("name", "evidence").agg(F.count("*").alias("n"))
