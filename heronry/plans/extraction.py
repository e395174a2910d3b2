"""The extraction plan: pages to field records to canonical fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators.evidence import canonical_array, field_arrays, field_records
from heronry.operators.extract import with_candidates
from heronry.plans.rules import EXAMPLE, GENERAL, RULES, Rule


def _candidates(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    if "status" not in pages.columns:
        pages = pages.withColumn("status", F.lit("200"))
    return with_candidates(pages.select("page_id", "url", "status", "html"), rules)


def extract_fields(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, url, seq, name, value, evidence) from (page_id, url, html[, status]); pages of another status than 200 give nothing."""
    return field_records(_candidates(pages, rules), (*rules, GENERAL))


def canonical_fields(pages: DataFrame, rules: tuple[Rule, ...] = (*RULES, EXAMPLE)) -> DataFrame:
    """(page_id, seq, name, value, evidence): the first of each field and every author, chosen within the page's own row, so without a shuffle."""
    d = field_arrays(_candidates(pages, rules), (*rules, GENERAL)).select("page_id", F.posexplode(canonical_array(F.col("fields"))).alias("i", "f"))
    return d.select("page_id", (F.col("i") + 1).cast("long").alias("seq"), "f.name", "f.value", "f.evidence")
