"""Data of fixed or seeded patterns for tests and trials: strings, notes, addresses, times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def random_strings(spark: SparkSession, n: int, seed: int = 0, digits: int = 3) -> DataFrame:
    """(id, value): n strings of hex digits, the same for the same seed."""
    return spark.range(n).select("id", F.substring(F.sha1(F.concat_ws(":", F.lit(seed).cast("string"), F.col("id").cast("string"))), 1, digits).alias("value"))


def count_strings(strings: DataFrame) -> DataFrame:
    return strings.groupBy("value").agg(F.count("*").alias("n"))


def fake_notes(spark: SparkSession, n: int, first: int = 1) -> DataFrame:
    """(id, number, content) as a note feed has them: every third note without an address, every fourth without an abstract."""
    i = F.col("number")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    content = F.struct(
        text("Title ", i.cast("string")).alias("title"), F.when(i % 3 != 0, text("http://host-", (i % 5).cast("string"), "/page/", i.cast("string"))).alias("html"),
        F.when(i % 4 != 0, text("Abstract of ", i.cast("string"))).alias("abstract"), F.array(text("Author ", (i % 7).cast("string"))).alias("authors"),
    )
    return spark.range(first, first + n).select(F.col("id").alias("number")).select(text("note#", i.cast("string")).alias("id"), "number", content.alias("content"))


def as_batches(notes: DataFrame, size: int) -> DataFrame:
    """(batch, notes): pages of a feed, in order of the number."""
    from heronry.operators.sequences import chunks

    return chunks(notes.withColumn("note", F.struct(*notes.columns)), [], ["number"], "note", size).select(F.col("chunk").alias("batch"), F.col("items").alias("notes"))


def first_pages(feed: DataFrame, pages: int = 5, each: int = 10, page_size: int = 100) -> DataFrame:
    """The first ``each`` notes of the first ``pages`` pages."""
    from heronry.operators.ranges import numbered

    d = numbered(feed, [], ["number"]).withColumns({"page": F.floor(F.col("_i") / page_size), "at": F.col("_i") % page_size})
    return d.where((F.col("page") < pages) & (F.col("at") < each)).drop("_i")


def write_times(rows: DataFrame, order: list[str], now: str, seed: int = 0) -> DataFrame:
    """``rows`` with ``updatedAt``: the first two weeks before ``now``, each following one up to three hours after the one before it."""
    from heronry.operators.ranges import numbered

    d = numbered(rows, [], order)
    steps = F.sum(F.pmod(F.xxhash64(F.col("_i"), F.lit(seed)), F.lit(3 * 3600)))
    d = d.withColumn("_block", F.floor(F.col("_i") / 1000))
    totals = d.groupBy("_block").agg(steps.alias("_sum"))
    before = totals.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = steps.over(Window.partitionBy("_block").orderBy("_i"))
    d = d.withColumn("_own", own).join(before, "_block")
    first = F.lit(now).cast("timestamp") - F.expr("INTERVAL 14 DAYS")
    return d.withColumn("updatedAt", F.timestamp_seconds(F.unix_timestamp(first) + F.col("_own") + F.col("_before"))).drop("_i", "_block", "_own", "_before")


def responses(spark: SparkSession, base: str) -> DataFrame:
    """Addresses of a test server with the status and page that each asks for, as ``<base>/htmls/<status>~<key>~<delay>``."""
    rows = [(200, "good"), (200, "bare"), (404, "missing"), (500, "broken")]
    d = spark.createDataFrame(rows, "status int, key string")
    return d.select(F.concat(F.lit(f"{base.rstrip('/')}/htmls/"), F.concat_ws("~", F.col("status").cast("string"), "key", F.lit("0"))).alias("url"), F.col("status").cast("string").alias("status"), "key")
