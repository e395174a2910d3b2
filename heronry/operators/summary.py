"""Progress reports: counts by flag, day, domain and status class, and their text.

Each facet is a pre-aggregated count; what is formatted has a row a domain or a state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions.scalars import day, pad_end, status_class

CODES = ("20x", "30x", "40x", "50x")


def count_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def count_by(df: DataFrame, key: str | Column, name: str = "key") -> DataFrame:
    """Counts by key, the null group too."""
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias("n"))


def count_by_day(df: DataFrame, ts: str, anchor: Column | None = None, days: int = 7) -> DataFrame:
    """Rows a day from ``days`` days before the anchor on, which is the latest time if none is given."""
    if anchor is None:
        anchor = df.agg(F.max(ts)).scalar()
    recent = df.filter(F.col(ts) >= anchor - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy(day(F.col(ts)).alias("day")).agg(F.count("*").alias("n")).orderBy("day")


def domain_flags(df: DataFrame, domain: str, flag: str) -> DataFrame:
    return df.groupBy(domain, flag).agg(F.count("*").alias("n"))


def domain_presence(df: DataFrame, domain: str, flag: str) -> DataFrame:
    """(domain, present, missing, outcome, ratio, place): outcome full, partial or failed; placed by size within it."""
    from pyspark.sql import Window

    d = df.groupBy(F.col(domain).alias("domain")).agg(F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("long")).alias("present"), F.count("*").alias("total"))
    d = d.withColumn("missing", F.col("total") - F.col("present"))
    outcome = F.when(F.col("missing") == 0, F.lit("full")).when(F.col("present") == 0, F.lit("failed")).otherwise(F.lit("partial"))
    ratio = F.when(F.col("missing") == 0, F.col("present").cast("string")).otherwise(F.concat_ws("/", F.col("present").cast("string"), F.col("total").cast("string")))
    d = d.withColumn("outcome", outcome).withColumn("ratio", ratio)
    place = F.row_number().over(Window.partitionBy("outcome").orderBy(F.col("total").desc(), "domain"))
    return d.select("domain", "present", "missing", "outcome", "ratio", place.cast("long").alias("place"))


def domain_http_pivot(df: DataFrame, domain: str, status: str) -> DataFrame:
    """(domain, c20x, c30x, c40x, c50x, c0x, line): rows without a status count under 0x."""
    code = status_class(F.col(status))
    d = df.groupBy(F.col(domain).alias("domain")).agg(*(F.sum((code == c).cast("long")).alias(f"c{c}") for c in (*CODES, "0x")))
    parts = [F.concat(F.lit(f"{c}: "), pad_end(F.col(f"c{c}").cast("string"), 6)) for c in CODES]
    return d.withColumn("line", F.concat(pad_end(F.col("domain"), 35), F.lit(": "), *parts))


def facets(parts: dict[str, DataFrame]) -> DataFrame:
    """(facet, key, n) of several reports."""
    return reduce(DataFrame.unionByName, (d.select(F.lit(name).alias("facet"), F.col(d.columns[0]).cast("string").alias("key"), F.col("n")) for name, d in parts.items()))


def grouped_facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """The counts by each column alone, in one scan and one shuffle."""
    d = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.grouping_id(*columns).alias("g"), F.count("*").alias("n"))
    full = (1 << len(columns)) - 1
    name, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        mine = F.col("g") == (full ^ (1 << (len(columns) - 1 - i)))
        name, key = F.when(mine, F.lit(c)).otherwise(name), F.when(mine, F.col(c).cast("string")).otherwise(key)
    return d.select(name.alias("facet"), key.alias("key"), "n")


def section(df: DataFrame, title: str, order: list[Column], line: Column) -> DataFrame:
    """(text): a title and a line a row of a report, which is small."""
    d = df.agg(F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), line.alias("line")))).alias("rows"))
    return d.select(F.array_join(F.concat(F.array(F.lit(title)), F.transform("rows", lambda r: r["line"])), "\n").alias("text"))


def status_report(url_status: DataFrame) -> DataFrame:
    """The report as one text: total, flags, days, domains, status classes, workflow; sections stand apart by an empty line.

    Expects responseHost, hasAbstract, hasPdfLink, validResponseUrl, httpStatus, workflowStatus, updatedAt.
    """
    valid = url_status.filter("validResponseUrl")
    line = lambda k: F.concat(F.lit("    "), F.col(k).cast("string"), F.lit(": "), F.col("n").cast("string"))
    presence = domain_presence(valid, "responseHost", "hasAbstract")
    rank = F.when(F.col("outcome") == "full", 0).when(F.col("outcome") == "partial", 1).otherwise(2)
    shown = F.when(F.col("outcome") == "failed", F.concat(F.lit("0/"), F.col("missing").cast("string"))).otherwise(F.col("ratio"))
    heads = url_status.sparkSession.createDataFrame([(0, "Fully Successful Domains"), (1, "Partially Successful Domains"), (2, "Failed Domains")], "r int, head string")
    rows = presence.select(rank.alias("r"), "place", F.concat(F.lit("    "), shown, F.lit(": "), F.col("domain")).alias("l")).unionByName(heads.select("r", F.lit(0).cast("long").alias("place"), F.col("head").alias("l")))
    flag = url_status.agg(F.count("*").alias("n"), F.sum(F.col("hasAbstract").cast("long")).alias("a"), F.sum(F.col("hasPdfLink").cast("long")).alias("p"))
    counts = flag.select(F.concat(F.lit("Recorded Note Count: "), F.col("n").cast("string"), F.lit("\n\nNotes With Abstracts: "), F.coalesce("a", F.lit(0)).cast("string"), F.lit("\n\nNotes With PDF Links: "), F.coalesce("p", F.lit(0)).cast("string")).alias("text"))
    parts = [
        counts,
        section(count_by_day(url_status, "updatedAt"), "Updated Notes Per Day, Last 7 days", [F.col("day")], line("day")),
        section(rows, "Extracted Abstracts By Domain, out of Notes with valid URLs", [F.col("r"), F.col("place")], F.col("l")),
        section(domain_http_pivot(valid, "responseHost", "httpStatus"), "Http Status Counts By Domain", [F.col("domain")], F.col("line")),
        section(count_by(url_status, "workflowStatus"), "Workflow Status Counts", [F.col("key")], line("key")),
    ]
    numbered = reduce(DataFrame.unionByName, (p.select(F.lit(i).alias("i"), "text") for i, p in enumerate(parts)))
    return numbered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n").alias("report"))
