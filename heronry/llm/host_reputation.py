"""URL filter: listed rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host.  The share of bad pages is shrunk through beta-binomial priors: a suffix
towards the whole, a registered domain towards its suffix, a host towards its domain.  Each level's prior weighs as many pages
as the spread of the shares below their parents asks for (moments).  A host is blocked where the lower bound of its posterior lies above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import checkpointed

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Suffixes of more than one label under which names are registered, as a pattern; others are the last label.  Country codes part their
#: names by kind, and some hosters give each customer a name of its own.
LONG_SUFFIXES = r"(?:ac|asn|co|com|ed|edu|gen|go|gob|gouv|gov|govt|gv|id|ltd|me|mil|ne|net|nom|or|org|plc|res|sch|school)\.[a-z][a-z]|(?:github|gitlab|netlify|web)\.(?:io|app)|(?:blogspot|wordpress|tumblr|appspot|herokuapp|weebly|wixsite)\.com|(?:pages|workers|vercel)\.(?:dev|app)|cloudfront\.net|s3\.amazonaws\.com"
#: A port at a host's end, and hosts that are addresses, which stand alone.
_PORT, _ADDRESS = r":[0-9]*$", r"^([0-9.]+|\[.*)$"
Z, BLOCK_ABOVE = 1.645, 0.3
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 10000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """From the first :// up to /, ? or #, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _fits(host: Column, path: Column, rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def match_rules(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; a block goes before an allow of the same string. For rule lists of up to about a thousand."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        fits = _fits(host, path, text)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, _PORT, "")


def suffix_of(host: Column) -> Column:
    """What the host's domain is registered under; empty for an address."""
    bare = _bare(host)
    return F.when(bare.rlike(_ADDRESS), F.lit("")).otherwise(F.regexp_extract(bare, rf"(?:^|\.)({LONG_SUFFIXES}|[^.]*)$", 1))


def domain_of(host: Column) -> Column:
    """The suffix with one label more, or an address itself."""
    bare = _bare(host)
    return F.when(bare.rlike(_ADDRESS), bare).otherwise(F.regexp_extract(bare, rf"([^.]*\.(?:{LONG_SUFFIXES})|[^.]*\.[^.]*|[^.]*)$", 1))


def _weight(children: DataFrame) -> float:
    """The prior's weight in pages, by moments, from (n, bad, prior) of each child; one row comes to the driver."""
    p, q = F.col("prior"), F.col("prior") * (1 - F.col("prior"))
    row = children.where("n > 0").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * p, 2) / F.col("n")).alias("s"), F.sum(q).alias("q"), F.sum(F.col("n") * q).alias("nq"),
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.count("*").alias("k"),
    ).first()
    if not row.k or not row.n or row.n <= row.nn / row.n:
        return MOST_WEIGHT
    spread = (row.s - row.q) / (row.n - row.nn / row.n)
    if spread <= 0:
        return MOST_WEIGHT
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, row.nq / row.n / spread - 1))


def host_posteriors(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, mean, bound) for each row of ``hosts`` from outcomes (host, bad 0/1).

    Hosts without labelled pages have their domain's posterior as prior, and so on up; a suffix that is not known has the overall share,
    which is a half if nothing is labelled.  Counts are pre-aggregated, so that a host with most of the rows costs no more than another.
    """
    counted = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))
    known = hosts.select("host").distinct().join(counted, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    known = checkpointed(known.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"))))
    total = known.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = ((total.bad or 0) + 1) / ((total.n or 0) + 2)

    shrunk = lambda w: (F.col("bad") + w * F.col("prior")) / (F.col("n") + w)
    suffixes = known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(mean))
    suffixes = suffixes.select("suffix", shrunk(_weight(suffixes)).alias("prior"))
    domains = known.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", shrunk(_weight(domains)).alias("prior"))
    placed = known.join(domains, ["domain", "suffix"])
    w = _weight(placed)
    mean_col = shrunk(w)
    return placed.select("host", "n", mean_col.alias("mean"), (mean_col - z * F.sqrt(mean_col * (1 - mean_col) / (F.col("n") + w + 1))).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, z: float = Z, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, bound) for each row of (page_id, url).

    A rule's verdict goes first; else a host is blocked if its posterior bound is above ``block_above``.  A null url, or one without ://,
    has an empty host and path, which is judged as any other host.  A row in gives a row out, ids repeated or null; an empty table gives an empty one.  The join on the
    host has one row a host on the other side: Spark broadcasts that if it measures it below its own limit, and splits a hot host's rows if not.
    """
    placed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    scored = host_posteriors(placed, outcomes, z)
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    joined = placed.join(scored.select("host", "mean", "bound"), "host")
    own = F.when(F.col("bound") > block_above, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mean", "bound")


def outcomes_from_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page's outcome is that of the document whose number its path holds; bad are low quality and toxic ones."""
    number = F.regexp_extract(url_path(F.col("url")), r"/(\d{1,18})(?:\D|$)", 1)
    placed = pages.select(url_host(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    bad = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    bad = bad.groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    return placed.join(bad, "doc_id").select("host", "bad")


def _sql() -> str:
    bare = f"regexp_replace(host, '{_PORT}', '')"
    fits = lambda t: f"((host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}'))"
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "block"))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{k}'" for k, t in ordered) + " END"
    weight = f"""CASE WHEN coalesce(sum(n), 0) = 0 OR sum(n) <= sum(n * n) / sum(n) THEN {MOST_WEIGHT}
      WHEN sum(pow(bad - n * prior, 2) / n) - sum(prior * (1 - prior)) <= 0 THEN {MOST_WEIGHT}
      ELSE least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, sum(n * prior * (1 - prior)) / sum(n)
        / ((sum(pow(bad - n * prior, 2) / n) - sum(prior * (1 - prior))) / (sum(n) - sum(n * n) / sum(n))) - 1)) END"""
    return f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
o AS (SELECT host, bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})([^0-9]|$)', 1), '') AS BIGINT) AS doc_id FROM p) JOIN l USING (doc_id)),
h AS (SELECT host, coalesce(n, 0)::DOUBLE AS n, coalesce(bad, 0)::DOUBLE AS bad,
        CASE WHEN regexp_matches({bare}, '{_ADDRESS}') THEN '' ELSE regexp_extract({bare}, '(?:^|\\.)({LONG_SUFFIXES}|[^.]*)$', 1) END AS suffix,
        CASE WHEN regexp_matches({bare}, '{_ADDRESS}') THEN {bare} ELSE regexp_extract({bare}, '([^.]*\\.(?:{LONG_SUFFIXES})|[^.]*\\.[^.]*|[^.]*)$', 1) END AS domain
      FROM (SELECT DISTINCT host FROM p) LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS bad FROM o GROUP BY 1) USING (host)),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM h) AS prior FROM h GROUP BY 1),
sw AS (SELECT {weight} AS w FROM s WHERE n > 0),
sp AS (SELECT suffix, (bad + w * prior) / (n + w) AS prior FROM s, sw),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM h JOIN sp USING (suffix) GROUP BY 1, 2),
dw AS (SELECT {weight} AS w FROM d WHERE n > 0),
dp AS (SELECT suffix, domain, (bad + w * prior) / (n + w) AS prior FROM d, dw),
x AS (SELECT host, n, bad, prior FROM h JOIN dp USING (suffix, domain)),
xw AS (SELECT {weight} AS w FROM x WHERE n > 0),
m AS (SELECT host, n, w, (bad + w * prior) / (n + w) AS mean FROM x, xw)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({verdict}, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (n + w + 1)) > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN m USING (host)"""


SQL = _sql()
