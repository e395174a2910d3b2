"""URLs: validity, parts, evidence, rewriting."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the address that serves entries by id.
ENTRY_QUERY = "http://export.arxiv.org/api/query?id_list="
#: (pattern, captured group) of addresses that are rewritten to it.
REWRITES = ((r"arxiv\.org/abs/(.*)\z", 1), (r"doi.+arXiv\.(.*)\z", 1))
#: Types of resources that a page may ask for.
RESOURCE_TYPES = (
    "cspviolationreport", "document", "eventsource", "fetch", "font", "image", "manifest", "media", "other",
    "ping", "preflight", "script", "stylesheet", "signedexchange", "texttrack", "websocket", "xhr", "prefetch",
)


def is_url(s: Column) -> Column:
    """No blank anywhere (ends included), a scheme and something after it; http and its like need a host."""
    special = s.rlike(r"(?i)\A(https?|ftp|wss?):") & s.rlike(r"(?i)\A[a-z]+:[/\\]*[^/\\?#:@][^/\\?#]*")
    other = s.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:") & ~s.rlike(r"(?i)\A(https?|ftp|wss?):")
    return F.coalesce(~F.contains(s, F.lit(" ")) & (special | other), F.lit(False))


def host(url: Column) -> Column:
    """The host in lower case without user and port, or null if the address has none."""
    out = F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    return F.when(~F.contains(url, F.lit(" ")) & (out != ""), out)


def host_and_port(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_evidence(url: Column) -> Column:
    """Host and the first two path segments as evidence; the last segment doesn't count, a missing one is ``undefined``."""
    parts = F.split(path(url), "/")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    segment = lambda i: F.coalesce(F.get(inner, F.lit(i)), F.lit("undefined"))
    return F.array(F.concat(F.lit("url:host:"), host_and_port(url)), F.concat(F.lit("url:path1:"), segment(1)), F.concat(F.lit("url:path2:"), segment(2)))


def rewrite_url(url: Column) -> Column:
    """The address to fetch instead: the first rewriting that matches, else the url itself."""
    out = url
    for pattern, group in reversed(REWRITES):
        out = F.when(url.rlike(pattern), F.concat(F.lit(ENTRY_QUERY), F.regexp_extract(url, pattern, group))).otherwise(out)
    return out


def blocked_types(allowed: list[str]) -> Column:
    """Resource types that are not allowed, in their fixed order."""
    return F.array_except(F.array(*map(F.lit, RESOURCE_TYPES)), F.array(*map(F.lit, allowed)).cast("array<string>"))


def request_verdict(resource_type: Column, url: Column, blocked: Column) -> Column:
    """``aborted`` for a blocked type, ``blockedbyclient`` for an address that would be rewritten, else ``continue``."""
    rewritten = F.lit(False)
    for pattern, _ in REWRITES:
        rewritten = rewritten | url.rlike(pattern)
    return F.when(F.array_contains(blocked, resource_type), F.lit("aborted")).when(rewritten, F.lit("blockedbyclient")).otherwise(F.lit("continue"))


def resolve(value: str | None, base: str | None) -> str | None:
    """``value`` against ``base`` as an absolute address, or None where it isn't one."""
    if value is None or " " in value:
        return None
    try:
        out = urljoin(base or "", value)
        parts = urlsplit(out)
    except ValueError:
        return None
    if not parts.scheme or (parts.scheme in ("http", "https", "ftp") and not parts.netloc):
        return None
    return out + "/" * (parts.path == "" and not parts.query and not parts.fragment and bool(parts.netloc))


@F.pandas_udf(StringType())
def _resolve_all(values, bases):  # type: ignore[no-untyped-def]
    import pandas as pd

    return pd.Series([resolve(v, b) for v, b in zip(values, bases, strict=True)])


def to_url(value: Column, base: Column) -> Column:
    """Resolved in Arrow batches; null where the result is no address."""
    return _resolve_all(value, base)


def fetch_chain(links: Column) -> Column:
    """The redirect chain without links that had no response."""
    return F.filter(links, lambda x: x["responseUrl"].isNotNull())
