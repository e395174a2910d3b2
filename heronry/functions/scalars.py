"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space and line ends that ECMAScript's trim removes, as a Java and RE2 character class.
JS_SPACE = r"\s\x{0B}\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def hash_path(s: Column, depth: int = 3) -> Column:
    """Leading hex digits of the SHA-1 as folders, then the whole digest with .d: ``8/9/d/89d...d``."""
    h = F.sha1(s)
    return F.concat_ws("/", *(F.substring(h, i + 1, 1) for i in range(depth)), F.concat(h, F.lit(".d")))


def leading_path(s: Column, depth: int = 2) -> Column:
    return F.concat_ws("/", *(F.substring(F.sha1(s), i + 1, 1) for i in range(depth)))


def strip_margin(s: Column) -> Column:
    """Drops blanks up to and including a leading bar, line by line."""
    return F.regexp_replace(s, r"(?m)^ *\|", "")


def brace_slice(s: Column) -> Column:
    """From the first { to the last }, else null."""
    out = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.when(out != "", out)


def parse_json(s: Column, schema: str) -> Column:
    """Parsed, or null where the text is no JSON."""
    return F.from_json(s, schema, {"mode": "PERMISSIVE"})


def format_time(ms: Column) -> Column:
    """Epoch milliseconds as ``3 Jan 2024 5:7:9``, without padding, in UTC."""
    return F.date_format(F.timestamp_millis(ms), "d MMM yyyy H:m:s")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def elapsed_ms(later: Column, earlier: Column) -> Column:
    return F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))


def pad_end(s: Column, n: int) -> Column:
    """Pads with blanks up to n characters, and leaves longer text whole."""
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, " "))


def pad_start(s: Column, n: int) -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, " "))


def clip_query(url: Column) -> Column:
    """The query string cut short, for logs."""
    return F.regexp_replace(url, r"(?s)\?.*\z", "?...")


def short_format(s: Column, n: int = 50) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def interval_ms(s: Column) -> Column:
    """``3d+2h+5m+10s+23z`` in milliseconds (z); units in any order, each at most once; null where no unit is found."""
    units = {"d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1_000, "z": 1}
    part = {u: F.regexp_extract(s, rf"(\d+){u}", 1) for u in units}
    total = sum((F.when(part[u] != "", part[u].cast("long") * k).otherwise(F.lit(0)) for u, k in units.items()), F.lit(0).cast("long"))
    return F.when(s.rlike(r"\d+[dhmsz]"), total)


def job_name(s: Column, suffix: str = "Job") -> Column:
    """Words in upper camel case, with a suffix."""
    return F.concat(F.regexp_replace(F.initcap(F.regexp_replace(s, r"[^A-Za-z0-9]+", " ")), " ", ""), F.lit(suffix))


def status_class(status: Column) -> Column:
    """``20x`` to ``50x`` by the first digit; ``0x`` where there is no status."""
    return F.concat(F.coalesce(F.substring(status.cast("string"), 1, 1), F.lit("")), F.lit("0x"))


def try_int(s: Column) -> Column:
    return s.try_cast("int")


def pretty(value: Column) -> Column:
    """A struct, map or array as indented JSON."""
    return F.to_json(value, {"pretty": "true"})
