"""Queries over the driver's tables, one or more an operator, each with the SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import cleaning, diff, lines, scalars, urls
from heronry.operators import dispatch, evidence, extract, flow, sequences, state, summary
from heronry.plans.extraction import canonical_fields, extract_fields
from heronry.plans.rules import EXAMPLE, RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, tables: str, make: Callable[..., DataFrame], sql: str | None = None) -> None:
    """A query whose function takes the named tables."""
    QUERIES[name] = lambda spark, sf_dir: make(*(table(spark, sf_dir, t) for t in tables.split()))
    if sql:
        ORACLE_SQL[name] = sql


def column_query(name: str, source: str, key: str, expr: Callable[[], Column], sql: str) -> None:
    """(key, out) with one expression over a table."""
    register(name, source, lambda d: d.select(key, expr().alias("out")), f"SELECT {key}, {sql} AS out FROM {source}")


c, lit = F.col, F.lit

# --- scalars -------------------------------------------------------------------------------------
column_query("url_host", "pages", "page_id", lambda: urls.host(c("url")), "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))")
column_query("hash_path", "pages", "page_id", lambda: scalars.hash_path(c("url")), "substr(sha1(url),1,1)||'/'||substr(sha1(url),2,1)||'/'||substr(sha1(url),3,1)||'/'||sha1(url)||'.d'")
column_query("leading_path", "pages", "page_id", lambda: scalars.leading_path(c("url")), "substr(sha1(url),1,1)||'/'||substr(sha1(url),2,1)")
column_query("sha1_hex", "documents", "doc_id", lambda: F.sha1("text"), "sha1(text)")
column_query("strip_margin", "documents", "doc_id", lambda: scalars.strip_margin(F.replace("text", lit("\n"), lit("\n  |"))), "regexp_replace(replace(text, chr(10), chr(10) || '  |'), '(?m)^ *\\|', '', 'g')")
column_query("brace_slice", "events", "event_id", lambda: scalars.brace_slice(F.concat(lit("x = "), c("props"), lit("; y"))), "nullif(regexp_extract('x = ' || props || '; y', '(\\{.*\\})', 1, 's'), '')")
column_query("parse_json", "events", "event_id", lambda: scalars.parse_json(c("props"), "k long")["k"], "CAST(json_extract_string(props, '$.k') AS BIGINT)")
column_query("format_time", "events", "event_id", lambda: scalars.format_time(F.unix_millis(c("ts").cast("timestamp"))), "strftime(ts, '%-d %b %Y %-H:%-M:%-S')")
column_query("format_day", "events", "event_id", lambda: scalars.day(c("ts")), "strftime(ts, '%Y-%m-%d')")
column_query("elapsed_ms", "events", "event_id", lambda: scalars.elapsed_ms(c("ts"), lit("2024-01-01").cast("timestamp")), "epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01') // 1000")
column_query("pad_end", "customer", "c_custkey", lambda: scalars.pad_end(c("c_custkey").cast("string"), 3), "CASE WHEN length(c_custkey::VARCHAR) >= 3 THEN c_custkey::VARCHAR ELSE rpad(c_custkey::VARCHAR, 3, ' ') END")
column_query("pad_start", "customer", "c_custkey", lambda: scalars.pad_start(c("c_custkey").cast("string"), 3), "CASE WHEN length(c_custkey::VARCHAR) >= 3 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 3, ' ') END")
column_query("clip_query", "pages", "page_id", lambda: scalars.clip_query(c("url")), "regexp_replace(url, '\\?.*$', '?...', 's')")
column_query("short_format", "documents", "doc_id", lambda: scalars.short_format(c("text")), "CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END")
column_query("js_trim", "documents", "doc_id", lambda: scalars.js_trim(F.concat(lit("\t  "), c("text"), lit("\r\n"))), "regexp_replace(chr(9) || ' ' || chr(160) || text || chr(13) || chr(10), '^[\\s\\x{0B}\\x{A0}]+|[\\s\\x{0B}\\x{A0}]+$', '', 'g')")
_interval = lambda: F.concat((c("event_id") % 5).cast("string"), lit("h+"), (c("event_id") % 50).cast("string"), lit("s+"), c("user_id").cast("string"), lit("z"))
column_query("interval_ms", "events", "event_id", lambda: scalars.interval_ms(_interval()), "CAST((event_id % 5) * 3600000 + (event_id % 50) * 1000 + user_id AS BIGINT)")
column_query("status_class", "events", "event_id", lambda: scalars.status_class(F.when(c("event_id") % 7 != 0, 200 + c("event_id") % 400)), "CASE WHEN event_id % 7 <> 0 THEN substr((200 + event_id % 400)::VARCHAR, 1, 1) || '0x' ELSE '0x' END")
column_query("try_int", "documents", "doc_id", lambda: scalars.try_int(F.when(c("doc_id") % 3 == 0, c("n_chars").cast("string")).otherwise(lit("n/a"))), "CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS INTEGER) END")
column_query("job_name", "events", "event_id", lambda: scalars.job_name(F.concat(c("event_type"), lit("-run"))), "upper(substr(event_type, 1, 1)) || substr(event_type, 2) || 'RunJob'")

# --- addresses ------------------------------------------------------------------------------------
_odd_url = lambda: F.when(c("page_id") % 4 == 1, F.concat(lit(" "), c("url"))).when(c("page_id") % 4 == 2, lit("no-url")).when(c("page_id") % 4 == 3, F.concat(lit("mailto:a"), c("page_id").cast("string"))).otherwise(c("url"))
column_query("is_url", "pages", "page_id", lambda: urls.is_url(_odd_url()), "page_id % 4 IN (0, 3)")
column_query("url_evidence", "pages", "page_id", lambda: F.array_join(urls.url_evidence(c("url")), " "), """
 'url:host:' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || ' url:path1:' ||
 CASE WHEN len(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) > 2 THEN string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[2] ELSE 'undefined' END || ' url:path2:' ||
 CASE WHEN len(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) > 3 THEN string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[3] ELSE 'undefined' END""")
_paper_url = lambda: F.when(c("page_id") % 3 == 0, F.concat(lit("https://arxiv.org/abs/"), c("page_id").cast("string"))).when(c("page_id") % 3 == 1, F.concat(lit("https://doi.org/10.48550/arXiv."), c("page_id").cast("string"))).otherwise(c("url"))
column_query("url_rewrite", "pages", "page_id", lambda: urls.rewrite_url(_paper_url()), f"CASE WHEN page_id % 3 < 2 THEN '{urls.ENTRY_QUERY}' || page_id ELSE url END")
_types = ", ".join(f"'{t}'" for t in urls.RESOURCE_TYPES)
column_query("blocked_types", "region", "r_regionkey", lambda: F.array_join(urls.blocked_types(["document", "script"]), ","), f"array_to_string(list_filter([{_types}], lambda x: x NOT IN ('document', 'script')), ',')")
column_query(
    "request_verdict", "pages", "page_id", lambda: urls.request_verdict(F.get(F.array(*map(lit, urls.RESOURCE_TYPES)), (c("page_id") % 18).cast("int")), _paper_url(), urls.blocked_types(["document", "script", "xhr"])),
    f"CASE WHEN [{_types}][page_id % 18 + 1] NOT IN ('document', 'script', 'xhr') THEN 'aborted' WHEN page_id % 3 < 2 THEN 'blockedbyclient' ELSE 'continue' END",
)
register("resolve_links", "pages", lambda p: p.select("page_id", urls.to_url(F.concat(lit("/p/"), c("page_id").cast("string")), c("url")).alias("out")), "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/p/' || page_id AS out FROM pages")
register(
    "fetch_chain", "orders",
    lambda o: o.select("o_orderkey", F.array_join(F.transform(urls.fetch_chain(F.transform(F.sequence(lit(1), (c("o_orderkey") % 5 + 1).cast("int")), lambda i: F.struct(F.when(i % 2 == 0, i.cast("string")).alias("responseUrl")))), lambda x: x["responseUrl"]), ",").alias("urls")),
    "SELECT o_orderkey, array_to_string(list_transform(range(1, (o_orderkey % 5 + 1) // 2 + 1), lambda i: i * 2), ',') AS urls FROM orders",
)

# --- dataflow ------------------------------------------------------------------------------------
register("compose_through_filter", "documents", lambda d: flow.compose(flow.through("half", F.floor(c("n_chars") / 2)), flow.keep_if(c("half") > 500), flow.map_env(doc_id=c("doc_id"), half=c("half").cast("long")))(d), "SELECT doc_id, CAST(n_chars // 2 AS BIGINT) AS half FROM documents WHERE n_chars // 2 > 500")
_even, _big, _third = (lambda x: F.when(x % 2 == 0, x + 1)), (lambda x: F.when(x > 500, x * 2)), (lambda x: F.when(x % 3 == 0, -x))
column_query("each_or_else", "documents", "doc_id", lambda: flow.each_or_else(c("doc_id"), _even, _big, _third), "CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 WHEN doc_id > 500 THEN doc_id * 2 WHEN doc_id % 3 = 0 THEN -doc_id END")
column_query("collect_fanout", "documents", "doc_id", lambda: F.array_join(flow.collect_fanout(c("doc_id"), _even, _big, _third), ","), "array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 END, CASE WHEN doc_id > 500 THEN doc_id * 2 END, CASE WHEN doc_id % 3 = 0 THEN -doc_id END], lambda x: x IS NOT NULL), ',')")
column_query("for_each_do", "documents", "doc_id", lambda: F.array_join(flow.for_each_do(F.sequence(c("doc_id"), c("doc_id") + 5), _even), ","), "array_to_string(list_transform(list_filter(range(doc_id, doc_id + 6), lambda x: x % 2 = 0), lambda x: x + 1), ',')")
column_query("take_while_success", "documents", "doc_id", lambda: flow.take_while_success(c("doc_id"), _even, lambda x: x % 3 == 0), "CASE WHEN doc_id % 6 = 0 THEN doc_id END")
column_query("first_success", "documents", "doc_id", lambda: flow.first_success([(c("n_chars") > 5000, lit("long")), (c("n_chars") > 1000, lit("middle")), (lit(True), lit("short"))]), "CASE WHEN n_chars > 5000 THEN 'long' WHEN n_chars > 1000 THEN 'middle' ELSE 'short' END")
register("control_codes", "documents", lambda d: flow.through_left("control", F.struct(lit("continue").alias("code"), c("control.msg").alias("msg")))(d.select("doc_id", F.when(c("n_chars") < 300, flow.control(lit("halt"), lit("short"))).alias("control"))).select("doc_id", c("control.code").alias("code"), c("control.msg").alias("msg")), "SELECT doc_id, CASE WHEN n_chars < 300 THEN 'continue' END AS code, CASE WHEN n_chars < 300 THEN 'short' END AS msg FROM documents")
register("status_and_url_filter", "pages", lambda p: p.withColumn("status", F.when(c("page_id") % 3 == 0, lit("404")).otherwise(lit("200"))).filter((c("status") == "200") & (c("url").rlike(r"example\.net") | c("url").rlike("/fr/"))).select("page_id", "url"), "SELECT page_id, url FROM pages WHERE page_id % 3 <> 0 AND (regexp_matches(url, 'example\\.net') OR regexp_matches(url, '/fr/'))")
register("dispatch_rules", "pages", lambda p: p.select("page_id", extract.dispatch(c("url"), F.when(c("page_id") % 5 == 0, lit("500")).otherwise(lit("200")), (*RULES, EXAMPLE)).alias("rule")), "SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN CASE WHEN regexp_matches(url, 'example\\.(com|net|org)') THEN 'example' ELSE 'general' END END AS rule FROM pages")

register("dispatch_many", "pages", lambda p: dispatch.dispatch_many(p.select("page_id", "url"), [(f"n{k}", rf"/[a-z]{{2}}/{k}\b") for k in range(100, 1100)], "general").drop("url"), r"""
 SELECT page_id, CASE WHEN n BETWEEN 100 AND 1099 THEN 'n' || n ELSE 'general' END AS rule FROM (SELECT page_id, try_cast(regexp_extract(url, '/[a-z]{2}/([1-9][0-9]*)\b', 1) AS INT) AS n FROM pages)""")

# --- lines ---------------------------------------------------------------------------------------
_l = "string_split(text, chr(10))"
_pos = lambda p: f"list_position(list_transform({_l}, lambda x: regexp_matches(x, '{p}')), true)"


def line_query(name: str, expr: Callable[[Column], Column], sql: str) -> None:
    column_query(name, "documents", "doc_id", lambda: lines.join_lines(expr(lines.split_lines(c("text"))), "\n"), f"array_to_string({sql}, chr(10))")


line_query("grep_filter", lambda x: lines.grep(x, "th"), f"list_filter({_l}, lambda x: regexp_matches(x, 'th'))")
line_query("grep_filter_not", lambda x: lines.grep_not(x, "th"), f"list_filter({_l}, lambda x: NOT regexp_matches(x, 'th'))")
line_query("grep_drop_until", lambda x: lines.grep_drop_until(x, "and"), f"CASE WHEN coalesce({_pos('and')}, 0) > 0 THEN {_l}[{_pos('and')}:] ELSE [] END")
line_query("grep_take_until", lambda x: lines.grep_take_until(x, "and"), f"CASE WHEN coalesce({_pos('and')}, 0) > 0 THEN list_slice({_l}, 1, {_pos('and')} - 1) ELSE {_l} END")
line_query("drop_n", lambda x: lines.drop_n(x, 2), f"{_l}[3:]")
_at = f"coalesce(list_filter(range(0, len({_l})), lambda i: regexp_matches({_l}[i + 1], 'e') AND coalesce(regexp_matches({_l}[i + 2], 'a'), false))[1], -1)"
column_query("multi_match_index", "documents", "doc_id", lambda: lines.multi_match_index(lines.split_lines(c("text")), ["e", "a"]).cast("long"), f"CAST({_at} AS BIGINT)")
line_query("multi_drop_until", lambda x: lines.multi_drop_until(x, ["e", "a"], False), f"CASE WHEN {_at} >= 0 THEN list_slice({_l}, {_at} + 3, len({_l})) ELSE [] END")
line_query("multi_drop_until_with", lambda x: lines.multi_drop_until(x, ["e", "a"], True), f"CASE WHEN {_at} >= 0 THEN list_slice({_l}, {_at} + 1, len({_l})) ELSE [] END")
line_query("multi_take_until", lambda x: lines.multi_take_until(x, ["e", "a"], False), f"CASE WHEN {_at} >= 0 THEN list_slice({_l}, 1, {_at}) ELSE [] END")
line_query("multi_take_until_with", lambda x: lines.multi_take_until(x, ["e", "a"], True), f"CASE WHEN {_at} >= 0 THEN list_slice({_l}, 1, {_at} + 2) ELSE [] END")
_tags = "[' <p>', '<b> </b>', '  <div class=\"x\">', text, '    <a href=\"/p/' || doc_id || '\">x</a>']"
_tag_lines = lambda: F.array(lit(" <p>"), lit("<b> </b>"), lit('  <div class="x">'), c("text"), F.concat(lit('    <a href="/p/'), c("doc_id").cast("string"), lit('">x</a>')))
column_query("bare_tag_lines", "documents", "doc_id", lambda: lines.join_lines(lines.without_bare_tags(_tag_lines()), "\n"), f"array_to_string(list_filter({_tags}, lambda x: NOT regexp_matches(x, '^[ ]*(</?\\w{{1,4}}>[ ]*)+$')), chr(10))")
column_query("tag_lines", "documents", "doc_id", lambda: lines.join_lines(lines.without_tag_lines(_tag_lines()), "\n"), f"array_to_string(list_filter({_tags}, lambda x: NOT regexp_matches(x, '^[ ]+<.*>[ ]*$')), chr(10))")
column_query("anchor_href", "documents", "doc_id", lambda: lines.anchor_href(lines.join_lines(lines.anchor_lines(_tag_lines()))), "'/p/' || doc_id")
_row = lambda: F.array(lit("<tr>"), lit("<th>"), lit("Title"), lit("</th>"), lit("<td>"), F.concat(lit("t"), c("doc_id").cast("string")), lit("</td>"))
column_query("second_cell", "documents", "doc_id", lambda: lines.join_lines(lines.second_cell(_row(), "Title")), "'t' || doc_id")
register(
    "match_offsets", "documents", lambda d: d.select("doc_id", F.array_join(F.transform(diff.match_offsets(c("text"), "the"), lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), ",").alias("out")),
    "SELECT doc_id, array_to_string(list_transform(range(1, len(p)), lambda i: (list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + 3 * (i - 1))::BIGINT || '-' || (list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + 3 * i)::BIGINT), ',') AS out FROM (SELECT doc_id, string_split(text, 'the') AS p FROM documents)",
)
_changes_text = lambda a, b: F.array_join(F.transform(diff.changes(a, b), lambda x: F.concat_ws(":", x["kind"], x["value"], x["count"].cast("string"))), "|")
register(
    "diff_chars", "documents", lambda d: d.select("doc_id", _changes_text(c("text"), F.concat(lit("\x01\x02"), c("text"))).alias("ahead"), _changes_text(F.concat(c("text"), lit("\x01")), c("text")).alias("behind")),
    "SELECT doc_id, 'add:' || chr(1) || chr(2) || ':2' || CASE WHEN text = '' THEN '' ELSE '|same:' || text || ':' || length(text) END AS ahead, CASE WHEN text = '' THEN '' ELSE 'same:' || text || ':' || length(text) || '|' END || 'remove:' || chr(1) || ':1' AS behind FROM documents",
)

# --- cleaning -------------------------------------------------------------------------------------
_AFFIX = ("Abstract ", "motivation", "", "", "-- ", "x Cite This Paper Abstract ", "", "", "", "", "a   b ", "", "", "y Graphical Abstract Download ", "No abstract available ", "Home Archives Abstract ", "")
_TAIL = ("", "", " References foo", " Keywords x", "", " cite this paper abstract z", " Comments 3 Comments bye", " <etx a", " <", "", "", " Full Text: PDF", " Related Material k", "", "", "", "")
_pick = lambda options: F.get(F.array(*map(lit, options)), (c("doc_id") % len(options)).cast("int"))
_sql_pick = lambda options: "[" + ", ".join(f"'{o}'" for o in options) + f"][doc_id % {len(options)} + 1]"
_dirty = lambda: F.concat(_pick(_AFFIX), c("text"), _pick(_TAIL))
_sql_dirty = f"{_sql_pick(_AFFIX)} || text || {_sql_pick(_TAIL)}"
_D, _T = "[^\\n\\r\\x{2028}\\x{2029}]", "[\\s\\x{0B}\\x{A0}]"
_sql_trim = lambda s: f"regexp_replace({s}, '^{_T}+|{_T}+$', '', 'g')"
_sql_cut = lambda p: f"regexp_replace(s, '{p}', '')"
_CITED_TEXT = "coalesce(regexp_split_to_array(s, '(?i)cite this paper abstract')[2], '')"
_BEFORE_GRAPHIC = "regexp_split_to_array(s, '(?i)graphical abstract download')[1]"
_AFTER_ABSTRACT = "coalesce(string_split(s, 'Abstract')[2], '')"
_CLEAN_SQL = (
    _sql_cut("(?i)^abstract *"), _sql_cut("(?i)^motivation *"), _sql_cut(f"(References|REFERENCES){_D}*$"), _sql_cut(f"Keywords{_D}*$"), _sql_cut("^\\W+"),
    f"CASE WHEN regexp_matches(s, '(?i)cite this paper abstract') THEN {_sql_trim(_CITED_TEXT)} ELSE s END",
    _sql_cut(f"(?i)comments[\\d ]+comments{_D}*$"), _sql_cut(f"(?i)<etx{_D}*$"), _sql_cut("<$"), "replace(s, chr(10), ' ')", "regexp_replace(s, ' +', ' ', 'g')",
    _sql_cut(f"Full Text:{_D}*$"), _sql_cut(f"Related Material{_D}*$"),
    f"CASE WHEN regexp_matches(s, '(?i)graphical abstract download') THEN {_sql_trim(_BEFORE_GRAPHIC)} ELSE s END",
    "CASE WHEN " + " OR ".join(f"regexp_matches(s, '{p.replace(r"\A", "^")}')" for p in cleaning.CATCH_ALLS) + " THEN '' ELSE s END",
    f"CASE WHEN regexp_matches(s, '^Home Archives') THEN {_sql_trim(_AFTER_ABSTRACT)} ELSE s END",
    f"CASE WHEN length(s) < {cleaning.SHORTEST} THEN '' ELSE s END",
)
for _i, _r in enumerate(cleaning.ABSTRACT_RULES):
    register(f"clean_rule_{_i + 1:02d}", "documents", lambda d, r=_r: d.select("doc_id", r.apply(_dirty()).alias("out")), f"SELECT doc_id, {_CLEAN_SQL[_i]} AS out FROM (SELECT doc_id, {_sql_dirty} AS s FROM documents)")
_steps = [f"s0 AS (SELECT doc_id, {_sql_dirty} AS s, '' AS fired FROM documents)"]
for _i, _r in enumerate(cleaning.ABSTRACT_RULES):
    _name = _r.name.replace("'", "''")
    _steps.append(f"s{_i + 1} AS (SELECT doc_id, v AS s, CASE WHEN v <> s THEN fired || '{_name};' ELSE fired END AS fired FROM (SELECT doc_id, s, fired, {_CLEAN_SQL[_i]} AS v FROM s{_i}))")
register("clean_abstract", "documents", lambda d: cleaning.with_cleaned(d.select("doc_id", _dirty().alias("dirty")), "dirty").select("doc_id", "value", F.concat(F.array_join("fired", ";"), F.when(F.size("fired") > 0, lit(";")).otherwise(lit(""))).alias("fired")), f"WITH {', '.join(_steps)} SELECT doc_id, s AS value, fired FROM s{len(cleaning.ABSTRACT_RULES)}")

# --- documents as trees, evidence -----------------------------------------------------------------
_H1 = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
_unescape = lambda s: f"replace(replace({s}, '&quot;', '\"'), '&amp;', '&')"
register("css_text", "pages", lambda p: p.select("page_id", F.get(extract.css_text(c("html"), lit("article > h1")), lit(0)).alias("h1")), f"SELECT page_id, trim({_unescape(_H1)}) AS h1 FROM pages")
register("css_attr", "pages", lambda p: p.select("page_id", F.posexplode(extract.css_attr(c("html"), lit("nav li > a"), lit("href"))).alias("pos", "href")).select("page_id", c("pos").cast("long").alias("pos"), "href"), "SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages))")
register("css_outer", "pages", lambda p: p.select("page_id", F.get(extract.css_outer(c("html"), lit("title")), lit(0)).alias("out")), "SELECT page_id, replace(regexp_extract(html, '<title>[^<]*</title>'), '&quot;', '\"') AS out FROM pages")
register(
    "tidy_html", "documents", lambda d: d.select("doc_id", extract.tidy_html(F.concat(lit("<p>t"), c("doc_id").cast("string"), lit(" <b>x\n y</b><div>"), c("lang"), lit("<br>z</div><ul><li>1<li>2</ul>"))).alias("out")),
    "SELECT doc_id, array_to_string(['<html>', '    <body>', '        <p>', '            t' || doc_id || ' <b>x y</b>', '        </p>', '        <div>', '            ' || lang || '<br />z', '        </div>', '        <ul>', '            <li>', '                1', '            </li>', '            <li>', '                2', '            </li>', '        </ul>', '    </body>', '</html>'], chr(10)) AS out FROM documents",
)
register("page_titles", "pages", lambda p: canonical_fields(p).filter("name = 'title'").select("page_id", "value"), f"SELECT page_id, trim({_unescape(_H1)}) AS value FROM pages")
register("pdf_links", "pages", lambda p: extract_fields(p, (*RULES, EXAMPLE)).filter("name = 'pdf-link'").select("page_id", "value"), "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS value FROM pages")
_ARTICLE = "list_transform(string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')[2:], lambda x: trim(" + _unescape("regexp_replace(x, '<[^>]*>', '', 'g')") + ", ' ' || chr(10)))"
_paper = [f"s0 AS (SELECT page_id, url, html, trim(array_to_string({_ARTICLE}, chr(10)), ' ' || chr(10)) AS s, '' AS fired FROM pages)"]
for _i, _r in enumerate(cleaning.ABSTRACT_RULES):
    _name = _r.name.replace("'", "''")
    _paper.append(f"s{_i + 1} AS (SELECT page_id, url, html, v AS s, CASE WHEN v <> s THEN fired || ' | clean: {_name}' ELSE fired END AS fired FROM (SELECT page_id, url, html, s, fired, {_CLEAN_SQL[_i]} AS v FROM s{_i}))")
_label = "article > h1 ++ article p ++ nav a?"
_paper.append(f"""f AS (
 SELECT page_id, 1 AS place, 'title' AS name, trim({_unescape(_H1)}) AS value, 'input:response-body | select:$(article > h1) | {_label}' AS evidence FROM pages UNION ALL
 SELECT page_id, 2, 'abstract', s, 'input:response-body | page.$$(article p) | {_label}' || fired FROM s{len(cleaning.ABSTRACT_RULES)} UNION ALL
 SELECT page_id, 3, 'pdf-link', regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)), 'input:response-body | select-all:$(nav a).attr(href) | {_label}' FROM pages)""")
_first = "SELECT page_id, place, name, any_value(value) AS value, any_value(evidence) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY page_id, place ORDER BY i) AS k FROM (SELECT *, row_number() OVER () AS i FROM f WHERE value <> '')) WHERE k = 1 GROUP BY 1, 2, 3"
register("canonical_fields", "pages", lambda p: canonical_fields(p).withColumn("evidence", F.array_join("evidence", " | ")), f"WITH {', '.join(_paper)} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) AS seq, name, value, evidence FROM ({_first})")
register("canonical_rows", "pages", lambda p: evidence.canonical(extract_fields(p, (*RULES, EXAMPLE))).filter("name = 'title'").select("page_id", "seq", "name"), "SELECT page_id, CAST(1 AS BIGINT) AS seq, 'title' AS name FROM pages")
register("field_counts", "pages", lambda p: extract_fields(p, (*RULES, EXAMPLE)).groupBy("name").agg(F.count("*").alias("n")), f"WITH {', '.join(_paper)} SELECT name, count(*) AS n FROM f WHERE value <> '' GROUP BY 1")
register("field_map", "pages", lambda p: evidence.field_map(extract_fields(p, (*RULES, EXAMPLE))).filter("name = 'pdf-link'").select("page_id", F.size("values").cast("long").alias("n")), "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"')) AS BIGINT) AS n FROM pages")
register("evidence_summary", "pages", lambda p: evidence.evidence_summary(extract_fields(p, (*RULES, EXAMPLE)).filter("name = 'title'")), "SELECT 'title' AS name, unnest(['input:response-body', 'select:$(article > h1)', 'article > h1 ++ article p ++ nav a?']) AS evidence, (SELECT count(*) FROM pages) AS n")


_LONG = "We study a thing. " * 15 + "@"
_META = '<meta name="citation_title" content="T@"><meta name="citation_author" content="A@"><meta name="citation_author" content="B"><meta name="citation_pdf_url" content="/x@.pdf">'
_DC = '<meta name="DC.Title" content="T@"><meta name="dc.Creator" content="A@"><meta name="dc.creator" content="B">'
_CITED = {"title": (("title", "T@", 'select:$(meta[name="citation_title"])'),), "author": (("author", "A@", 'select-all:$(meta[name="citation_author"])'), ("author", "B", 'select-all:$(meta[name="citation_author"])')), "pdf": (("pdf-link", "/x@.pdf", 'select:$(meta[name="citation_pdf_url"])'),)}
_CORE = {"title": (("title", "T@", 'select:$(meta[name="DC.Title"])'),), "author": (("author", "A@", 'select-all:$(meta[name="DC.Creator"])'), ("author", "B", 'select-all:$(meta[name="DC.Creator"])'))}
_JSON = (("title", "T@", "metadata:title"), ("abstract", _LONG, "metadata:abstract"), ("author", "A@", "metadata:author"), ("author", "B", "metadata:author"))
_all_cited = lambda source: (*_CITED["title"], *_CITED["author"], *_CITED["pdf"], ("abstract", _LONG, source))
#: rule -> (address, page, (field, value, the evidence it was found by) in order); @ stands for the document's number, and links are relative to the host.
RULE_PAGES: dict[str, tuple[str, str, tuple[tuple[str, str], ...]]] = {
    "arxiv": ("http://export.arxiv.org", f'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T@</title><summary>{_LONG}</summary><link href="/y"/><link type="application/pdf" href="/x@.pdf"/></entry></feed>', (("abstract", _LONG, "xml:select:'feed.entry.0.summary'"), ("title", "T@", "xml:select:'feed.entry.0.title'"), ("pdf-link", "/x@.pdf", "xml:feed.entry[0].link[]"))),
    "sciencedirect": ("https://www.sciencedirect.com", f'{_META}<meta property="og:description" content="cut @"><div class="Abstracts">{_LONG}</div><a class="author">C@</a>', (*_CITED["title"], ("abstract-clipped", "cut @", 'select:$(meta[property="og:description"])'), ("abstract", _LONG, "select:$(.Abstracts)"), ("author", "C@", "select:$(a.author)"))),
    "acm": ("https://dl.acm.org", f'{_DC}<div class="abstractInFull">{_LONG}</div><a title="PDF" href="/x@.pdf">p</a>', (*_CORE["title"], ("abstract", _LONG, "select:$(.abstractInFull)"), *_CORE["author"], ("pdf-link", "/x@.pdf", 'page.$(a[title="PDF"]).attr(href)'))),
    "aclweb": ("https://www.aclweb.org", f'{_META}<div class="acl-abstract">{_LONG}</div>', _all_cited("select:$(.acl-abstract)")),
    "ijcai": ("https://www.ijcai.org", f'{_META}<div class="col-md-12">{_LONG}</div>', (*_CITED["title"], *_CITED["author"], ("abstract", _LONG, "select:$(div.col-md-12)"))),
    "mitpress": ("https://www.mitpressjournals.org", f'{_DC}<a class="show-pdf" href="/x@.pdf">p</a><p class="abstractInFull">{_LONG}</p>', (*_CORE["title"], *_CORE["author"], ("abstract", _LONG, "select:$(.abstractInFull)"), ("pdf-link", "/x@.pdf", 'page.$(a[class="show-pdf"]).attr(href)'))),
    "oup": ("https://academic.oup.com", f'{_META}<section class="abstract"><p class="chapter-para">{_LONG}</p></section>', _all_cited('select:$(section[class="abstract"] p[class="chapter-para"])')),
    "nips": ("https://papers.nips.cc", f"{_META}<h4>Abstract</h4><p>{_LONG}</p>", _all_cited("select:$(h4 + p)")),
    "iospress": ("https://content.iospress.com", f'{_META}<div data-abstract="{_LONG}"></div>', _all_cited("page.$([data-abstract]).attr(data-abstract)")),
    "digitalhumanities": ("http://digitalhumanities.org", f'<h1 class="articleTitle">T@</h1><div class="author">A@</div><div class="author">B</div><div id="abstract">{_LONG}</div>', (("abstract", _LONG, "select:$(#abstract)"), ("title", "T@", "select:$(.articleTitle)"), ("author", "A@", "page.$$(.author)"), ("author", "B", "page.$$(.author)"))),
    "kybernetika": ("https://www.kybernetika.cz", f'<div class="ar_title">T@</div><div class="authors"><a>A@</a><a>B</a></div><p class="abstract">{_LONG}</p>', (("abstract", _LONG, "select:$(.abstract)"), ("title", "T@", "select:$(.ar_title)"), ("author", "A@", "page.$$(.authors a)"), ("author", "B", "page.$$(.authors a)"))),
    "ieee": ("https://ieeexplore.ieee.org", f'<script>\nx.global.document.metadata={{"title":"T@","abstract":"{_LONG}","authors":[{{"name":"A@"}},{{"name":"B"}}],"pdfPath":"/x@.pdf"}};\n</script>', (*_JSON, ("pdf-link", "/x@.pdf", "metadata:pdf-link"))),
    "springer": ("https://link.springer.com", f'{_META}<script type="application/ld+json">{{"headline":"T@","description":"{_LONG}","author":[{{"name":"A@"}},{{"name":"B"}}]}}</script>', _JSON),
    "springer_chapter": ("https://link.springer.com/chapter", f'{_META}<section id="Abs1"><p class="Para">{_LONG}</p></section><meta property="og:description" content="cut @">', (*_CITED["title"], *_CITED["author"], *_CITED["pdf"], ("abstract-clipped", "cut @", 'select:$(meta[property="og:description"])'), ("abstract", _LONG, "select:$(section#Abs1 > p.Para)"))),
    "springer_entry": ("https://link.springer.com/referenceworkentry", f'{_META}<meta property="og:description" content="cut @"><div id="body"><div class="content">{_LONG}</div></div>', (*_CITED["title"], *_CITED["author"], *_CITED["pdf"], ("abstract-clipped", "cut @", 'select:$(meta[property="og:description"])'), ("abstract", _LONG, "page.$$(#body div.content)"))),
    "springer_article": ("https://link.springer.com/article", f'{_META}<meta property="og:description" content="{_LONG}">', (*_CITED["title"], *_CITED["author"], *_CITED["pdf"], ("abstract", _LONG, 'select:$(meta[property="og:description"])'))),
    "neurips": ("https://proceedings.neurips.cc", f"{_META}<div><h4>Abstract</h4><p></p><p>{_LONG}</p></div><div>other</div>", _all_cited("neurips.cc.abstract")),
    "isca": ("https://www.isca-speech.org", f'<div class="w3-card"><h3>T@</h3><h5>A@, B</h5><p>{_LONG}</p><a href="/x@.pdf">pdf</a></div>', (("title", "T@", "isca.title"), ("authors", "A@, B", "isca.authors"), ("pdf-link", "/x@.pdf", "pdf-link"), ("abstract", _LONG, "isca.abstract"))),
    "lrec": ("http://www.lrec-conf.org", f'<table><tr><th>Title</th><td>T@</td></tr><tr><th>Authors</th><td>A@, B</td></tr><tr><th>Abstract</th><td>{_LONG}</td></tr><tr><th>Full Paper</th><td><a href="/x@.pdf"><b>x</b></a></td></tr></table>', (("abstract", _LONG, "abstract"), ("title", "T@", "title"), ("authors-block", "A@, B", "authors-block"), ("pdf-link", "/x@.pdf", "pdf-link"))),
    "cogsci": ("https://cogsci.mindmodeling.org", f"<h2>Abstract</h2><blockquote><p>{_LONG}</p></blockquote>", (("abstract", _LONG, "grepped.abstract"),)),
    "general": ("https://somewhere.org", f'{_DC}<meta name="description" content="{_LONG}"><meta name="citation_pdf_url" content="/x@.pdf">', (*_CORE["title"], ("abstract", _LONG, 'select:$(meta[name="description"])'), *_CORE["author"], *_CITED["pdf"])),
}


def _rule_query(name: str) -> None:
    address, page, fields = RULE_PAGES[name]
    fill = lambda t: F.replace(lit(t), lit("@"), c("doc_id").cast("string"))
    own = lambda e: F.get(F.filter(e, lambda x: ~x.startswith("url:") & ~x.startswith("input:")), lit(0))
    pages = lambda d: d.select(c("doc_id").alias("page_id"), fill(f"{address}/p/@").alias("url"), fill(page).alias("html"))
    make = lambda d: extract_fields(pages(d)).select("page_id", c("seq").cast("long").alias("seq"), "name", "value", own(c("evidence")).alias("source"))
    quoted = lambda x: x.replace("'", "''")
    host = "/".join(address.split("/")[:3])
    rows = " UNION ALL ".join(f"SELECT doc_id AS page_id, CAST({i} AS BIGINT) AS seq, '{f}' AS name, replace('{(host if f == 'pdf-link' else '') + v}', '@', doc_id::VARCHAR) AS value, '{quoted(e)}' AS source FROM documents" for i, (f, v, e) in enumerate(fields))
    register(f"rule_{name}", "documents", make, rows)


for _name in RULE_PAGES:
    _rule_query(_name)


def _example_candidates() -> Column:
    """Three candidates of a document, with evidence by its number."""
    one = lambda i, text, *ev: F.struct(lit(i).alias("seq"), text.alias("text"), F.array(*ev).alias("evidence"), lit(None).cast("string").alias("resolved"))
    return F.array(one(0, c("source"), lit("select:$(meta[name=\"DC.Title\"])")), one(1, c("lang"), F.when(c("doc_id") % 2 == 0, lit("citation_author")).otherwise(lit("url:path1:abstract"))), one(2, c("n_chars").cast("string"), lit("page.$$(.Abstract)")))


column_query("candidates_for", "documents", "doc_id", lambda: F.array_join(F.transform(evidence.candidates_for(_example_candidates(), lit("abstract")), lambda x: x["text"]), ","), "CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR ELSE lang || ',' || n_chars END")
column_query("evidence_exists", "documents", "doc_id", lambda: evidence.evidence_exists(_example_candidates(), F.array(lit("creator"), lit("author")), lit(True)), "doc_id % 2 = 0")
column_query("clear_evidence", "documents", "doc_id", lambda: F.array_join(evidence.clear_evidence(F.array(lit("url:host:x"), lit("input:y"), c("lang")), r"\Aurl:"), " "), "'input:y ' || lang")
column_query(
    "save_evidence", "documents", "doc_id", lambda: F.array_join(F.transform(evidence.save_evidence(_example_candidates(), F.concat(lit(" "), c("lang")), F.array(lit("input:y")), "z"), lambda x: F.concat(x["text"], lit(":"), F.array_join(x["evidence"], "+"))), ","),
    "source || ':select:$(meta[name=\"DC.Title\"]),' || lang || CASE WHEN doc_id % 2 = 0 THEN ':citation_author,' ELSE ':url:path1:abstract,' END || n_chars || ':page.$$(.Abstract),' || lang || ':input:y+z'",
)


def _validated(d: DataFrame) -> DataFrame:
    mapping = F.from_json(lit('[{"url":null,"label":"t ++ a","keys":[{"subs":["DC.Title"],"required":true,"field":"title"},{"subs":["citation_author"],"required":true,"field":"author"}]},{"url":null,"label":"b","keys":[{"subs":["path1","Abstract"],"required":true,"field":"abstract-clipped"}]}]'), evidence.ATTEMPTS)
    d = d.select("doc_id", _example_candidates().alias("cands")).withColumn("attempt", evidence.chosen_attempt(c("cands"), mapping, lit("")))
    return d.select("doc_id", F.posexplode(evidence.matched(c("cands"), c("attempt"))).alias("seq", "f")).select("doc_id", c("seq").cast("long").alias("seq"), "f.name", "f.text")


register("validate_evidence", "documents", _validated, """
 SELECT doc_id, CAST(0 AS BIGINT) AS seq, 'title' AS name, source AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL
 SELECT doc_id, 1, 'author', lang FROM documents WHERE doc_id % 2 = 0 UNION ALL
 SELECT doc_id, 0, 'abstract-clipped', lang FROM documents WHERE doc_id % 2 = 1 UNION ALL
 SELECT doc_id, 1, 'abstract-clipped', lang FROM documents WHERE doc_id % 2 = 1 UNION ALL
 SELECT doc_id, 2, 'abstract-clipped', n_chars::VARCHAR FROM documents WHERE doc_id % 2 = 1""")
_named = lambda: F.array(F.struct(F.when(c("doc_id") % 3 == 0, lit("abstract")).otherwise(lit("other")).alias("name"), c("source").alias("value")), F.struct(lit("abstract-clipped").alias("name"), c("lang").alias("value")), F.struct(lit("pdf-link").alias("name"), c("n_chars").cast("string").alias("value")))
register("canonical_values", "documents", lambda d: d.select("doc_id", evidence.canonical_abstract(_named()).alias("abstract"), evidence.canonical_pdf_link(_named()).alias("pdf")), "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS abstract, n_chars::VARCHAR AS pdf FROM documents")

# --- keyed state ----------------------------------------------------------------------------------
_notes = lambda o: o.select(c("o_orderkey").cast("string").alias("id"), c("o_orderkey").cast("long").alias("number"), (c("o_orderkey") % 3 == 0).alias("validUrl"))
_N = "(SELECT o_orderkey::VARCHAR AS id, o_orderkey::BIGINT AS number, o_orderkey % 3 = 0 AS v FROM orders)"
register("next_valid", "orders", lambda o: state.next_valid(_notes(o), 100).select("number"), f"SELECT number FROM {_N} WHERE v AND number > 100 ORDER BY number LIMIT 1")
register("prev_valid", "orders", lambda o: state.prev_valid(_notes(o), 100).select("number"), f"SELECT number FROM {_N} WHERE v AND number < 100 ORDER BY number DESC LIMIT 1")
register("seek_all", "orders", lambda o: state.seek_all(_notes(o), _notes(o).select("number")), f"SELECT number, min(CASE WHEN v THEN number END) OVER (ORDER BY number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next, max(CASE WHEN v THEN number END) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {_N}")
_cursor = lambda d, at: d.sparkSession.createDataFrame([("extract-fields", at)], "role string, noteNumber long")
register("move_cursor", "orders", lambda o: state.move_cursor(_notes(o), _cursor(o, 100), 5), f"SELECT 'extract-fields' AS role, number AS noteNumber, true AS moved FROM {_N} WHERE v AND number > 100 ORDER BY number LIMIT 1 OFFSET 4")
register("move_cursor_back", "orders", lambda o: state.move_cursor(_notes(o), _cursor(o, 100), -3), f"SELECT 'extract-fields' AS role, number AS noteNumber, true AS moved FROM {_N} WHERE v AND number < 100 ORDER BY number DESC LIMIT 1 OFFSET 2")
register("move_cursor_too_far", "orders", lambda o: state.move_cursor(_notes(o), _cursor(o, 2), -3), "SELECT 'extract-fields' AS role, CAST(2 AS BIGINT) AS noteNumber, false AS moved")
register("move_cursors", "orders", lambda o: state.move_cursors(_notes(o), o.select(F.concat(lit("r"), c("o_orderkey").cast("string")).alias("role"), (c("o_orderkey") + 1).alias("noteNumber"), (c("o_custkey") % 9 - 4).alias("k"))), f"""
 WITH r AS (SELECT number, row_number() OVER (ORDER BY number) - 1 AS rank FROM (SELECT DISTINCT number FROM {_N} WHERE v)),
 m AS (SELECT 'r' || o_orderkey AS role, o_orderkey + 1 AS here, o_custkey % 9 - 4 AS k FROM orders),
 p AS (SELECT m.*, coalesce(rank, -1) AS rank, coalesce(number = here, false)::INT AS own FROM m ASOF LEFT JOIN r ON m.here >= r.number)
 SELECT role, coalesce(r.number, here)::BIGINT AS noteNumber, r.number IS NOT NULL AS moved FROM p LEFT JOIN r ON r.rank = CASE WHEN k > 0 THEN p.rank + k WHEN k < 0 THEN p.rank + 1 - own + k END""")
register("advance_cursor", "orders", lambda o: state.advance_cursor(_notes(o), o.sparkSession.createDataFrame([], "role string, noteNumber long, lockStatus string"), "extract-fields"), f"SELECT 'extract-fields' AS role, min(number) AS noteNumber, 'available' AS lockStatus FROM {_N} WHERE v AND number > -1")
register("lock_cursor", "nation", lambda n: state.lock_cursor(n.select(c("n_name").alias("role"), lit("available").alias("lockStatus")), "FRANCE"), "SELECT n_name AS role, CASE WHEN n_name = 'FRANCE' THEN 'locked' ELSE 'available' END AS lockStatus FROM nation")
register("create_cursor", "orders customer", lambda o, k: state.create_cursor(_notes(o), k.select(lit("r").alias("role"), c("c_custkey").cast("string").alias("noteId"))), f"SELECT 'r' AS role, c_custkey::VARCHAR AS noteId, number AS noteNumber FROM customer JOIN {_N} ON id = c_custkey::VARCHAR")
register("cursor_join", "orders customer", lambda o, k: state.cursor_join(k.select(c("c_custkey").cast("string").alias("noteId")), _notes(o)).select("noteId", "number"), f"SELECT id AS noteId, number FROM customer JOIN {_N} ON id = c_custkey::VARCHAR")
register("note_upsert", "pages", lambda p: state.note_status(p.select(c("page_id").cast("string").alias("id"), c("page_id").alias("number"), _odd_url().alias("url"))), "SELECT page_id::VARCHAR AS id, page_id AS number, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'Invalid URL:  ' || url WHEN 2 THEN 'Invalid URL: no-url' ELSE 'mailto:a' || page_id END AS url, page_id % 4 IN (0, 3) AS validUrl FROM pages")
_saved = lambda p: p.select(c("page_id").cast("string").alias("id"), _odd_url().alias("url"), F.when(c("page_id") % 8 < 4, lit("x")).alias("abstract"), F.when(c("page_id") % 3 == 0, lit("y")).alias("pdf"))
register("save_note", "pages", lambda p: state.url_status_of_note(_saved(p)).drop("requestUrl"), "SELECT page_id::VARCHAR AS id, page_id % 8 < 4 AS hasAbstract, page_id % 3 = 0 AS hasPdfLink, CASE WHEN page_id % 8 < 4 AND page_id % 3 = 0 THEN 'extractor:success' ELSE 'unknown' END AS workflowStatus FROM pages WHERE page_id % 4 IN (0, 3)")
_state = lambda o: o.select("o_orderkey", "o_orderstatus", "o_totalprice")
_changes = lambda o: o.filter(c("o_orderkey") % 4 == 0).select((c("o_orderkey") * 2).alias("o_orderkey"), lit("X").alias("o_orderstatus"))
_CH = "(SELECT o_orderkey * 2 AS o_orderkey, 'X' AS st FROM orders WHERE o_orderkey % 4 = 0)"
register("upsert", "orders", lambda o: state.upsert(_state(o), _changes(o), ["o_orderkey"]), f"SELECT coalesce(o.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(st, o_orderstatus) AS o_orderstatus, o_totalprice FROM orders o FULL OUTER JOIN {_CH} c ON o.o_orderkey = c.o_orderkey")
register("update_only", "orders", lambda o: state.update_only(_state(o), _changes(o), ["o_orderkey"], unset=("o_totalprice",)), f"SELECT o.o_orderkey, coalesce(st, o_orderstatus) AS o_orderstatus, CASE WHEN st IS NULL THEN o_totalprice END AS o_totalprice FROM orders o LEFT JOIN {_CH} c ON o.o_orderkey = c.o_orderkey")
register("delete_keys", "orders", lambda o: state.delete_keys(_state(o), _changes(o), ["o_orderkey"]), f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_CH})")
register("update_if_changed", "orders", lambda o: state.update_if_changed(_state(o), ["o_orderkey"], o_orderstatus=F.when(c("o_orderkey") % 2 == 0, lit("O")).otherwise(c("o_orderstatus"))), "SELECT o_orderkey, 'O' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'O'")
register("insert_if_absent", "orders", lambda o: state.insert_if_absent(_state(o), _changes(o), ["o_orderkey"]), f"SELECT o_orderkey, st AS o_orderstatus FROM {_CH} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
register("lookup", "orders", lambda o: state.lookup(_state(o), "o_orderkey", 7), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
register("last_write", "events", lambda e: state.last_write(e.select("user_id", "event_id", "event_type"), ["user_id"], "event_id"), "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
_values = lambda b: b.select(c("item_id").cast("string").alias("noteId"), lit("abstract").alias("fieldType"), c("text").alias("value"))
register("field_status", "benchmark", lambda b: state.field_status(_values(b)), "SELECT item_id::VARCHAR AS noteId, 'abstract' AS fieldType, sha1(text) AS contentHash FROM benchmark")
register("changed_fields", "benchmark", lambda b: state.changed_fields(state.field_status(_values(b).filter(c("noteId").cast("long") % 2 == 0).withColumn("value", F.when(c("noteId").cast("long") % 4 == 0, c("value")).otherwise(lit("old")))), _values(b)).select("noteId", "fieldType", "contentHash"), "SELECT item_id::VARCHAR AS noteId, 'abstract' AS fieldType, sha1(text) AS contentHash FROM benchmark WHERE item_id % 4 <> 0")
_wf = lambda k: F.get(F.array(*map(lit, state.WORKFLOW)), (c("event_id") % k).cast("int"))
register("workflow_transitions", "events", lambda e: e.select("event_id", state.valid_transition(_wf(10), _wf(7)).alias("ok"), state.is_workflow_status(c("event_type")).alias("known")), "SELECT event_id, (event_id % 10, event_id % 7) IN ((0, 1), (1, 2), (2, 3), (2, 4), (2, 5), (2, 6), (3, 5), (3, 6), (5, 6)) AS ok, false AS known FROM events")
register("add_pdf_flag", "nation", lambda n: state.add_pdf_flag(n.select("n_nationkey")), "SELECT n_nationkey, false AS hasPdfLink FROM nation")

# --- reports -------------------------------------------------------------------------------------
def _status_rows(e: DataFrame) -> DataFrame:
    """Events as status rows."""
    return e.select(
        F.concat(lit("host-"), (c("user_id") % 11).cast("string")).alias("responseHost"), ((c("event_type") == "click") | (c("user_id") % 11 == 3)).alias("hasAbstract"), (c("value") > 5).alias("hasPdfLink"), (c("event_id") % 4 != 0).alias("validResponseUrl"),
        F.when(c("event_id") % 9 != 0, ((c("event_id") % 4 + 2) * 100).cast("int")).alias("httpStatus"), F.get(F.array(*map(lit, state.WORKFLOW)), (c("event_id") % 10).cast("int")).alias("workflowStatus"), c("ts").alias("updatedAt"),
    )


_S = "(SELECT 'host-' || user_id % 11 AS responseHost, event_type = 'click' OR user_id % 11 = 3 AS hasAbstract, value > 5 AS hasPdfLink, event_id % 4 <> 0 AS valid, CASE WHEN event_id % 9 <> 0 THEN (event_id % 4 + 2) * 100 END AS httpStatus, ts AS updatedAt, event_id FROM events)"
register("note_count", "events", lambda e: summary.count_total(e), "SELECT count(*) AS total FROM events")
register("count_by_flag", "events", lambda e: summary.count_by(_status_rows(e), "hasPdfLink"), f"SELECT hasPdfLink AS key, count(*) AS n FROM {_S} GROUP BY 1")
register("count_by_status", "events", lambda e: summary.count_by(e, "event_type"), "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
register("count_by_day", "events", lambda e: summary.count_by_day(e, "ts"), "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
register("domain_flags", "events", lambda e: summary.domain_flags(_status_rows(e).filter("validResponseUrl"), "responseHost", "hasAbstract"), f"SELECT responseHost, hasAbstract, count(*) AS n FROM {_S} WHERE valid GROUP BY 1, 2")
register("domain_presence", "events", lambda e: summary.domain_presence(_status_rows(e).filter("validResponseUrl"), "responseHost", "hasAbstract"), f"""
 WITH d AS (SELECT responseHost AS domain, CAST(sum(hasAbstract::INT) AS BIGINT) AS present, count(*) AS total FROM {_S} WHERE valid GROUP BY 1),
 o AS (SELECT *, total - present AS missing, CASE WHEN total = present THEN 'full' WHEN present = 0 THEN 'failed' ELSE 'partial' END AS outcome FROM d)
 SELECT domain, present, missing, outcome, CASE WHEN missing = 0 THEN present::VARCHAR ELSE present || '/' || total END AS ratio, row_number() OVER (PARTITION BY outcome ORDER BY total DESC, domain) AS place FROM o""")
register("domain_http_pivot", "events", lambda e: summary.domain_http_pivot(_status_rows(e).filter("validResponseUrl"), "responseHost", "httpStatus"), f"""
 WITH d AS (SELECT responseHost AS domain, {', '.join(f"CAST(coalesce(sum((httpStatus // 100 = {k})::INT), 0) AS BIGINT) AS c{k}0x" for k in (2, 3, 4, 5))}, CAST(sum((httpStatus IS NULL)::INT) AS BIGINT) AS c0x FROM {_S} WHERE valid GROUP BY 1)
 SELECT *, rpad(domain, 35, ' ') || ': ' || {' || '.join(f"'{k}0x: ' || rpad(c{k}0x::VARCHAR, 6, ' ')" for k in (2, 3, 4, 5))} AS line FROM d""")
register("facet_union", "events", lambda e: summary.facets({"type": summary.count_by(e, "event_type"), "day": summary.count_by_day(e, "ts").withColumnRenamed("day", "key"), "total": summary.count_total(e).select(lit("total").alias("key"), c("total").alias("n"))}), "SELECT 'type' AS facet, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 2 UNION ALL SELECT 'total', 'total', count(*) FROM events")
register("grouped_facets", "lineitem", lambda x: summary.grouped_facets(x, ["l_returnflag", "l_linestatus"]), "SELECT 'l_returnflag' AS facet, l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2")
_states = ", ".join(f"'{w}'" for w in state.WORKFLOW)
register("status_report", "events", lambda e: summary.status_report(_status_rows(e)), f"""
 WITH s AS (SELECT * FROM {_S}), nl AS (SELECT chr(10) AS nl),
 d AS (SELECT responseHost AS domain, sum(hasAbstract::INT) AS present, count(*) AS total FROM s WHERE valid GROUP BY 1),
 o AS (SELECT *, CASE WHEN total = present THEN 0 WHEN present = 0 THEN 2 ELSE 1 END AS r FROM d),
 l AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY total DESC, domain) AS place, '    ' || CASE r WHEN 0 THEN present::VARCHAR WHEN 1 THEN present || '/' || total ELSE '0/' || total END || ': ' || domain AS line FROM o
       UNION ALL SELECT * FROM (VALUES (0, 0, 'Fully Successful Domains'), (1, 0, 'Partially Successful Domains'), (2, 0, 'Failed Domains'))),
 h AS (SELECT responseHost AS domain, {', '.join(f"coalesce(sum((httpStatus // 100 = {k})::INT), 0) AS c{k}" for k in (2, 3, 4, 5))} FROM s WHERE valid GROUP BY 1)
 SELECT 'Recorded Note Count: ' || (SELECT count(*) FROM s) || nl || nl || 'Notes With Abstracts: ' || (SELECT sum(hasAbstract::INT) FROM s) || nl || nl || 'Notes With PDF Links: ' || (SELECT sum(hasPdfLink::INT) FROM s) || nl || nl
  || 'Updated Notes Per Day, Last 7 days' || nl || (SELECT string_agg('    ' || day || ': ' || n, chr(10) ORDER BY day) FROM (SELECT strftime(updatedAt, '%Y-%m-%d') AS day, count(*) AS n FROM s WHERE updatedAt >= (SELECT max(updatedAt) FROM s) - INTERVAL 7 DAY GROUP BY 1)) || nl || nl
  || 'Extracted Abstracts By Domain, out of Notes with valid URLs' || nl || (SELECT string_agg(line, chr(10) ORDER BY r, place) FROM l) || nl || nl
  || 'Http Status Counts By Domain' || nl || (SELECT string_agg(rpad(domain, 35, ' ') || ': ' || {' || '.join(f"'{k}0x: ' || rpad(c{k}::VARCHAR, 6, ' ')" for k in (2, 3, 4, 5))}, chr(10) ORDER BY domain) FROM h) || nl || nl
  || 'Workflow Status Counts' || nl || (SELECT string_agg('    ' || w || ': ' || n, chr(10) ORDER BY w) FROM (SELECT [{_states}][event_id % 10 + 1] AS w, count(*) AS n FROM s GROUP BY 1)) AS report
 FROM nl""")

def _words_or_fail(text: str) -> Iterator[str]:
    for k, w in enumerate(text.split(" ")):
        if k == 20:
            raise ValueError("more than 20 words")
        yield w


# --- sequences -----------------------------------------------------------------------------------
_runs = "SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS b FROM events)"
register("sorted_uniq_count", "events", lambda e: sequences.run_lengths(e, ["user_id"], ["ts", "event_id"], "event_type"), f"SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM ({_runs}) GROUP BY user_id, run")
_rn = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"
_items = lambda d: d.select("user_id", "chunk", F.array_join("items", ",").alias("items"))
register("chunk_stream", "events", lambda e: _items(sequences.chunks(e, ["user_id"], ["event_id"], "event_type", 4)), f"SELECT user_id, CAST(i // 4 AS BIGINT) AS chunk, string_agg(event_type, ',' ORDER BY i) AS items FROM {_rn} GROUP BY 1, 2")
register("chunk_stream_overflow", "events", lambda e: _items(sequences.chunks(e, ["user_id"], ["event_id"], "event_type", 4, drop_overflow=True)), f"SELECT user_id, CAST(i // 5 AS BIGINT) AS chunk, string_agg(event_type, ',' ORDER BY i) AS items FROM {_rn} WHERE i % 5 <> 4 GROUP BY 1, 2 UNION ALL SELECT user_id, CAST(count(*) // 5 AS BIGINT), '' FROM events GROUP BY 1 HAVING count(*) % 5 = 0")
register("stanza_chunks", "conversations", lambda v: sequences.stanzas(v, ["conv_id"], ["turn"], "role", c("role") == "user", c("role") == "assistant"), """
 WITH t AS (SELECT *, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stanza FROM conversations),
 u AS (SELECT *, max((role = 'user')::INT) OVER (PARTITION BY conv_id, stanza ORDER BY turn) AS ins, max((role = 'assistant')::INT) OVER (PARTITION BY conv_id, stanza) AS closed FROM t)
 SELECT conv_id, CAST(stanza AS BIGINT) AS stanza, coalesce(string_agg(CASE WHEN ins = 1 THEN role END, '' ORDER BY turn), '') AS text FROM u WHERE closed = 1 GROUP BY 1, 2""")
register("slice_stream", "events", lambda e: sequences.slice_rows(e.select("event_id"), ["event_id"], 10, 25), "SELECT event_id FROM events ORDER BY event_id LIMIT 25 OFFSET 10")
register("zip_with_index", "events", lambda e: sequences.zip_with_index(e, ["user_id"], ["event_id"], 5).select("event_id", "index"), f"SELECT event_id, i + 5 AS index FROM {_rn}")
register("next_ids", "orders", lambda o: sequences.next_ids(o.where("o_orderkey % 2 = 0").select("o_orderkey"), ["o_orderkey"], o.where("o_orderkey % 2 = 1 and o_orderkey < 1000").select(c("o_orderkey").alias("id"))), """
 SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey < 1000) AS id FROM orders WHERE o_orderkey % 2 = 0""")
register("from_batches", "orders", lambda o: sequences.from_batches(o.select("o_orderkey", F.array(c("o_orderkey"), -c("o_orderkey")).alias("a")), "a", ["o_orderkey"], 101).select("item"), "SELECT unnest([o_orderkey, -o_orderkey]) AS item FROM (SELECT o_orderkey FROM orders ORDER BY 1) LIMIT 101")
register("stream_gather", "events", lambda e: sequences.gather(e, ["user_id"], ["event_id"], "event_type").select("user_id", F.array_join("items", ",").alias("items")), "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS items FROM events GROUP BY 1")
register("stream_fold", "events", lambda e: sequences.gather(e, ["user_id"], ["event_id"], "event_id").select("user_id", sequences.fold(c("items"), lit(0).cast("long"), lambda a, x: (a * 31 + x) % 1000003).alias("out")), "SELECT user_id, CAST(list_reduce(list_concat([0], list(event_id ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS out FROM events GROUP BY 1")
_affine = sequences.Fold((1, 0), lambda s, x: (s[0] * 31 % 1000003, (s[1] * 31 + x) % 1000003), lambda a, b: (a[0] * b[0] % 1000003, (a[1] * b[0] + b[1]) % 1000003), lambda s: s[1])
register("tap_or_halt", "orders", lambda o: o.select("o_orderkey", flow.tap_or_halt(F.when(c("o_orderkey") % 7 != 0, c("o_custkey")), F.when(c("o_orderkey") % 5 != 0, c("o_custkey") % 3 != 0), F.concat(lit("bad "), c("o_custkey").cast("string"))).alias("r")).select("o_orderkey", "r.value", c("r.control.code").alias("code"), c("r.control.msg").alias("msg")), """
 SELECT o_orderkey, CASE WHEN ok AND there THEN o_custkey END AS value, CASE WHEN there AND NOT ok THEN 'halt' END AS code, CASE WHEN there AND NOT ok THEN 'bad ' || o_custkey END AS msg FROM (SELECT *, o_orderkey % 7 <> 0 AS there, o_orderkey % 5 <> 0 AND o_custkey % 3 <> 0 AS ok FROM orders)""")
register("add_evidence", "benchmark", lambda b: b.select("item_id", F.array_join(evidence.add_evidence(F.array(lit("input:x")), F.substring("text", 1, 3), lit("last")), "|").alias("out")), "SELECT item_id, 'input:x|' || substr(text, 1, 3) || '|last' AS out FROM benchmark")
register("stream_fold_merged", "events", lambda e: sequences.fold_rows(e, ["user_id"], ["event_id"], "event_id", _affine, "long"), "SELECT user_id, CAST(list_reduce(list_concat([0], list(event_id ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1000003) AS BIGINT) AS out FROM events GROUP BY 1")
register("generated_words", "benchmark", lambda b: flow.each_generated(b.select("item_id", "text"), flow.generator(b.sparkSession, "words_of", _words_or_fail, "string"), "text").select("item_id", "pos", "value", c("control.msg").alias("msg")), """
 SELECT item_id, CAST(i - 1 AS INT) AS pos, w[i] AS value, NULL::VARCHAR AS msg FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)) WHERE i <= 20
 UNION ALL SELECT item_id, 20, NULL, 'more than 20 words' FROM benchmark WHERE len(string_split(text, ' ')) > 20""")
register("last_item", "events", lambda e: sequences.last_item(e, ["user_id"], ["ts", "event_id"], "event_type"), "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
register("partition_results", "events", lambda e: sequences.partition_results(e, ["user_id"], ["event_id"], "event_id", c("event_type") != "error").select("user_id", F.array_join("lefts", ",").alias("lefts"), F.array_join("rights", ",").alias("rights")), "SELECT user_id, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (event_type = 'error'), '') AS lefts, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (event_type <> 'error'), '') AS rights FROM events GROUP BY 1")
register("set_difference", "benchmark", lambda b: b.select("item_id", F.array_join(sequences.difference(F.split("text", " "), F.array(lit("the"), lit("de"))), " ").alias("out")), "SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda x: x NOT IN ('the', 'de')), ' ') AS out FROM benchmark")
register("sets_equal", "events", lambda e: e.groupBy("user_id").agg(F.collect_list("event_type").alias("a")).select("user_id", sequences.sets_equal(c("a"), F.array(lit("view"), lit("click"), lit("error"), lit("purchase"), lit("login"), lit("click"))).alias("same")), "SELECT user_id, list_sort(list_distinct(list(event_type))) = list_sort(['view', 'click', 'error', 'purchase', 'login']) AS same FROM events GROUP BY 1")
_kind = lambda: F.get(F.array(*map(lit, ("request", "response", "requestfinished", "requestfailed"))), (c("event_id") * 7 % 4).cast("int"))
register("request_cycle", "events", lambda e: sequences.request_cycle(e.select((c("event_id") % 997).alias("request_id"), _kind().alias("kind"), F.when(c("event_id") % 1000 == 3, lit("x blockedbyclient")).alias("message")), "request_id", "kind", "message"), """
 WITH k AS (SELECT event_id % 997 AS request_id, ['request', 'response', 'requestfinished', 'requestfailed'][event_id * 7 % 4 + 1] AS kind, event_id % 1000 = 3 AS b FROM events),
 s AS (SELECT request_id, list(DISTINCT kind) AS ks, bool_or(b) AS blocked FROM k GROUP BY 1)
 SELECT request_id, CASE WHEN list_has_all(ks, ['request', 'response', 'requestfinished']) THEN 'success' WHEN list_has_all(ks, ['request', 'requestfailed']) THEN 'fail' ELSE 'open' END AS outcome, blocked FROM s""")
register("fetch_pages", "orders", lambda o: sequences.fetch_pages(o, "o_orderkey", 3, 40, 10), "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 3 AS BIGINT) AS page FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 10 ORDER BY 1 LIMIT 40)")
register("char_stream", "benchmark", lambda b: _characters(b), "SELECT item_id, CAST(i - 1 AS BIGINT) AS pos, substr(text, i, 1) AS ch FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark)")
register("label_report", "documents", lambda d: _label_report(d), "SELECT lang AS kind, 'title' AS field, count(*) AS records, CAST(sum((doc_id % 2 = 0)::INT) AS BIGINT) AS found, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS values FROM documents GROUP BY 1")
register("markup_check", "pages", lambda p: _markup(p), "SELECT page_id, page_id % 2 = 0 AS ok FROM pages")
register("outbox", "benchmark", lambda b: _outbox(b), "SELECT item_id::VARCHAR AS noteId, 'abstract' AS fieldType, '{\"id\":\"' || sha1(item_id || chr(31) || 'abstract' || chr(31) || 'v' || item_id) || '\",\"noteId\":\"' || item_id || '\",\"field\":{\"name\":\"abstract\",\"value\":\"v' || item_id || '\"},\"signature\":\"me\"}' AS body FROM benchmark")
register("url_list", "pages", lambda p: _url_list(p), "SELECT url FROM pages WHERE page_id % 3 <> 0")


def _characters(b: DataFrame) -> DataFrame:
    from heronry.sources.corpus import characters

    return characters(b, ["item_id"], "text").select("item_id", c("pos").cast("long").alias("pos"), "ch")


def _label_report(d: DataFrame) -> DataFrame:
    from heronry.sources.corpus import label_report

    one = F.struct(lit("title").alias("name"), F.array(lit("e")).alias("evidence"), c("source").alias("value"))
    found = F.struct((c("doc_id") % 2 == 0).alias("exists"), lit(1).alias("count"), F.when(c("doc_id") % 2 == 0, F.array(one, one)).otherwise(F.array().cast("array<struct<name:string,evidence:array<string>,value:string>>")).alias("instances"))
    return label_report(d.select(c("lang").alias("kind"), F.create_map(lit("title"), found).alias("fields")))


def _markup(p: DataFrame) -> DataFrame:
    from heronry.sources.corpus import looks_like_markup

    return p.select("page_id", looks_like_markup(F.when(c("page_id") % 2 == 0, F.concat(lit("  "), c("html"))).otherwise(lit("%PDF"))).alias("ok"))


def _outbox(b: DataFrame) -> DataFrame:
    from heronry.sources.feeds import outbox

    number = c("item_id").cast("string")
    return outbox(b.select(number.alias("noteId"), lit("abstract").alias("fieldType"), F.concat(lit("v"), number).alias("value")), "me")


def _url_list(p: DataFrame) -> DataFrame:
    from heronry.sources.corpus import url_list

    return url_list(p.select(F.when(c("page_id") % 3 == 0, F.concat(lit("# "), c("url"))).otherwise(F.concat(lit("  "), c("url"), lit(" "))).alias("line")))


# --- control values, XML, kinds of files, corpus entries, loops ---------------------------------------
_step = lambda x: F.when(x % 7 == 0, flow.with_control(lit(None).cast("long"), lit("seven"))).when(x % 2 == 0, flow.with_control(x, lit(""))).otherwise(flow.with_control(lit(None).cast("long"), lit("odd"), halt=False))
_folded = lambda d: d.select("doc_id", flow.for_each_until_halt(F.sequence(c("doc_id"), c("doc_id") + 5), _step).alias("r")).select("doc_id", F.array_join("r.values", ",").alias("kept"), c("r.control.code").alias("code"))
register(
    "for_each_until_halt", "documents", _folded,
    "SELECT doc_id, array_to_string(list_filter(range(doc_id, least(doc_id + 6, doc_id + (7 - doc_id % 7) % 7)), lambda x: x % 2 = 0), ',') AS kept, CASE WHEN (7 - doc_id % 7) % 7 < 6 THEN 'halt' END AS code FROM documents",
)
register(
    "first_or_halt", "documents", lambda d: d.select("doc_id", flow.first_or_halt(c("doc_id"), _step, lambda x: flow.with_control(F.when(x % 3 == 0, -x), lit("last"), halt=False)).alias("r")).select("doc_id", "r.value", c("r.control.code").alias("code"), c("r.control.msg").alias("msg")),
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN doc_id WHEN doc_id % 3 = 0 THEN -doc_id END AS value, CASE WHEN doc_id % 7 = 0 THEN 'halt' WHEN doc_id % 2 = 1 AND doc_id % 3 <> 0 THEN 'continue' END AS code, CASE WHEN doc_id % 7 = 0 THEN 'seven' WHEN doc_id % 2 = 1 AND doc_id % 3 <> 0 THEN 'last' END AS msg FROM documents",
)
register("traced_steps", "documents", lambda d: flow.traced("demo", half=flow.through("half", F.floor(c("n_chars") / 2)), big=flow.keep_if(c("half") > 500), shape=flow.map_env(doc_id=c("doc_id"), half=c("half")))(d), "SELECT doc_id, CAST(n_chars // 2 AS BIGINT) AS half FROM documents WHERE n_chars // 2 > 500")
_feed = lambda: F.when(c("doc_id") % 11 == 0, lit("no xml <")).when(c("doc_id") % 13 != 0, F.concat(lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t'), c("doc_id").cast("string"), lit("</title>"), F.when(c("doc_id") % 3 == 0, F.concat(lit('<link type="application/pdf" href="/p/'), c("doc_id").cast("string"), lit('"/>'))).otherwise(lit("")), lit("</entry><entry><title>second</title></entry></feed>")))


def _xml(d: DataFrame) -> DataFrame:
    from heronry.functions.xml import select_path, select_tag

    d = d.select("doc_id", select_path(_feed(), ["feed", "entry", "title"]).alias("t"), select_path(_feed(), ["feed", "entry", "0", "link"], "href", {"type": "application/pdf"}).alias("l"), select_tag(_feed(), ["feed", "entry", "0", "title"]).alias("one"))
    return d.select("doc_id", F.array_join("t.values", ",").alias("titles"), c("t.control.code").alias("code"), F.get("l.values", lit(0)).alias("link"), c("l.control.code").alias("link_code"), c("one.value").alias("first"), c("one.control.code").alias("first_code"))


register("xml_path", "documents", _xml, """
 SELECT doc_id, CASE WHEN ok THEN 't' || doc_id || ',second' END AS titles, CASE WHEN NOT ok THEN 'halt' END AS code, CASE WHEN ok AND doc_id % 3 = 0 THEN '/p/' || doc_id END AS link, CASE WHEN NOT ok THEN 'halt' WHEN doc_id % 3 <> 0 THEN 'continue' END AS link_code,
   CASE WHEN ok THEN 't' || doc_id END AS first, CASE WHEN NOT ok THEN 'halt' END AS first_code FROM (SELECT doc_id, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS ok FROM documents)""")
_BODIES = ("%PDF-1.4 x", "  <!DOCTYPE html><p>x", "<!-- a --> <html>é", '<?xml version="1.0"?><feed/>', '<?xml version="1.0"?>\n<html/>', '{"a": 1}', "plain text", "", "<feed><a/></feed>", "0x49013")
_KINDS = ("application/pdf; charset=binary", "text/html; charset=us-ascii", "text/html; charset=utf-8", "text/xml; charset=us-ascii", "text/html; charset=us-ascii", "application/json; charset=binary", "text/plain; charset=us-ascii", "inode/x-empty; charset=binary", "text/xml; charset=us-ascii", "text/plain; charset=us-ascii")


def _mime(d: DataFrame) -> DataFrame:
    from heronry.sources.corpus import mime_of, verify_type

    d = d.select("doc_id", F.when(c("doc_id") % 17 != 0, _pick(_BODIES)).alias("body"))
    return d.select("doc_id", mime_of(c("body")).alias("kind"), verify_type(c("body"), "text/(html|xml)").alias("ok"))


register("mime_types", "documents", _mime, f"SELECT doc_id, kind, coalesce(regexp_matches(kind, 'text/(html|xml)'), false) AS ok FROM (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN {_sql_pick(_KINDS)} END AS kind FROM documents)")


def _bodies(p: DataFrame) -> DataFrame:
    from heronry.sources.corpus import normalised_bodies

    d = p.select("page_id", F.when(c("page_id") % 5 == 0, lit("500")).otherwise(lit("200")).alias("status"), F.when(c("page_id") % 3 == 0, F.array(lit("%PDF-"), lit("x"))).otherwise(F.array(lit("<p>a"), lit("no markup"), lit("<div>b"))).alias("bodies"))
    return normalised_bodies(d).select("page_id", F.size("normalised").alias("n"), F.element_at("normalised", -1).alias("last"), c("control.code").alias("code"))


register("normalised_bodies", "pages", _bodies, "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 2 END AS n, CASE WHEN page_id % 3 <> 0 THEN array_to_string(['<html>', '    <body>', '        <div>', '            b', '        </div>', '    </body>', '</html>'], chr(10)) END AS last, CASE WHEN page_id % 3 = 0 THEN 'halt' END AS code FROM pages WHERE page_id % 5 <> 0")


def _fetched(p: DataFrame) -> DataFrame:
    """Pages as a fetcher gives them."""
    some = F.create_map(lit("content-type"), lit("text/html"))
    d = p.select("page_id", "url", c("url").alias("response_url"), lit("200").alias("status"), c("html").alias("body"), lit(None).cast("struct<code:string,msg:string>").alias("control"), some.alias("headers"), some.alias("request_headers"))
    return d.withColumns({"frames": F.when(c("page_id") % 10 == 0, F.array(lit("<p>frame"))).otherwise(F.array().cast("array<string>")), "chain": F.array(c("url")), "fetched_at": lit("2024-01-01").cast("timestamp")})


def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as the entries of a corpus in the shared folder, and read back from there."""
    import uuid

    from heronry.session import shared_folder
    from heronry.sources import corpus, entries

    root = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    files = entries.save_responses(_fetched(table(spark, sf_dir, "pages")), root, ties=("page_id",))
    files.agg(F.count_if("written").alias("n")).collect()
    return corpus.read_pages(spark, root).select(c("page_id").alias("entry"), "url", "status", F.md5("html").alias("md5"))


QUERIES["corpus_round_trip"] = corpus_round_trip
ORACLE_SQL["corpus_round_trip"] = "SELECT sha1(url) AS entry, any_value(url) AS url, '200' AS status, any_value(md5(html)) AS md5 FROM pages GROUP BY sha1(url)"
register("response_files", "pages", lambda p: _files(p), "SELECT page_id, unnest(CASE WHEN page_id % 10 = 0 THEN ['response-body', 'metadata.json', 'request-headers.json', 'response-headers.json', 'response-frame-0'] ELSE ['response-body', 'metadata.json', 'request-headers.json', 'response-headers.json'] END) AS name FROM pages")


def _files(p: DataFrame) -> DataFrame:
    from heronry.sources.entries import response_files

    return response_files(_fetched(p), keep=("page_id",)).select("page_id", "name")


def _loop(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The extraction step over all pages but the first ten; a third of them are missing, a fifth answered 404."""
    from heronry.streaming.loops import extraction_step

    spark = p.sparkSession
    notes = p.select(c("page_id").cast("string").alias("id"), c("page_id").alias("number"), "url", (c("page_id") % 4 != 1).alias("validUrl"))
    cursors = spark.createDataFrame([("extract-fields", "10", 10), ("fetch-notes", "99", 99)], "role string, noteId string, noteNumber long")
    body = F.concat(lit('<meta name="citation_title" content="T"><meta name="citation_author" content="A"><meta name="citation_pdf_url" content="http://x.org/'), c("page_id").cast("string"), lit(f'.pdf"><meta name="description" content="{_LONG}">'))
    pages = p.where("page_id % 3 <> 0").select(c("page_id").cast("string").alias("noteId"), "url", c("url").alias("response_url"), F.when(c("page_id") % 5 == 0, lit("404")).otherwise(lit("200")).alias("status"), body.alias("html"))
    stored = p.where("page_id % 2 = 0").select(c("page_id").cast("string").alias("noteId"), lit("abstract").alias("fieldType"), F.sha1(F.rtrim(lit(_LONG))).alias("contentHash"))
    return extraction_step(notes, cursors, pages, stored, 0)


_LOOPED = "(SELECT page_id, url, page_id % 3 <> 0 AS there, page_id % 3 <> 0 AND page_id % 5 <> 0 AS ok FROM pages WHERE page_id > 10 AND page_id % 4 <> 1)"
register("loop_cursor", "pages", lambda p: _loop(p)[0], "SELECT 'extract-fields' AS role, max(page_id)::VARCHAR AS noteId, max(page_id) AS noteNumber, 'available' AS lockStatus FROM pages WHERE page_id > 10 AND page_id % 4 <> 1 HAVING count(*) > 0")
register("loop_status", "pages", lambda p: _loop(p)[1].select("id", "requestUrl", "response", "httpStatus", "hasAbstract", "hasPdfLink", "workflowStatus"), f"SELECT page_id::VARCHAR AS id, url AS requestUrl, CASE WHEN there THEN url END AS response, CASE WHEN there THEN CASE WHEN ok THEN 200 ELSE 404 END END AS httpStatus, CASE WHEN ok THEN true END AS hasAbstract, CASE WHEN ok THEN true END AS hasPdfLink, CASE WHEN ok THEN 'extractor:success' ELSE 'extractor:fail' END AS workflowStatus FROM {_LOOPED}")
register("loop_fields", "pages", lambda p: _loop(p)[2].select("noteId", "fieldType"), f"SELECT page_id::VARCHAR AS noteId, unnest(CASE WHEN page_id % 2 = 0 THEN ['pdf'] ELSE ['abstract', 'pdf'] END) AS fieldType FROM {_LOOPED} WHERE ok")


def _plain(name: str, make: Callable[[SparkSession], DataFrame], sql: str) -> None:
    """A query that reads no table."""
    QUERIES[name] = lambda spark, _: make(spark)
    ORACLE_SQL[name] = sql


def _fixture(name: str) -> Callable[..., DataFrame]:
    from heronry.sources import fixtures

    return getattr(fixtures, name)


_plain("random_strings", lambda s: _fixture("random_strings")(s, 500, 7), "SELECT range AS id, substr(sha1('7:' || range), 1, 3) AS value FROM range(500)")
_plain("count_strings", lambda s: _fixture("count_strings")(_fixture("random_strings")(s, 500, 7)), "SELECT substr(sha1('7:' || range), 1, 3) AS value, count(*) AS n FROM range(500) GROUP BY 1")
_plain("fake_notes", lambda s: _fixture("fake_notes")(s, 100).select("id", "number", "content.title", "content.html", "content.abstract"), "SELECT 'note#' || i AS id, i AS number, 'Title ' || i AS title, CASE WHEN i % 3 <> 0 THEN 'http://host-' || i % 5 || '/page/' || i END AS html, CASE WHEN i % 4 <> 0 THEN 'Abstract of ' || i END AS abstract FROM (SELECT range AS i FROM range(1, 101))")
_plain("note_batches", lambda s: _fixture("as_batches")(_fixture("fake_notes")(s, 100), 7).select("batch", F.size("notes").alias("n"), c("notes")[0]["number"].alias("first")), "SELECT range AS batch, CASE WHEN range = 14 THEN 2 ELSE 7 END AS n, range * 7 + 1 AS first FROM range(15)")
register("first_pages", "orders", lambda o: _fixture("first_pages")(o.select(c("o_orderkey").alias("number")), 5, 10, 100).select("number", "page", "at"), "SELECT number, i // 100 AS page, i % 100 AS at FROM (SELECT o_orderkey AS number, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i < 500 AND i % 100 < 10")
column_query("pretty_json", "events", "event_id", lambda: scalars.pretty(F.struct(c("event_type").alias("kind"), F.struct(c("user_id").alias("id")).alias("user"))), "'{' || chr(10) || '  \"kind\" : \"' || event_type || '\",' || chr(10) || '  \"user\" : {' || chr(10) || '    \"id\" : ' || user_id || chr(10) || '  }' || chr(10) || '}'")
register("entry_paths", "pages", lambda p: _entry_paths(p), "SELECT page_id, url AS initial_url, '/corpus/' || substr(sha1(url), 1, 1) || '/' || substr(sha1(url), 2, 1) || '/' || substr(sha1(url), 3, 1) || '/' || sha1(url) || '.d' AS entry_path FROM pages")
register("piped_texts", "benchmark", lambda b: _piped(b), "SELECT item_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS out, CAST(0 AS INTEGER) AS code FROM benchmark")


def _entry_paths(p: DataFrame) -> DataFrame:
    from heronry.sources.corpus import with_entries

    return with_entries(p, "/corpus").select("page_id", "initial_url", "entry_path")


def _piped(b: DataFrame) -> DataFrame:
    from heronry.functions.process import piped

    return b.select("item_id", piped(c("text"), ["tr", "a-z", "A-Z"]).alias("r")).select("item_id", F.array_join("r.stdout", "\n").alias("out"), "r.code")
