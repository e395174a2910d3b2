"""Candidates from page text: one Arrow-batched function parses a page once and evaluates all that its rule gathers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from heronry.functions import dom
from heronry.functions.urls import resolve, url_evidence
from heronry.functions.xml import elements_at, parse_xml
from heronry.operators.flow import control
from heronry.plans.rules import GENERAL, RULES, Rule, Spec

CANDIDATES = "struct<candidates:array<struct<seq:int,text:string,evidence:array<string>,resolved:string>>,error:string>"

_CANDIDATE = pa.struct([("seq", pa.int32()), ("text", pa.string()), ("evidence", pa.list_(pa.string())), ("resolved", pa.string())])
_CANDIDATES = pa.struct([("candidates", pa.list_(_CANDIDATE)), ("error", pa.string())])
#: Rows of a batch that are Python values at a time.
PART = 64


def _brace_json(text: str) -> dict | None:
    i, j = text.find("{"), text.rfind("}")
    if i < 0 or j < 0:
        return None
    try:
        out = json.loads(text[i : j + 1])
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def _named(data: dict, names: dict[str, str], authors: str) -> Iterator[tuple[str, str]]:
    for key, name in names.items():
        if data.get(key):
            yield str(data[key]), name
    people = data.get(authors)
    if isinstance(people, list):
        for p in people:
            if isinstance(p, dict) and p.get("name"):
                yield str(p["name"]), "metadata:author"


def _atom(text: str) -> Iterator[tuple[str, str]]:
    root = parse_xml(text)
    if root is None:
        return
    for name in ("summary", "title"):
        for found in elements_at(root, ["feed", "entry", "0", name])[:1]:
            yield "".join(found.itertext()), f"xml:select:'feed.entry.0.{name}'"
    links = [e for e in elements_at(root, ["feed", "entry", "0", "link"]) if e.get("type") == "application/pdf"]
    for link in links[:1]:
        yield link.get("href") or "", "xml:feed.entry[0].link[]"


def _until(lines: list[str], pattern: str, keep_all: bool) -> list[str]:
    at = next((i for i, x in enumerate(lines) if re.search(pattern, x)), None)
    return (lines if at is None else lines[:at]) if keep_all else ([] if at is None else lines[at:])


def _cell(lines: list[str], pattern: str) -> list[str]:
    """The table cell after the one that matches."""
    head = next((i for i in range(len(lines) - 1) if re.search("<t[dh]", lines[i]) and re.search(pattern, lines[i + 1])), None)
    rest = _until(lines[head + 2 :], "<t[dh]", False)[1:] if head is not None else []
    body = _until(rest, "</t[dh]>", True)
    return body if len(body) < len(rest) else []


def _line_program(name: str, text: str) -> Iterator[tuple[str, str]]:
    from heronry.functions.lines import ANCHOR_LINE, BARE_TAGS, TAG_LINE

    lines = text.split("\n")
    python = lambda p: p.replace(r"\z", r"\Z")
    without = lambda rows, p: [x for x in rows if not re.search(python(p), x)]
    if name == "neurips":
        yield " ".join(without(_until(_until(lines, "Abstract", False)[1:], r"^[ ]+<.div", True), BARE_TAGS)), "neurips.cc.abstract"
    elif name == "cogsci":
        yield " ".join(without(_until(_until(_until(lines, "Abstract", False), r"^[ ]+<blockquote", False)[1:], r"^[ ]+<.blockquote", True), BARE_TAGS)), "grepped.abstract"
    elif name == "lrec":
        for pattern, evidence in (("Abstract", "abstract"), ("Title", "title"), ("Authors", "authors-block")):
            yield " ".join(without(_cell(lines, pattern), TAG_LINE)), evidence
        link = " ".join(x for x in _cell(lines, "(?i)Full Paper") if re.search(python(ANCHOR_LINE), x))
        yield re.sub(r'(?s)".*', "", re.sub(r'(?s)^.*href="', "", link)), "pdf-link"


def gather(text: str, specs: tuple[Spec, ...]) -> list[tuple[str, str]]:
    """(text, evidence) in order; what fails gives nothing."""
    tree, tidied, metas, out = None, None, None, []
    for kind, *args in specs:
        if kind == "atom":
            out += _atom(text)
            continue
        if kind in ("lines", "global_json"):
            tidied = dom.tidy(text) if tidied is None else tidied
            if kind == "lines":
                out += _line_program(args[0], tidied)
            else:
                line = next((x for x in tidied.split("\n") if re.search(r"(?i)global\.document\.metadata", x)), "")
                out += _named(_brace_json(line) or {}, {"title": "metadata:title", "abstract": "metadata:abstract", "pdfPath": "metadata:pdf-link"}, "authors")
            continue
        tree = dom.parse(text) if tree is None else tree
        if kind in ("meta", "meta_all"):
            name, attr = args
            metas = dom.select(tree, "meta") if metas is None else metas
            nodes = dom.metas_named(metas, name, attr)
            nodes = [n for n in (nodes if kind == "meta_all" else nodes[:1]) if "content" in n.attrs]
            out += [(n.attrs["content"], f'{"select-all" if kind == "meta_all" else "select"}:$(meta[{attr}="{name}"])') for n in nodes]
        elif kind == "text":
            node = dom.select_one(tree, args[0])
            out += [(node.text(), f"select:$({args[0]})")] if node is not None else []
        elif kind == "each":
            out += [(n.text(), f"page.$$({args[0]})") for n in dom.select(tree, args[0])]
        elif kind == "combined":
            out.append(("\n".join(n.text() for n in dom.select(tree, args[0])), f"page.$$({args[0]})"))
        elif kind == "attr":
            node = dom.select_one(tree, args[0])
            out += [(node.attrs[args[1]], f"page.$({args[0]}).attr({args[1]})")] if node is not None and args[1] in node.attrs else []
        elif kind == "attr_all":
            out += [(n.attrs[args[1]], f"select-all:$({args[0]}).attr({args[1]})") for n in dom.select(tree, args[0]) if args[1] in n.attrs]
        elif kind == "within":
            root = dom.select_one(tree, args[0])
            node = dom.select_one(root, args[1]) if root is not None else None
            if node is not None and (not args[2] or args[2] in node.attrs):
                out.append((node.attrs[args[2]] if args[2] else node.text(), args[3]))
        elif kind == "ld_json":
            node = dom.select_one(tree, 'script[type="application/ld+json"]')
            out += _named((_brace_json(node.text()) if node is not None else None) or {}, {"headline": "metadata:title", "description": "metadata:abstract"}, "author")
        else:
            raise ValueError(f"unknown kind {kind}")
    return out


def dispatch(url: Column, status: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the first rule whose pattern is found and whose status holds; else ``general``; null unless the status is 200."""
    out = F.lit(GENERAL.name)
    for rule in reversed(rules):
        out = F.when(url.rlike(rule.url), F.lit(rule.name)).otherwise(out)
    return F.when(status == "200", out)


def _parts(columns: tuple[pa.Array, ...]) -> Iterator[list[list]]:
    """Columns in runs of ``PART`` rows, as Python values: no more of a batch is ever unpacked at once, whatever its size."""
    for at in range(0, len(columns[0]), PART):
        yield [c.slice(at, PART).to_pylist() for c in columns]


def with_candidates(pages: DataFrame, rules: tuple[Rule, ...] = RULES, artifact: str = "response-body") -> DataFrame:
    """Pages (page_id, url, status, html, ...) of status 200 with ``rule``, ``ambient``, ``candidates`` and ``control``; the html is dropped.

    One pass in Arrow batches, without a shuffle.  A null html has no candidates; null addresses go to the general rule.  A page that can't be
    evaluated has no candidates, and a control (``halt`` and the reason) instead of null; the other pages are not affected.
    """
    by_name = {r.name: r for r in (*rules, GENERAL)}
    placed = pages.withColumn("rule", F.coalesce(dispatch(F.coalesce("url", F.lit("")), F.col("status"), rules))).where("rule is not null")
    general = F.col("rule") == GENERAL.name
    placed = placed.withColumn("ambient", F.when(general, url_evidence(F.coalesce("url", F.lit("")))).otherwise(F.array().cast("array<string>")))

    def one(h: str | None, r: str, u: str | None, a: list[str]) -> dict:
        before, rows, error = [*a, f"input:{artifact}"], [], None
        try:
            found = gather(h, by_name[r].specs) if h is not None else []
            rows = [{"seq": i, "text": t.strip(), "evidence": [*before, e], "resolved": resolve(t.strip(), u)} for i, (t, e) in enumerate(found)]
        except (ArithmeticError, AssertionError, LookupError, RecursionError, ValueError) as e:  # what a hostile page can cause
            error = f"{type(e).__name__}: {e}"[:500]
        return {"candidates": rows, "error": error}

    @F.arrow_udf(CANDIDATES)
    def candidates(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for part in _parts(columns):
                yield pa.array([one(*row) for row in zip(*part, strict=True)], _CANDIDATES)

    # not deterministic to the optimiser, so that it is never computed twice for two uses
    done = placed.withColumn("_found", candidates.asNondeterministic()(F.col("html"), F.col("rule"), F.col("url"), F.col("ambient"))).drop("html")
    failed = F.when(F.col("_found.error").isNotNull(), control(F.lit("halt"), F.col("_found.error")))
    return done.withColumns({"candidates": F.col("_found.candidates"), "control": failed}).drop("_found")


def _on_pages(html: pd.Series, *others: pd.Series) -> Iterator[tuple]:
    """(tree, *others) a row, or None for a null page; a page that follows itself is parsed once."""
    last, tree = None, None
    for h, *rest in zip(html, *others, strict=True):
        if h is not None and h != last:
            last, tree = h, dom.parse(h)
        yield (tree, *rest) if h is not None else None


def _evaluated(rows: Iterator[tuple], step: Callable[..., list[str]]) -> pd.Series:
    """A bad selector gives null."""
    out = []
    for row in rows:
        try:
            out.append(step(*row) if row is not None else None)
        except dom.SelectorError:
            out.append(None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def css_text(html: pd.Series, css: pd.Series) -> pd.Series:
    """The trimmed text of each match; null for a null page or a bad selector (see ``css_control``)."""
    return _evaluated(_on_pages(html, css), lambda tree, c: [n.text() for n in dom.select(tree, c)])


@F.pandas_udf(ArrayType(StringType()))
def css_attr(html: pd.Series, css: pd.Series, attr: pd.Series) -> pd.Series:
    """The attribute of each match that has it."""
    return _evaluated(_on_pages(html, css, attr), lambda tree, c, a: [n.attrs[a] for n in dom.select(tree, c) if a in n.attrs])


@F.pandas_udf(ArrayType(StringType()))
def css_outer(html: pd.Series, css: pd.Series) -> pd.Series:
    return _evaluated(_on_pages(html, css), lambda tree, c: [dom.outer_html(n) for n in dom.select(tree, c)])


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def css_texts(html: pd.Series, css: pd.Series) -> pd.Series:
    """css_text for each selector of an array, of a page that is parsed once."""
    return _evaluated(_on_pages(html, css), lambda tree, cs: [[n.text() for n in dom.select(tree, c)] for c in cs])


def css_control(css: str) -> Column | None:
    """The control value of a selector that can't be evaluated, None for a good one."""
    try:
        dom.compile_css(css)
    except dom.SelectorError:
        return control(F.lit("halt"), F.lit(selection_error(css)))
    return None


def selection_error(css: str, url: str = "") -> str:
    return f"selection error: {css!r}" + (f" on {url}" if url else "")


@F.pandas_udf(StringType())
def tidy_html(html: pd.Series) -> pd.Series:
    return html.map(lambda h: dom.tidy(h) if h is not None else None)


@F.pandas_udf(ArrayType(StringType()))
def tidy_each(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [dom.tidy(x) for x in b] if b is not None else None)
