"""Values at a path of an XML text, as Arrow-batched functions.

A path is a list of tag names and positions from 0, as ``feed``, ``entry``, ``0``, ``title``; a name takes all children of that name, a position one of what the names
before it gave.  Names are compared without their name spaces.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SELECTED = "struct<values:array<string>,control:struct<code:string,msg:string>>"


def local_name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def parse_xml(text: str) -> ElementTree.Element | None:
    """The root; None for what is no XML."""
    try:
        return ElementTree.fromstring(re.sub(r"\A\s*<\?xml[^>]*\?>", "", text))
    except (ElementTree.ParseError, ValueError):
        return None


def elements_at(root: ElementTree.Element, path: list[str]) -> list[ElementTree.Element]:
    found = [root] if path and local_name(root) == path[0] else []
    for step in path[1:]:
        if step.isdigit():
            found = found[int(step) : int(step) + 1]
        else:
            found = [c for e in found for c in e if local_name(c) == step]
    return found


def _selected(xml: pd.Series, path: list[str], attr: str | None, where: dict[str, str]) -> pd.DataFrame:
    out = []
    for text in xml:
        root = parse_xml(text) if text is not None else None
        if root is None:
            out.append((None, {"code": "halt", "msg": "no XML" if text is not None else "no input"}))
            continue
        found = [e for e in elements_at(root, path) if all(e.get(k) == v for k, v in where.items()) and (attr is None or e.get(attr) is not None)]
        values = [e.get(attr) if attr else "".join(e.itertext()) for e in found]
        out.append((values, None) if values else (None, {"code": "continue", "msg": f"nothing at {'.'.join(path)}"}))
    return pd.DataFrame(out, columns=["values", "control"])


def select_path(xml: Column, path: list[str], attr: str | None = None, where: dict[str, str] | None = None) -> Column:
    """struct<values, control>: the texts at the path, or an attribute of those that have it, of elements whose attributes are as in ``where``.

    Without any there is a control: ``halt`` for a null or what is no XML, else ``continue``.
    """

    @F.pandas_udf(SELECTED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return _selected(texts, path, attr, where or {})

    return run(xml)


def select_tag(xml: Column, path: list[str]) -> Column:
    """struct<value, evidence, control>: the first text at the path with its evidence; nothing there is a ``halt``."""
    one = select_path(xml, path)
    return F.struct(F.get(one["values"], F.lit(0)).alias("value"), F.lit(f"xml:select:'{'.'.join(path)}'").alias("evidence"), F.when(one["control"].isNotNull(), F.struct(F.lit("halt").alias("code"), one["control"]["msg"].alias("msg"))).alias("control"))
