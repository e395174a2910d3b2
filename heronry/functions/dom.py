"""An HTML tree, a subset of CSS selectors over it, and an indenting serialiser; plain Python, for Arrow batches.

Selectors: types, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]`` and ``^= $= *= ~= |=``, ``:not(...)`` of one of these, ``:first-child``, ``:last-child``,
descendant, child ``>``, neighbour ``+``, later sibling ``~``, lists with commas.  No walk recurses, so that depth is no matter.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from itertools import product

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body title meta link script style div p ul ol li dl dt dd table thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 article section "
    "nav header footer main aside blockquote pre form fieldset figure figcaption address hr noscript".split()
)
#: An open element that ends where another begins.
_P_ENDS = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def text(self) -> str:
        """The text of all descendants, trimmed."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.counts: Counter[str] = Counter()  # of open tags, so that what isn't open isn't looked for

    def _cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.counts[node.tag] -= 1
        del self.open[i:]

    def _close_until(self, tags: set[str] | frozenset[str], scope: set[str]) -> None:
        if not any(self.counts[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._cut(i)
                return
            if self.open[i].tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _P_ENDS:
            self._close_until({"p"}, {"table", "td", "th", "button"})
        if tag in _SAME:
            self._close_until(_SAME[tag], _SCOPE[tag])
            if tag == "tr":
                self._close_until({"tr"}, {"table"})
        named: dict[str, str] = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        node = Node(tag, named, [], self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML a trailing slash means nothing

    def handle_endtag(self, tag: str) -> None:
        if not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(text: str) -> Node:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


_NAME = r"[A-Za-z_\-\u0080-￿][\w\-\u0080-￿]*"
_SIMPLE = re.compile(rf"""\*|(?P<tag>{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})|\[\s*(?P<a>[\w\-:.]+)\s*(?:(?P<op>[~^$*|]?)=\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*)?\]|:(?P<pseudo>first-child|last-child)|:not\(\s*(?P<no>[^()]+?)\s*\)""")


@dataclass(frozen=True)
class Compound:
    joint: str  # how it follows the one before it: "", " ", ">", "+" or "~"
    tag: str | None
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attrs: tuple[tuple[str, str, str | None], ...]
    places: tuple[str, ...] = ()
    nots: tuple[Compound, ...] = ()

    def fits(self, node: Node) -> bool:
        if self.tag and node.tag != self.tag:
            return False
        if self.ids and any(node.attrs.get("id") != i for i in self.ids):
            return False
        if self.classes and ("class" not in node.attrs or not set(self.classes) <= set(node.attrs["class"].split())):
            return False
        if self.attrs and not all(k in node.attrs and (v is None or _HOLDS[op](node.attrs[k], v)) for k, op, v in self.attrs):
            return False
        if self.places:
            around = node.parent.elements() if node.parent else [node]
            if any(around[0 if p == "first-child" else -1] is not node for p in self.places):
                return False
        return not self.nots or not any(c.fits(node) for c in self.nots)


_HOLDS = {
    "": lambda a, v: a == v, "^": lambda a, v: v != "" and a.startswith(v), "$": lambda a, v: v != "" and a.endswith(v),
    "*": lambda a, v: v != "" and v in a, "~": lambda a, v: v in a.split(), "|": lambda a, v: a == v or a.startswith(f"{v}-"),
}


class SelectorError(ValueError):
    """The selector isn't in the subset."""


def _split_list(css: str) -> list[str]:
    return re.findall(r"""(?:[^,\[("']|\[[^\]]*\]|\([^)]*\)|"[^"]*"|'[^']*')+""", css)


@lru_cache(maxsize=1024)
def compile_css(css: str) -> tuple[tuple[Compound, ...], ...]:
    out = []
    for part in _split_list(css):
        chain: list[Compound] = []
        at, joint, part = 0, "", part.strip()
        while at < len(part):
            tag, ids, classes, attrs, places, nots, begin = None, [], [], [], [], [], at
            while at < len(part) and (m := _SIMPLE.match(part, at)):
                if m["tag"] and at > begin:
                    break
                tag = m["tag"].lower() if m["tag"] else tag
                ids += [m["id"]] if m["id"] else []
                classes += [m["cls"]] if m["cls"] else []
                attrs += [(m["a"].lower(), m["op"] or "", next((m[k] for k in ("v1", "v2", "v3") if m[k] is not None), None))] if m["a"] else []
                places += [m["pseudo"]] if m["pseudo"] else []
                if m["no"]:
                    inner = compile_css(m["no"])
                    if any(len(c) > 1 for c in inner):
                        raise SelectorError(css)
                    nots += [c[0] for c in inner]
                at = m.end()
            if at == begin:
                raise SelectorError(css)
            chain.append(Compound(joint, tag, tuple(ids), tuple(classes), tuple(attrs), tuple(places), tuple(nots)))
            m = re.compile(r"\s*([>+~])\s*|\s+").match(part, at)
            if m:
                joint, at = m[1] or " ", m.end()
                if at == len(part):
                    raise SelectorError(css)
            elif at < len(part):
                raise SelectorError(css)
        if not chain:
            raise SelectorError(css)
        out.append(tuple(chain))
    if not out:
        raise SelectorError(css)
    return tuple(out)


def _matching(root: Node, css: str) -> Iterator[Node]:
    """Matching descendants of ``root`` in document order; what matches is carried down, so that the time is linear in the page."""
    chains = compile_css(css)
    if all(len(chain) == 1 for chain in chains):  # no joints: what is above a node or beside it is no matter
        yield from (n for n in root.walk() if n is not root and any(chain[0].fits(n) for chain in chains))
        return
    top = root
    while top.parent is not None:
        top = top.parent
    none = [0] * len(chains)  # a chain's bit k: its first k + 1 compounds fit, the last of them on this node
    # an element, whether it is below root, bits of its parent, of all above, of the sibling before and of all before
    stack: list[tuple[Node, bool, list[int], list[int], list[list[int]]]] = []

    def push(node: Node, inside: bool, own: list[int], above: list[int]) -> None:
        before = [none, none]  # shared by the siblings, which come in order
        stack.extend((c, inside, own, above, before) for c in reversed(node.children) if isinstance(c, Node))

    push(top, top is root, none, none)
    while stack:
        node, inside, parent, above, before = stack.pop()
        bits = []
        for c, chain in enumerate(chains):
            after = {">": parent[c], " ": above[c], "+": before[0][c], "~": before[1][c]}
            bits.append(sum(1 << k for k, x in enumerate(chain) if (not k or after[x.joint] >> (k - 1) & 1) and x.fits(node)))
        before[:] = bits, [a | b for a, b in zip(before[1], bits, strict=True)]
        if inside and any(b >> (len(chain) - 1) & 1 for b, chain in zip(bits, chains, strict=True)):
            yield node
        if node.children:
            push(node, inside or node is root, bits, [a | b for a, b in zip(above, bits, strict=True)])


def select(root: Node, css: str) -> list[Node]:
    """Matching descendants of ``root``, in document order."""
    return list(_matching(root, css))


def select_one(root: Node, css: str) -> Node | None:
    return next(_matching(root, css), None)


def case_variations(seed: str) -> list[str]:
    """Each capital as itself and in lower case, in binary order; everything else in lower case."""
    return ["".join(p) for p in product(*((c, c.lower()) if c.isascii() and c.isupper() else (c.lower(),) for c in seed))]


def meta_selector(name: str, attr: str = "name") -> str:
    return ",".join(f'meta[{attr}="{v}"]' for v in case_variations(name))


@lru_cache(maxsize=1024)
def _cases(seed: str) -> re.Pattern[str]:
    """What fully matches the strings of ``case_variations``."""
    return re.compile("".join(f"[{c}{c.lower()}]" if c.isascii() and c.isupper() else re.escape(c.lower()) for c in seed))


def metas_named(metas: list[Node], name: str, attr: str = "name") -> list[Node]:
    """Those of a page's meta elements that ``meta_selector`` selects: one match each, where a name of n capitals has 2 ** n selectors."""
    cases = _cases(name)
    return [n for n in metas if attr in n.attrs and cases.fullmatch(n.attrs[attr])]


def _open_tag(node: Node) -> str:
    return f"<{node.tag}" + "".join(f' {k}="{_html.escape(v)}"' for k, v in node.attrs.items()) + (" />" if node.tag in VOID else ">")


def outer_html(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]  # what is still to write; strings are ready
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag != "#document":
            out.append(_open_tag(x))
            if x.tag in VOID:
                continue
            stack.append(f"</{x.tag}>")
        raw = x.tag in ("script", "style")
        stack.extend(c if isinstance(c, Node) or raw else _html.escape(c, quote=False) for c in reversed(x.children))
    return "".join(out)


def _with_blocks(root: Node) -> set[int]:
    """The ids of nodes that are block tags or hold one."""
    found: set[int] = set()
    for node in root.walk():
        up = node if node.tag in BLOCK else None
        while up is not None and id(up) not in found:
            found.add(id(up))
            up = up.parent
    return found


#: Lines are indented no further, so that what is written stays in proportion to the page.
DEEPEST = 64


def tidy(text: str, indent: int = 4) -> str:
    """One line for each block tag and each run of text, indented by depth; a fragment is put into html and body."""
    root = parse(text)
    if not any(n.tag in ("html", "body") for n in root.elements()):
        body = Node("body", children=root.children)
        root = Node("#document", children=[Node("html", children=[body])])
        root.children[0].parent, body.parent = root, root.children[0]
        for c in body.elements():
            c.parent = body
    blocks, out, run = _with_blocks(root), [], []

    def flush(depth: int) -> None:
        line = re.sub(r"\s+", " ", "".join(run)).strip()
        if line:
            out.append(" " * (indent * min(depth, DEEPEST)) + line)
        run.clear()

    stack: list[tuple[Node, int, int]] = [(root, 0, 0)]  # node, its children's depth, the next child
    while stack:
        node, depth, k = stack.pop()
        if k == len(node.children):
            flush(depth)
            if node is not root:
                out.append(" " * (indent * min(depth - 1, DEEPEST)) + f"</{node.tag}>")
            continue
        stack.append((node, depth, k + 1))
        c = node.children[k]
        if isinstance(c, str):
            run.append(_html.escape(c, quote=False))
        elif c.tag in ("script", "style"):
            flush(depth)
            out.append(" " * (indent * min(depth, DEEPEST)) + _open_tag(c))
            out.extend(x for x in "".join(x for x in c.children if isinstance(x, str)).split("\n") if x.strip())
            out.append(" " * (indent * min(depth, DEEPEST)) + f"</{c.tag}>")
        elif id(c) in blocks:
            flush(depth)
            out.append(" " * (indent * min(depth, DEEPEST)) + _open_tag(c))
            if c.tag not in VOID:
                stack.append((c, depth + 1, 0))
        else:
            run.append(outer_html(c))
    return "\n".join(out)
