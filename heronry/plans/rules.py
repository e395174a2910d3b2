"""Extraction rules as data: an address pattern, what to gather, and which evidence makes which field.

A rule applies where its pattern is found in the response address and the status is 200; the first that applies wins,
whether or not its evidence then suffices.  Its attempts are tried in order: the first whose required keys all have a candidate
gives the fields.  Keys are case-insensitive patterns, tested on every evidence string of a candidate; ``a|b`` are
alternatives in order, and a trailing ``?`` makes a key optional.

The tables below are fixed values: names, addresses, selectors, keys and their order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: (kind, argument, ...): see ``gather`` in heronry.operators.extract.
Spec = tuple[str, ...]


def metas(*names: str, attr: str = "name") -> tuple[Spec, ...]:
    return tuple(("meta", n, attr) for n in names)


def all_metas(*names: str) -> tuple[Spec, ...]:
    return tuple(("meta_all", n, "name") for n in names)


HIGHWIRE = (*metas("citation_title", "citation_date", "citation_pdf_url", "citation_abstract"), *all_metas("citation_author"))
OPEN_GRAPH = tuple(s for n in ("og:url", "og:title", "og:type", "og:description") for s in (("meta", n, "name"), ("meta", n, "property")))
DUBLIN_CORE = (*metas("DC.Description", "DCTERMS.Abstract", "DC.Title"), *all_metas("DC.Creator", "DC.Subject", "DC.Identifier", "DC.Type"))
SCHEMA = (*HIGHWIRE, *OPEN_GRAPH, *DUBLIN_CORE, *metas("description"), *(("text", css) for css in (".abstract", "#abstract", "#Abstracts", ".abstractInFull")))


@dataclass(frozen=True)
class Attempt:
    mapping: dict[str, str]
    url: str | None = None  # the response address must hold this too

    @property
    def label(self) -> str:
        return " ++ ".join(self.mapping)

    def keys(self) -> list[tuple[list[str], bool, str]]:
        """(alternatives, required, field) of each key."""
        return [([s.strip() for s in k.removesuffix("?").split("|")], not k.endswith("?"), f) for k, f in self.mapping.items()]


@dataclass(frozen=True)
class Rule:
    name: str
    url: str
    specs: tuple[Spec, ...]
    attempts: tuple[Attempt, ...] = field(default=())
    url_evidence: bool = False


def _rule(name: str, url: str, specs: tuple[Spec, ...], mapping: dict[str, str]) -> Rule:
    return Rule(name, url, specs, (Attempt(mapping),))


_CITED = {"citation_title": "title", "citation_author": "author", "citation_pdf_url": "pdf-link"}
_JSON = {"metadata:title": "title", "metadata:abstract": "abstract", "metadata:author?": "author"}

RULES: tuple[Rule, ...] = (
    _rule("arxiv", "export.arxiv.org", (("atom",),), {"feed.entry.0.summary": "abstract", "feed.entry.0.title": "title", "link": "pdf-link"}),
    _rule(
        "sciencedirect", "sciencedirect.com",
        (*HIGHWIRE, *OPEN_GRAPH, ("text", ".Abstracts"), ("text", "a.author"), ("attr", "div.PdfEmbed a.anchor", "href")),
        {"citation_title": "title", "og:description": "abstract-clipped", ".Abstracts": "abstract", "a.author": "author", "div.PdfEmbed?": "pdf-link"},
    ),
    _rule(
        "acm", "dl.acm.org",
        (*DUBLIN_CORE, ("text", ".citation__title"), ("text", ".abstractInFull"), ("attr_all", 'a[class="author-name"]', "title"), ("attr", 'a[title="PDF"]', "href")),
        {"DC.Title?": "title", "citation__title?": "title", "abstractInFull": "abstract", "DC.Creator?": "author", "PDF?": "pdf-link"},
    ),
    _rule("aclweb", "aclweb.org", (*HIGHWIRE, ("text", ".acl-abstract")), _CITED | {".acl-abstract": "abstract"}),
    _rule("ijcai", "ijcai.org", (*HIGHWIRE, ("text", "div.col-md-12")), {"citation_title": "title", "citation_author": "author", "div.col-md-12": "abstract"}),
    _rule(
        "mitpress", "mitpressjournals.org", (*DUBLIN_CORE, ("attr", 'a[class="show-pdf"]', "href"), ("text", ".abstractInFull")),
        {"DC.Title": "title", "DC.Creator": "author", "abstractInFull": "abstract", "show-pdf": "pdf-link"},
    ),
    _rule("oup", "academic.oup.com", (*HIGHWIRE, ("text", 'section[class="abstract"] p[class="chapter-para"]')), _CITED | {"abstract": "abstract"}),
    # the key is escaped, since as a pattern "h4 + p" can match no evidence
    _rule("nips", "nips.cc", (*HIGHWIRE, ("text", "h4 + p")), _CITED | {r"h4 \+ p": "abstract"}),
    _rule("iospress", "content.iospress.com", (*HIGHWIRE, ("attr", "[data-abstract]", "data-abstract")), _CITED | {"data-abstract": "abstract"}),
    _rule(
        "digitalhumanities", "digitalhumanities.org", (("text", "#abstract"), ("text", ".articleTitle"), ("each", ".author")),
        {"#abstract": "abstract", ".articleTitle": "title", ".author": "author"},
    ),
    _rule(
        "kybernetika", "kybernetika.cz", (("text", ".ar_title"), ("text", ".abstract"), ("each", ".authors a")),
        {".abstract": "abstract", ".ar_title": "title", ".authors a": "author"},
    ),
    _rule("ieee", "ieeexplore.ieee.org", (("global_json",),), _JSON | {"metadata:pdf-link?": "pdf-link"}),
    Rule(
        "springer", "link.springer.com",
        (*HIGHWIRE, *OPEN_GRAPH, ("text", "section#Abs1 > p.Para"), ("combined", "#body div.content"), ("ld_json",)),
        (
            Attempt(_JSON),
            Attempt(_CITED | {"og:description": "abstract-clipped", "section#Abs1 > p.Para": "abstract"}, "/chapter/"),
            Attempt(_CITED | {"og:description": "abstract-clipped", "#body div.content": "abstract"}, "/referenceworkentry/"),
            Attempt(_CITED | {"og:description": "abstract"}, "/article/"),
        ),
    ),
    _rule("neurips", "neurips.cc", (*HIGHWIRE, ("lines", "neurips")), _CITED | {"neurips.cc.abstract": "abstract"}),
    _rule(
        "isca", "isca-speech.org",
        (("within", "div.w3-card", "p", "", "isca.abstract"), ("within", "div.w3-card", "h5", "", "isca.authors"), ("within", "div.w3-card", "a", "href", "pdf-link"), ("within", "div.w3-card", "h3", "", "isca.title")),
        {"title": "title", "authors": "authors", "pdf-link?": "pdf-link", "abstract": "abstract"},
    ),
    _rule("lrec", "lrec-conf.org", (("lines", "lrec"),), {"abstract": "abstract", "title": "title", "authors-block": "authors-block", "pdf-link?": "pdf-link"}),
    _rule(
        "cogsci", "cogsci.mindmodeling.org", (("text", "#abstract"), ("text", ".subAbstract"), ("lines", "cogsci")),
        {"#abstract?": "abstract", ".subAbstract?": "abstract", "grepped.abstract?": "abstract"},
    ),
)

GENERAL = Rule("general", "", SCHEMA, (Attempt({"title": "title", "description|abstract": "abstract", "author|creator?": "author", "pdf?": "pdf-link"}),), url_evidence=True)

#: Pages whose hosts need scripts to run before they can be read.
SCRIPTED_HOSTS = ("linkinghub.elsevier.com", "aaai.org")

#: A rule for the synthetic pages, from the same parts.
EXAMPLE = _rule(
    "example", r"example\.(com|net|org)", (("text", "article > h1"), ("combined", "article p"), ("attr_all", "nav a", "href")),
    {"article > h1": "title", "article p": "abstract", "nav a?": "pdf-link"},
)
