"""The principal document of a page: which part of the tree it is, its text, headlines and dates.

The tree is built by a small parser that repairs what pages leave open; the document is chosen by structure
alone (main, articles, body), never by class names or words. Pages are read where they are, batch by batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements and roles whose text belongs to no document, controls, and names of date fields.
EXCLUDED = frozenset(("aside", "footer", "nav", "script", "style", "template", "noscript", "svg"))
EXCLUDED_ROLES = frozenset(("banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search", "tablist", "toolbar"))
COMMENT_ROLES = frozenset(("comment", "reply"))
INTERACTIVE = frozenset(("button", "input", "option", "select", "textarea"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
COLLECTION_ROLES = frozenset(("feed", "list", "listbox", "grid", "tree"))
DATE_KINDS = {
    "article:published_time": "ORIGINAL_PUBLICATION", "article:modified_time": "MODIFIED", "datepublished": "ORIGINAL_PUBLICATION",
    "date_published": "ORIGINAL_PUBLICATION", "datemodified": "MODIFIED", "date_modified": "MODIFIED",
}
#: Elements that end a block of text, elements without an end, and elements that an equal one ends.
BLOCKS = frozenset(("p", "div", "section", "article", "main", "li", "ul", "ol", "tr", "table", "br", "blockquote", "pre", "figure", "header", *HEADINGS))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_ENDS_LIKE = {"li": "li", "tr": "tr", "td": "td", "option": "option"}
_OUT_OF_P = BLOCKS - {"br"}


class Node:
    """An element with its attributes, its parent, and its contents in order (texts and elements)."""

    __slots__ = ("attrs", "parent", "parts", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]

    def walk(self) -> Iterator[Node]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += reversed(node.children())

    def above(self, end: Node | None = None) -> Iterator[Node]:
        node = self.parent
        while node is not None and node is not end:
            yield node
            node = node.parent

    @property
    def role(self) -> str:
        """The first of its roles; the others are for readers that don't know it."""
        return (self.attrs.get("role", "").lower().split() or [""])[0]

    @property
    def props(self) -> list[str]:
        return self.attrs.get("itemprop", "").lower().split()

    @property
    def is_article(self) -> bool:
        return self.tag == "article" or self.role == "article"

    @property
    def is_control(self) -> bool:
        return self.tag in INTERACTIVE or self.role == "button"

    def excluded(self) -> bool:
        comment = self.role in COMMENT_ROLES or "comment" in self.props or self.attrs.get("aria-label", "").strip().lower() in ("comments", "comment", "reply", "replies")
        return self.tag in EXCLUDED or self.role in EXCLUDED_ROLES or comment

    def text(self) -> str:
        """All text that isn't excluded, collapsed."""
        out: list[str] = []
        waiting: list = [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or not x.excluded():
                waiting += reversed(x.parts)
                if x.tag in BLOCKS:
                    out.append(" ")
        return clean("".join(out))


def clean(text: str) -> str:
    return " ".join(text.split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _OUT_OF_P:
            self._leave("p", BLOCKS - {"p"})
        if tag in _ENDS_LIKE:
            self._leave(_ENDS_LIKE[tag], frozenset(("ul", "ol", "table", "select")))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _leave(self, tag: str, stop: frozenset) -> None:
        """Ends an open element of that name, unless one of stop lies in between."""
        for node in (self.at, *self.at.above(self.root)):
            if node.tag == tag and node.parent is not None:
                self.at = node.parent
                return
            if node.tag in stop:
                return

    def handle_endtag(self, tag):
        for node in (self.at, *self.at.above()):
            if node.tag == tag and node.parent is not None:
                self.at = node.parent
                return

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _inside_excluded(node: Node, region: Node) -> bool:
    return node is not region and (node.excluded() or any(a.excluded() for a in node.above(region)))


def _other_resource(anchor: Node, url: str) -> bool:
    """Whether a link leads to another page than url."""
    target = urljoin(url or "http://localhost/", anchor.attrs.get("href", "").strip())
    own, there = urlsplit(url or "http://localhost/"), urlsplit(target)
    return bool(anchor.attrs.get("href", "").strip()) and there.scheme in ("http", "https") and (own.netloc.lower(), own.path.rstrip("/"), own.query) != (there.netloc.lower(), there.path.rstrip("/"), there.query)


def _all_links(node: Node, url: str) -> bool:
    """Whether the whole text of a block is links to other pages."""
    text = node.text()
    anchors = [a for a in node.walk() if a is not node and a.tag == "a" and not any(x.tag == "a" for x in a.above(node))]
    return bool(text) and bool(anchors) and all(_other_resource(a, url) for a in anchors) and clean(" ".join(a.text() for a in anchors)) == text


def _is_reference(unit: Node, region: Node, url: str) -> bool:
    """Whether an article unit as a whole is a link to another document."""
    for a in unit.above(region):
        if a.tag == "a":
            return _other_resource(a, url)
    return _all_links(unit, url)


def _has_headline(node: Node) -> bool:
    return any(x.tag in HEADINGS and x.text() for x in node.walk() if not _inside_excluded(x, node))


def _says_more(node: Node) -> bool:
    """Whether a block has text outside its headlines."""
    return bool(_collected(node, (), headings=False)[0])


def _documents_listed(region: Node) -> bool:
    """Whether an explicit collection holds two or more units that are documents of their own."""
    for box in region.walk():
        if box.tag in ("ul", "ol") or box.role in COLLECTION_ROLES:
            units = [c for c in box.children() if (c.tag == "li" or c.role == "listitem" or c.is_article) and not c.excluded() and _has_headline(c) and _says_more(c)]
            if len(units) > 1:
                return True
    return False


def _article_units(region: Node) -> list[Node]:
    """Outermost articles of a region."""
    found = [n for n in region.walk() if n.is_article and not _inside_excluded(n, region)]
    return [n for n in found if not any(a.is_article for a in n.above(region))]


def _separated(units: list[Node], region: Node, url: str) -> list[Node] | None:
    """The units that can be the document: not whole links elsewhere, not empty; of several the owner of the only
    articleBody. None if it stays open."""
    references = [u for u in units if _is_reference(u, region, url)]
    rest = [u for u in units if u not in references and u.text()]
    if len(rest) > 1:
        bodies = [n for n in region.walk() if "articlebody" in n.props and not _inside_excluded(n, region)]
        owners = [u for u in rest if len(bodies) == 1 and bodies[0].text() and (bodies[0] is u or u in bodies[0].above())]
        rest = owners if len(owners) == 1 else rest
    return None if len(rest) > 1 or (not rest and references) else rest


def _rival_divs(boundary: Node) -> bool:
    """Whether two plain divs side by side both look like documents."""

    def header_only(n: Node) -> bool:
        own = clean("".join(x for x in n.parts if isinstance(x, str)))
        return not own and all(c.tag == "header" for c in n.children() if c.text())

    units = [c for c in boundary.children() if c.tag == "div" and not c.role and not header_only(c) and _has_headline(c) and _says_more(c)]
    return len(units) > 1


def _reference_blocks(boundary: Node, url: str) -> tuple[Node, ...]:
    """Largest blocks that are nothing but links to other pages; inline links in prose are none."""
    out, waiting = [], [boundary]
    while waiting:
        node = waiting.pop()
        for child in node.children():
            if child.tag == "a" or not child.text():
                continue
            if _all_links(child, url):
                out.append(child)
            elif not clean("".join(x for x in child.parts if isinstance(x, str))):
                waiting.append(child)
    return tuple(out)


def _collected(boundary: Node, references: tuple[Node, ...], headings: bool = False) -> tuple[list[str], bool]:
    """Blocks of text of the boundary, and whether any of it is outside links."""
    blocks, prose = [[]], False
    waiting: list = [(x, False) for x in reversed(boundary.parts)]
    while waiting:  # a page may be nested deeper than calls can be
        x, linked = waiting.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
            prose = prose or (not linked and bool(x.strip()))
        elif x in references or x.excluded() or x.is_control or (x.tag in HEADINGS and not headings) or x.tag in ("head", "title"):
            blocks.append([])
        elif not (x.is_article and boundary.is_article and "articlebody" not in x.props):  # else a document below the document
            if x.tag in BLOCKS:
                blocks.append([])
                waiting.append((None, False))
            waiting += [(y, linked or x.tag == "a") for y in reversed(x.parts)]
    return [b for b in (clean("".join(x)) for x in blocks) if b], prose


def _zone(raw: str) -> str | None:
    if raw[-1:] in ("Z", "z"):
        return "Z"
    found = re.search(r"[T\s]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?([+-]\d{2}(?::?\d{2})?)$|\[([^\]]+)\]$", raw)
    return found and (found[1] or found[2])


def _linked_data(value: object, same_page) -> Iterator[tuple[str, str]]:
    """(raw date, kind) of the entities that name this page, and no other, as what they are."""
    graph = value.get("@graph") if isinstance(value, dict) else None
    units = graph if isinstance(graph, list) else [] if graph is not None else value if isinstance(value, list) else [value]
    for unit in units:
        if not isinstance(unit, dict):
            continue
        named: list = []
        for key, x in unit.items():
            if key.lower() in ("@id", "url", "mainentityofpage"):
                named += [x[k] for k in ("@id", "url") if k in x] or [None] if isinstance(x, dict) else [x]
        if not named or not all(isinstance(x, str) and x.strip() and same_page(x.strip()) for x in named):
            continue
        for key, x in unit.items():
            kind = {"datepublished": "ORIGINAL_PUBLICATION", "datemodified": "MODIFIED"}.get(key.lower())
            if kind and isinstance(x, (str, int, float)) and not isinstance(x, bool) and str(x).strip():
                yield str(x).strip(), kind


def _dates(root: Node, boundary: Node, url: str) -> list[dict]:
    out: list[tuple[str, str]] = []
    linked: list[tuple[str, str]] = []

    def same_page(named: str) -> bool:
        a, b = urlsplit(urljoin(url or "http://localhost/", named)), urlsplit(url or "http://localhost/")
        return (a.netloc.lower().removeprefix("www."), a.path.rstrip("/")) == (b.netloc.lower().removeprefix("www."), b.path.rstrip("/"))

    for node in root.walk():
        if node.tag == "meta" and not any(a is not root and a.tag not in ("html", "head") for a in node.above(root)):
            kind = DATE_KINDS.get((node.attrs.get("property") or node.attrs.get("name") or node.attrs.get("itemprop") or "").lower())
            if kind and node.attrs.get("content", "").strip():
                out.append((node.attrs["content"].strip(), kind))
        elif node.tag == "script" and node.attrs.get("type", "").split(";")[0].strip().lower() == "application/ld+json":
            try:
                linked += _linked_data(json.loads("".join(x for x in node.parts if isinstance(x, str))), same_page)
            except ValueError:
                continue
    for node in boundary.walk():
        if node.tag == "time" and not _inside_excluded(node, boundary) and not any(a.is_article for a in node.above(boundary)):
            kind = "ORIGINAL_PUBLICATION" if "pubdate" in node.attrs or "datepublished" in node.props else "MODIFIED" if "datemodified" in node.props else None
            if kind and node.attrs.get("datetime", "").strip():
                linked.append((node.attrs["datetime"].strip(), kind))
    return [{"raw": raw, "kind": kind, "zone": _zone(raw)} for raw, kind in (*out, *linked)]


def _canonical(root: Node) -> str | None:
    """The canonical url of the page if it names exactly one."""
    found = {n.attrs["href"].strip() for n in root.walk() if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href", "").strip()}
    return found.pop() if len(found) == 1 else None


def _choice(root: Node, url: str) -> tuple[str, str | None, Node | None]:
    """(status, kind of boundary, boundary) by the structure of a page."""
    parts = urlsplit(url)
    nav = any(n.tag == "nav" for n in root.walk())
    mains = [n for n in root.walk() if (n.tag == "main" or n.role == "main") and not _inside_excluded(n, root)]
    if len(mains) > 1:
        return "AMBIGUOUS", None, None
    region = mains[0] if mains else root
    if _documents_listed(region):
        return "COLLECTION", None, None
    articles = _article_units(region)
    if len(articles) > 1:
        found = _separated(articles, region, url)
        if found is None:
            return "COLLECTION", None, None
        articles = found
    if articles:
        kind, boundary = "article", articles[0]
    elif mains:
        kind, boundary = "main", region
        if parts.path in ("", "/") and url and nav and not any(n.tag == "h1" for n in region.walk()):
            return "LANDING_PAGE", None, None
    else:
        if nav and parts.query.lower().startswith(("q=", "query=")) and "search" in parts.path.lower():
            return "SEARCH_SHELL", None, None
        bodies = [n for n in root.walk() if n.tag == "body"]
        if len(bodies) > 1:
            return "AMBIGUOUS", None, None
        kind, boundary = "body", bodies[0] if bodies else root
    if _rival_divs(boundary):
        return "AMBIGUOUS", None, None
    return "READY", kind, boundary


def _xml(content: str) -> tuple:
    """(status, root element, namespaces) of an XML document: a FEED, RDF that states relations, or XML; MALFORMED."""
    try:
        root = ElementTree.fromstring(content.strip())
    except (ElementTree.ParseError, ValueError):
        return "MALFORMED", None, []
    local = lambda name: name.rpartition("}")[2].lower()
    names = {local(n.tag) for n in root.iter() if isinstance(n.tag, str)}
    spaces = sorted({n.tag[1:].partition("}")[0] for n in root.iter() if isinstance(n.tag, str) and n.tag.startswith("{")})
    kind = local(root.tag)
    if kind in ("rss", "feed") or (kind == "rdf" and {"channel", "item"} <= names):
        return "FEED", kind, spaces
    related = {"about", "resource", "nodeid", "datatype", "parsetype"}
    if kind == "rdf" and ("description" in names or any(local(k) in related for n in root.iter() for k in n.attrib)):
        return "RDF_GRAPH", kind, spaces
    return "XML", kind, spaces


def read_page(html: str | None, url: str | None = None, content_type: str | None = None) -> tuple:
    """(status, boundary, title, headline, body, canonical, dates, segments) of a page.

    XML documents and feeds are told apart by their root. Of HTML, a single main or article is the document; of
    several articles the one that isn't empty, a link elsewhere, or outside the only articleBody. Collections, landing
    pages, search pages and open cases have a status of their own and no body. Headlines, controls and blocks that
    only link elsewhere are left out of the body. Without text the status is EMPTY; without text outside links,
    LINKS_ONLY; a body that only repeats the title or a headline is TITLE_ONLY.
    """
    html, url = html or "", url or ""
    media = (content_type or "").split(";")[0].strip().lower()
    if "xml" in media and "html" not in media or html.lstrip().startswith("<?xml") and "<html" not in html[:2000].lower():
        status, _, _ = _xml(html)
        return status, None, "", None, "", None, [], []
    root = tree(html)
    title = next((n.text() for n in root.walk() if n.tag == "title" and not any(a.tag == "svg" for a in n.above())), "")
    status, kind, boundary = _choice(root, url)
    if boundary is None:
        return status, None, title, None, "", _canonical(root), [], []
    headlines = [x.text() for x in boundary.walk() if x.tag in HEADINGS and not _inside_excluded(x, boundary) and x.text()]
    segments, prose = _collected(boundary, _reference_blocks(boundary, url) if kind != "body" else ())
    body = clean(" ".join(segments))
    if not body:
        status = "TITLE_ONLY" if headlines else "EMPTY"
    elif not prose:
        status = "LINKS_ONLY"
    elif body.lower() in {title.lower(), *(h.lower() for h in headlines)}:
        status = "TITLE_ONLY"
    return status, kind, title, headlines[0] if headlines else None, body, _canonical(root), _dates(root, boundary, url), segments


_SCHEMA = "page_id long, status string, boundary string, title string, headline string, body string, canonical string, dates array<struct<raw:string,kind:string,zone:string>>, segments array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 6 + [pa.list_(pa.struct([("raw", pa.string()), ("kind", pa.string()), ("zone", pa.string())])), pa.list_(pa.string())]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = zip(*[read_page(h, u) for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True)], strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]], names=[x.split()[0] for x in ("page_id", "status", "boundary", "title", "headline", "body", "canonical", "dates", "segments")])


def principal_documents(pages: DataFrame) -> DataFrame:
    """read_page() of each page (page_id, url, html), where the pages are read; nothing is shuffled."""
    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")).mapInArrow(_read, _SCHEMA)


def segment_of(segments: Column, start: Column, end: Column) -> Column:
    """struct<segment, start, end>: the segment of a body that a span of its text lies in, and the span's offsets there;
    null where it crosses segments. Segments stand in the body with one space between."""
    sizes = F.transform(segments, lambda s: F.length(s) + 1)
    begins = F.transform(sizes, lambda s, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    rows = F.zip_with(begins, sizes, lambda b, n: F.struct(b.alias("begin"), (b + n - 1).alias("end")))
    numbered = F.transform(rows, lambda r, i: F.struct(i.alias("segment"), (start - r["begin"]).cast("int").alias("start"), (end - r["begin"]).cast("int").alias("end"), ((start >= r["begin"]) & (end <= r["end"])).alias("inside")))
    found = F.element_at(F.filter(numbered, lambda r: r["inside"]), F.lit(1))
    return F.when(F.exists(numbered, lambda r: r["inside"]), F.struct(found["segment"].alias("segment"), found["start"].alias("start"), found["end"].alias("end")))
