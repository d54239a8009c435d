"""Structure of stored pages through the standard library's parser, as Arrow-batched functions.

Regular expressions give counts (operators.scalars); what needs ancestors, siblings or nesting is read from a
small tree here. A null or empty page gives empty lists.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
import pyarrow as pa

from .lazy import arrow, vectorized

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Fixed values.
NAVIGATION = frozenset(("nav", "navigation", "menu", "navbar", "header-menu", "main-menu", "primary-nav"))
FOOTER = frozenset(("footer", "foot", "bottom", "site-footer", "page-footer"))
SIDEBAR = frozenset(("sidebar", "aside", "widget", "side-bar", "right-col", "left-col"))
COMMENTS = frozenset(("comment", "comments", "discussion", "respond", "reply", "user-content"))
AUTHOR = frozenset(("author", "bio", "about-author", "author-box", "byline"))
BOILERPLATE = frozenset(("script", "style", "nav", "header", "footer", "aside"))


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.children))

    def text(self, skip=frozenset()) -> str:
        if not self.children:
            return ""
        parts, stack = [], list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag not in skip:
                stack.extend(reversed(n.children))
        return " ".join(" ".join(parts).split())

    def find(self, *tags: str):
        found, stack = [], self.children[::-1]
        while stack:
            n = stack.pop()
            if not isinstance(n, str):
                if n.tag in tags:
                    found.append(n)
                if n.children:
                    stack.extend(n.children[::-1])
        return found

    def ancestors(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def names(self) -> set[str]:
        return {x.lower() for k in ("class", "id") for x in (self.attrs.get(k) or "").split()}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("document", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: One piece of a plain page: a tag in lower case whose attributes are quoted, or text without references.
_PIECE = re.compile(r'<(/?)([a-z][a-z0-9]*)((?: [a-z]+(?:-[a-z]+)*="[^"<>&]*(?:&amp;[^"<>&]*)*")*)>|([^<&]+)')
_ATTRIBUTE = re.compile(r' ([a-z-]+)="([^"]*)"')
#: Elements whose content the parser reads like any other's.
_PLAIN = frozenset("html body div span p a b i u em strong small ul ol li dl dt dd table tr td th thead tbody h1 h2 h3 h4 h5 h6 nav header footer aside article section main br hr img".split())


def _plain(html: str) -> Node | None:
    """The tree of a page of plain pieces only, as the parser builds it; None for any other page."""
    root = at = Node("document", {}, None)
    end = 0
    for m in _PIECE.finditer(html):
        if m.start() != end:
            return None
        end = m.end()
        close, tag, given, data = m.groups()
        if data is not None:
            at.children.append(data)
        elif tag not in _PLAIN:
            return None
        elif not close:
            node = Node(tag, {k: v.replace("&amp;", "&") for k, v in _ATTRIBUTE.findall(given)} if given else {}, at)
            at.children.append(node)
            if tag not in _VOID:
                at = node
        elif given:
            return None
        else:
            n = at
            while n is not None and n.tag != tag:
                n = n.parent
            if n is not None and n.parent is not None:
                at = n.parent
    return root if end == len(html) else None


def parse(html: str | None) -> Node:
    if html and (root := _plain(html)) is not None:
        return root
    builder = _Builder()
    builder.feed(html or "")
    return builder.root


def placement(link: Node) -> str:
    """Where a link stands, from its ancestors' tags, classes and ids; later rules override earlier ones."""
    above = list(link.ancestors())
    tags, names = {n.tag for n in above}, set().union(*(n.names() for n in above if n.attrs))
    found = "content"
    for kind, own, words in (("navigation", {"nav", "header"}, NAVIGATION), ("footer", {"footer"}, FOOTER), ("sidebar", {"aside"}, SIDEBAR), ("comments", set(), COMMENTS), ("author_bio", set(), AUTHOR)):
        if tags & own or names & words:
            found = kind
    return found


#: Absolute URLs without anything to resolve, escape or fold, as they are and behind a redirect.
_SIMPLE = re.compile(r"https?://([a-z0-9.-]+)(?:/[A-Za-z0-9_/.-]*)?")
_SIMPLE_REDIRECT = re.compile(rf"/url\?q=({_SIMPLE.pattern})(?:&[a-z]+=[A-Za-z0-9]*)*")


@lru_cache(1 << 10)
def _host(base: str) -> str:
    return urlparse(base).netloc


def _target(base: str, href: str) -> tuple[str, str, bool]:
    """The whole URL, its host, and whether that is the page's own."""
    if m := _SIMPLE.fullmatch(href):
        return href, m[1], m[1] == _host(base)
    url = urljoin(base, href)
    host = urlparse(url).netloc
    return url, host.lower(), not host or host == _host(base)


def links(html: str | None, base: str = "") -> list[dict]:
    out = []
    for n in parse(html).find("a"):
        href = (n.attrs.get("href") or "").strip()
        if not href or href.startswith("#"):
            continue
        url, domain, inside = _target(base or "", href)
        out.append({"url": url, "domain": domain, "anchor": n.text(), "nofollow": "nofollow" in (n.attrs.get("rel") or ""), "inside": inside, "placement": placement(n)})
    return out


def sections(html: str | None) -> list[dict]:
    """Whole text between second-level headings among their siblings; one body section without such headings."""
    root = parse(html)
    out = []
    for head in root.find("h2"):
        if any(a.tag in BOILERPLATE for a in head.ancestors()):
            continue
        siblings = head.parent.children
        parts = []
        for n in siblings[siblings.index(head) + 1 :]:
            if isinstance(n, Node):
                if n.tag == "h2":
                    break
                if n.tag in ("h3", "p", "ul", "ol", "div") and (t := n.text(BOILERPLATE)):
                    parts.append(t)
        content = " ".join(parts)
        if (title := head.text()) and content:
            out.append({"heading": title, "content": content, "words": len(content.split())})
    if not out and (body := root.text(BOILERPLATE)):
        out.append({"heading": "Main Content", "content": body, "words": len(body.split())})
    return out


def schema_types(html: str | None) -> list[str]:
    """Every @type in the page's JSON-LD, at any depth; blocks that aren't JSON are left out."""
    found = []

    def collect(x):
        if isinstance(x, dict):
            kind = x.get("@type")
            found.extend(kind if isinstance(kind, list) else [kind] if kind else [])
            for v in x.values():
                collect(v)
        elif isinstance(x, list):
            for v in x:
                collect(v)

    for n in parse(html).find("script"):
        if (n.attrs.get("type") or "").lower() == "application/ld+json":
            try:
                collect(json.loads("".join(c for c in n.children if isinstance(c, str))))
            except ValueError:
                continue
    return sorted({str(t) for t in found})


def schema_summary(html: str | None) -> tuple[list[str], int, int]:
    """Types of the page's markup and how complete its business and organisation blocks are."""
    fields = {"LocalBusiness": (("name", "address", "telephone"), ("url", "image", "priceRange", "openingHours", "geo")), "Organization": (("name", "url"), ("logo", "contactPoint", "sameAs", "address"))}
    best = dict.fromkeys(fields, 0)

    def look(x):
        if isinstance(x, dict):
            kind = x.get("@type") or ""
            kind = kind[0] if isinstance(kind, list) and kind else kind
            for name, (required, optional) in fields.items():
                if name in str(kind):
                    best[name] = max(best[name], int(70 * sum(f in x for f in required) / len(required) + 30 * sum(f in x for f in optional) / len(optional)))
        for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            look(v)

    for n in parse(html).find("script"):
        if (n.attrs.get("type") or "").lower() == "application/ld+json":
            try:
                look(json.loads("".join(c for c in n.children if isinstance(c, str))))
            except ValueError:
                continue
    return schema_types(html), best["LocalBusiness"], best["Organization"]


def site_content(html: str | None, base: str = "") -> dict:
    """Title, phones, mails, address, headings and main text of a page."""
    root = parse(html)
    text = root.text(BOILERPLATE)
    phones = {re.sub(r"\D", "", n.attrs["href"][4:]) for n in root.find("a") if (n.attrs.get("href") or "").startswith("tel:")}
    phones |= {re.sub(r"\D", "", m) for m in re.findall(r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]\d{4}", text)}
    mails = {n.attrs["href"][7:].split("?")[0].lower() for n in root.find("a") if (n.attrs.get("href") or "").lower().startswith("mailto:")}
    mails |= {m.lower() for m in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", text)}
    own = urlparse(base or "").netloc.lower().removeprefix("www.")
    mails = sorted((m for m in mails if not m.endswith((".png", ".jpg", ".gif", ".webp"))), key=lambda m: (not (own and m.endswith(own)), m))
    title = next((n.text() for n in root.find("title")), "")
    return {"title": title, "phones": sorted(p for p in phones if len(p) >= 10), "mails": mails, "headings": [n.text() for n in root.find("h1", "h2", "h3", "h4")], "main_text": text}


def _result(href: str) -> tuple[str, str]:
    """Where a result leads, and the host of that."""
    if m := _SIMPLE.fullmatch(href):
        return href, m[1].removeprefix("www.")
    if m := _SIMPLE_REDIRECT.fullmatch(href):
        return m[1], m[2].removeprefix("www.")
    if href.startswith("/url?"):
        href = parse_qs(urlparse(href).query).get("q", [""])[0]
    return href, urlparse(href).netloc.lower().removeprefix("www.") if href.startswith("http") else ""


def search_results(html: str | None) -> list[dict]:
    """Ranked results of a stored page of results: anchors with a heading or text; redirects of the form /url?q= are unwrapped."""
    out = []
    for n in parse(html).find("a"):
        if title := n.text():
            href, domain = _result(n.attrs.get("href") or "")
            if href.startswith("http"):
                out.append({"position": len(out) + 1, "title": title, "url": href, "domain": domain})
    return out


def listing_cards(html: str | None) -> list[dict]:
    """Cards of a directory's page: elements whose class names a result, with name, phone and tags by the first element that has them."""
    out = []
    for card in parse(html).walk():
        if not card.names() & {"result", "srp-listing", "organic"}:
            continue
        pick = lambda *words: next((n.text() for n in card.walk() if n.names() & set(words) and n.text()), None)
        if name := pick("business-name", "n"):
            out.append({"name": name, "phone": pick("phone", "phones"), "address": pick("adr", "street-address"), "tags": [n.text() for n in card.walk() if n.tag == "a" and n.parent is not None and "categories" in n.parent.names()]})
    return out


def reviews(html: str | None) -> list[dict]:
    """Reviews marked up as such: rating, author and text."""
    out = []
    for n in parse(html).walk():
        if n.names() & {"review", "review-item"} or n.attrs.get("itemprop") == "review":
            inner = {x.attrs.get("itemprop"): x.attrs.get("content") or x.text() for x in n.walk() if x.attrs.get("itemprop")}
            rating = re.search(r"\d+(?:\.\d+)?", inner.get("ratingValue") or "")
            out.append({"rating": float(rating[0]) if rating else None, "author": inner.get("author"), "text": inner.get("reviewBody") or n.text()})
    return out


_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "strings": pa.list_(pa.string())}


def _of_pages(function, schema: str):
    """An Arrow function from pages to lists of records, which go into columns page by page."""
    inner = schema.removeprefix("array<struct<").removesuffix(">>").replace("array<string>", "strings")
    names, kinds = zip(*(f.split(":") for f in inner.split(",")), strict=True)

    @arrow(schema)
    def run(html: pa.Array, url: pa.Array) -> pa.Array:
        ends, columns, done = [0], [[] for _ in names], [[] for _ in names]

        def put():
            for column, parts, kind in zip(columns, done, kinds, strict=True):
                parts.append(pa.array(column, _KINDS[kind]))
                column.clear()

        for h, u in zip(html, url, strict=True):
            found = function(h.as_py(), u.as_py())
            ends.append(ends[-1] + len(found))
            for column, name in zip(columns, names, strict=True):
                column.extend([r[name] for r in found])
            if len(columns[0]) >= 4096:
                put()
        put()
        held = pa.StructArray.from_arrays([pa.concat_arrays(parts) for parts in done], list(names))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)

    return run


links_udf = _of_pages(links, "array<struct<url:string,domain:string,anchor:string,nofollow:boolean,inside:boolean,placement:string>>")
sections_udf = _of_pages(lambda h, u: sections(h), "array<struct<heading:string,content:string,words:int>>")
results_udf = _of_pages(lambda h, u: search_results(h), "array<struct<position:int,title:string,url:string,domain:string>>")
cards_udf = _of_pages(lambda h, u: listing_cards(h), "array<struct<name:string,phone:string,address:string,tags:array<string>>>")
reviews_udf = _of_pages(lambda h, u: reviews(h), "array<struct<rating:double,author:string,text:string>>")


@vectorized("array<string>")
def types_udf(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([schema_types(h) for h in html])


@vectorized("struct<title:string,phones:array<string>,mails:array<string>,headings:array<string>,main_text:string>")
def content_udf(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([site_content(h, u) for h, u in zip(html, url, strict=True)], columns=["title", "phones", "mails", "headings", "main_text"])


@vectorized("struct<types:array<string>,business:int,organization:int>")
def summary_udf(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([schema_summary(h) for h in html], columns=["types", "business", "organization"])
