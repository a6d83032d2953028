"""Main text of web pages as blocks, with a tolerant tree builder on the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Block tags, and the tags and selectors of PageRules.
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass(frozen=True)
class PageRules:
    """Selectors are tag, #id, .class, [attribute='value'], or tag#id."""

    drop_tags: tuple[str, ...] = ("script", "style", "noscript", "header", "footer", "nav", "aside", "form")
    drop: tuple[str, ...] = ("button", "input", "select", "textarea", "img", "svg", "[role='navigation']", "[role='search']", "#header", "#footer", ".breadcrumb")
    main: tuple[str, ...] = ("main#contents", "article", "main", "#contents", ".contents", ".article")
    back_links: tuple[str, ...] = ()
    back_titles: tuple[str, ...] = ("Return",)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # of Node and str

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]


class Builder(HTMLParser):
    """Nests what isn't closed; an end tag closes up to its nearest start tag, one without is ignored. Comments are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def matches(node: Node, selector: str) -> bool:
    m = re.fullmatch(r"(?P<tag>[\w-]+)?(?:#(?P<id>[\w-]+))?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<key>[\w-]+)='(?P<value>[^']*)'\])?", selector)
    return bool(m and node.tag) and (not m["tag"] or node.tag == m["tag"]) and (not m["id"] or node.attrs.get("id") == m["id"]) and (not m["cls"] or m["cls"] in node.attrs.get("class", "").split()) and (not m["key"] or node.attrs.get(m["key"]) == m["value"])


def text_of(node: Node, own: bool = False, between: str = "") -> str:
    """All text below, its strings joined by between; own: without that of nested blocks. A br is a line end."""
    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif not (own and x.tag in BLOCKS):
            stack += reversed(x.children)
    return between.join(out)


def tidy(text: str) -> str:
    lines = (re.sub(r"[ \t\f\v]+", " ", x).strip() for x in re.sub(r"\r\n?", "\n", text).split("\n"))
    return "\n".join(x for x in lines if x)


def prune(node: Node, rules: PageRules) -> None:
    def goes(x: Node) -> bool:
        if x.tag in rules.drop_tags or any(matches(x, s) for s in rules.drop):
            return True
        return x.tag == "a" and (text_of(x).strip() in rules.back_links or x.attrs.get("title", "").startswith(rules.back_titles))

    for n in list(node.walk()):
        n.children = [c for c in n.children if isinstance(c, str) or not goes(c)]


def blocks(html: str, rules: PageRules) -> list[str]:
    """Texts of the main part's blocks in document order; ValueError if there are none."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    prune(builder.root, rules)
    main = None
    for selector in rules.main:
        first = next((n for n in builder.root.walk() if matches(n, selector)), None)
        if first and text_of(first).strip():
            main = first
            break
    if main is None:
        raise ValueError("the page has no main part")
    found = []
    for n in main.walk():
        if n.tag in BLOCKS:
            text = tidy(text_of(n, between="\n") if n.tag == "h1" else text_of(n, own=True))
            if text:
                found.append(text)
    if not found:
        raise ValueError("no text blocks found")
    return found


def page_blocks(pages: DataFrame, key: str = "page_id", rules: PageRules | None = None) -> DataFrame:
    """key, blocks, error: a page that fails has an error and null blocks, the others go on."""
    rules = rules or PageRules()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found, errors = [], []
            for h in f["html"]:
                try:
                    found.append(blocks(h or "", rules))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a page must not stop the others
                    found.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({key: f[key], "blocks": found, "error": errors})

    return pages.select(key, "html").mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, blocks array<string>, error string")


def block_stats(found: DataFrame, key: str = "page_id") -> DataFrame:
    text = F.array_join("blocks", "\n\n")
    return found.select(key, F.coalesce(F.size("blocks"), F.lit(0)).alias("paragraphs"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.col("error").isNull().alias("ok"))
