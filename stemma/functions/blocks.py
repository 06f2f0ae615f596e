"""A page read as a row of events: its headings, rules and paragraphs in order, without a tree."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

from stemma.functions.markup import VOID

#: Elements that hold paragraphs, headings below a page's own, and marks that stay in a paragraph (fixed values).
CONTAINERS = frozenset(("body", "div", "center", "table", "tbody", "tr", "td", "font", "span", "ul", "ol", "li"))
HEADINGS = ("h2", "h3", "h4", "h5", "h6")
KEPT = frozenset(("em", "i", "strong", "b", "sup", "br"))
NOTES = frozenset(("fn", "ref", "stiki"))


@dataclass
class Block:
    kind: str
    scopes: frozenset[str] = frozenset()
    quote: Block | None = None
    is_container: bool = False
    parts: list[str | None] = field(default_factory=list)

    def shown(self, scope: str) -> bool:
        """Whether it counts in a scope: quotes that hold headings are containers, what other quotes hold is theirs."""
        return scope in self.scopes and not self.is_container and (self.quote is None or self.quote.is_container and (self.quote.quote is None or self.quote.quote.is_container))

    def text(self) -> str:
        if self.kind != "text":
            return "".join(p.strip() for p in self.parts if p)
        runs: list[list[str]] = [[]]
        for p in self.parts:
            runs.append([]) if p is None else runs[-1].append(p)
        return " ".join(t for t in ("".join(r).strip() for r in runs) if t)


@dataclass
class Open:
    tag: str
    scopes: frozenset[str] = frozenset()
    pub: bool = False
    quiet: bool = False
    sinks: tuple[Block, ...] = ()
    quote: Block | None = None


class BlockReader(HTMLParser):
    """The blocks of a page. A block is in scope "body" if only containers are between it and the body, and in scope "h1" if
    only containers are between it and what follows the first h1 beside it. Nothing under the class pub is read."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack, self.count = [Open("")], Counter()
        self.blocks: list[Block] = []
        self.h1: Block | None = None
        self.title: Block | None = None
        self.has_body = False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        up, classes = self.stack[-1], set((dict(attrs).get("class") or "").split())
        if tag in KEPT:
            for b in up.sinks:
                b.parts.append(None)
        new = Open(tag, pub=up.pub or "pub" in classes, quiet=up.quiet or tag in ("script", "style") or tag in ("sup", "span") and bool(classes & NOTES), sinks=up.sinks, quote=up.quote)
        if tag == "body":
            self.has_body = True
        if tag in CONTAINERS:
            new.scopes = up.scopes | ({"body"} if tag == "body" else set())
        if tag in ("h1", "title") and getattr(self, tag) is None:
            setattr(self, tag, Block(tag))
            new.sinks += (getattr(self, tag),)
        elif up.scopes and not up.pub and (tag in HEADINGS or tag in ("p", "hr", "blockquote")):
            block = Block("heading" if tag in HEADINGS else "rule" if tag == "hr" else "text", up.scopes, up.quote)
            self.blocks.append(block)
            new.sinks += (block,)
            if tag == "blockquote":
                new.scopes, new.quote = up.scopes, block
            elif tag in HEADINGS and up.tag == "blockquote":
                up.quote.is_container = True
        if tag not in VOID:
            self.stack.append(new)
            self.count[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return
        if tag in KEPT:
            for b in self.stack[-1].sinks:
                b.parts.append(None)
        while True:
            top = self.stack.pop()
            self.count[top.tag] -= 1
            if self.h1 is not None and self.h1 in top.sinks and self.h1 not in self.stack[-1].sinks:
                self.stack[-1].scopes |= {"h1"}
            if top.tag == tag:
                return

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if not top.quiet:
            for b in top.sinks:
                b.parts.append(data)


def page_blocks(html: str | None) -> tuple[str | None, bool, list[tuple[str, str]]]:
    """(label, named, blocks) of a page: blocks (kind, text) after its first h1, which names it; or, without one (or with
    one that says page not found), those of its body, named by the title."""
    page = BlockReader(html or "")
    named = page.h1 is not None and "page not found" not in page.h1.text().lower()
    label = page.h1 if named else page.title
    blocks = [(b.kind, b.text()) for b in page.blocks if b.shown("h1" if named else "body")] if named or page.has_body else []
    return label.text() if label is not None else None, named, blocks
