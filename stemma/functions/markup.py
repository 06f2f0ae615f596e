"""A small tree of HTML for the row helpers that need nesting; broken markup is read as far as it goes."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

#: Elements whose text is no words of the page (fixed values).
HIDDEN = frozenset(("script", "style", "template"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag: str = "", attrs: dict | None = None, text: str | None = None):
        self.tag, self.attrs, self.text, self.kids, self.up = tag, attrs or {}, text, [], None

    def add(self, kid: Node) -> Node:
        kid.up = self
        self.kids.append(kid)
        return kid

    def walk(self) -> Iterator[Node]:
        todo = self.kids[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.kids[::-1]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def words(self, sep: str = "") -> str:
        parts = [n.text.strip() if sep else n.text for n in self.walk() if n.text is not None and n.up.tag not in HIDDEN]
        return sep.join(p for p in parts if p or not sep)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def drop(self) -> None:
        if self.up:
            self.up.kids = [k for k in self.up.kids if k is not self]
            self.up = None

    def unwrap(self) -> None:
        if self.up:
            at = next(i for i, k in enumerate(self.up.kids) if k is self)
            for k in self.kids:
                k.up = self.up
            self.up.kids[at : at + 1] = self.kids
            self.up = None

    def inner(self) -> str:
        return "".join(k.outer() for k in self.kids)

    def outer(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.text is not None:
                out.append(html.escape(node.text, quote=False))
            else:
                attrs = "".join(f' {k}="{html.escape(v or "")}"' for k, v in node.attrs.items())
                out.append(f"<{node.tag}{attrs}/>" if node.tag in VOID else f"<{node.tag}{attrs}>")
                todo += [] if node.tag in VOID else [f"</{node.tag}>", *node.kids[::-1]]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        node = self.at.add(Node(tag, dict(attrs)))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.add(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.up
        if node is not self.root:
            self.at = node.up

    def handle_data(self, data):
        self.at.add(Node(text=data))


def tree(text: str | None) -> Node:
    b = _Builder()
    b.feed(text or "")
    b.close()
    return b.root


def guarded(f: Callable) -> Callable:
    """A row helper that gives None for a row it cannot read, so that one broken row never fails a task."""

    def run(x):
        try:
            return f(x)
        except (ValueError, AttributeError, AssertionError, IndexError):
            return None

    return run
