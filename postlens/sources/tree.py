"""A small element tree over the standard tag parser, for work inside tasks."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style"}


class Element:
    __slots__ = ("tag", "classes", "children")

    def __init__(self, tag: str, classes: frozenset[str] = frozenset()):
        self.tag, self.classes, self.children = tag, classes, []

    def elements(self):
        """Descendant elements in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def strings(self, skip: set[str] = frozenset()):
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in skip:
                stack.extend(reversed(node.children))

    def matches(self, tag: str | None, cls: str | None) -> bool:
        return (tag is None or self.tag == tag) and (cls is None or cls in self.classes)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Element(tag, frozenset((dict(attrs).get("class") or "").split()))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse_html(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def visible_lines(root: Element) -> str:
    """Stripped pieces of all lines outside script and style, joined by a blank."""
    text = "".join(root.strings(UNSEEN))
    pieces = (piece.strip() for line in text.splitlines() for piece in line.split("  "))
    return " ".join(piece for piece in pieces if piece)
