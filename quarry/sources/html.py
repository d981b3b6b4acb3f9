"""HTML trees with the standard library's parser: text of a page, and an allowlist sanitizer.

The parser is no full HTML5 tree builder: it closes what is left open and ignores stray end tags.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is set apart by spaces.
SPACED = frozenset("td th br li p div tr dt dd".split())
# Elements that carry no text.
TEXTLESS = frozenset("svg math img".split())
SCRIPTS = frozenset("script style".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table html body div section article".split())
_ENDS_P = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 blockquote pre section article nav header footer aside form figure hr".split())


@dataclass
class Element:
    tag: str
    attributes: list[tuple[str, str]] = field(default_factory=list)
    children: list = field(default_factory=list)  # Element or str


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.stack = [self.root]

    def _close(self, tags: set, stops: frozenset) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _STOPS)
        if tag in _ENDS_P:
            self._close({"p"}, _STOPS)
        e = Element(tag, [(k, v or "") for k, v in attrs])
        self.stack[-1].children.append(e)
        if tag not in VOID:
            self.stack.append(e)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Element(tag, [(k, v or "") for k, v in attrs]))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def text_of(node: Element | str) -> str:
    """Text of a tree; cells, lines and blocks are set apart by spaces; vector graphics, formulas and scripts have none."""
    if isinstance(node, str) and "<" in node:
        node = parse(node)
    return _text(node)


def _text(node: Element | str) -> str:
    if isinstance(node, str):
        return node
    if node.tag in TEXTLESS or node.tag in SCRIPTS:
        return ""
    inner = "".join(_text(c) for c in node.children)
    return f" {inner} " if node.tag in SPACED else inner


def find(node: Element, tag: str):
    for c in node.children:
        if isinstance(c, Element):
            if c.tag == tag:
                yield c
            yield from find(c, tag)


def render(node: Element | str) -> str:
    if isinstance(node, str):
        return escape(node, quote=False)
    inner = "".join(render(c) for c in node.children)
    if not node.tag:
        return inner
    attributes = "".join(f' {k}="{escape(v)}"' for k, v in node.attributes)
    return f"<{node.tag}{attributes}>" + ("" if node.tag in VOID else f"{inner}</{node.tag}>")
