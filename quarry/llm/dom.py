"""A small HTML tree: tags are found with one pattern, end tags that HTML lets authors omit are implied.

Not a full tree builder: formatting elements are not reopened across blocks, and foreign content is not special.
"""

from __future__ import annotations

import html
import re

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
UNREAD = frozenset("script style noscript template head title select button option textarea datalist iframe object svg canvas math audio video map".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br ruby rt rp nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start tag on the left ends an open element on the right, unless one of the third stands between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Any other start tag, or text, ends an open head.
HEAD_CONTENT = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
P_SCOPE = frozenset("article aside blockquote body button caption div fieldset figure footer form header html li main nav section table td th dd".split())


#: Tag of the nodes that hold loose text: what stands in the body itself, between its blocks.
LOOSE = "#text"


class Node:
    """What is judged: a block, an inline element with a class, id or role, or a run of loose text in the body."""

    __slots__ = ("tag", "names", "parent", "depth", "children", "texts", "links", "order")

    def __init__(self, tag: str, names: frozenset, parent: Node | None, order: int):
        self.tag, self.names, self.parent, self.order = tag, names, parent, order
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.texts: list[tuple[int, str, bool]] = []  # (place in the page, text, inside a link)
        self.links = 0


def name_tokens(attributes: str) -> frozenset:
    """Lower-case tokens of the class, id and role attributes."""
    out: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label"):
            out.update(t.lower() for t in TOKEN.findall(m[2] or m[3] or m[4] or ""))
    return frozenset(out)


def parse(page: str) -> list[Node]:
    """All nodes in page order; the first is the root."""
    root = Node("html", frozenset(), None, 0)
    nodes, stack = [root], [("html", root)]
    links = skip = place = at = 0
    run: Node | None = None  # the run of loose text that is open
    last_ends: dict[str, int] = {}
    loose: list[tuple[int, int]] = []  # (place in the stack, skip) of unread elements that nothing closes

    def closed(tag: str) -> bool:
        """Whether an end tag follows; of buttons and selects, which do not nest, before the next one starts."""
        if tag in ("button", "select"):
            follows = re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).search(page, at)
            return bool(follows and follows[1])
        if tag not in last_ends:
            last_ends[tag] = max((x.start() for x in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", page, re.I)), default=-1)
        return last_ends[tag] >= at

    def text(piece: str) -> None:
        nonlocal place, run
        if piece and not skip:
            node = stack[-1][1]
            if node is root and not piece.isspace():
                if run is None:
                    run = Node(LOOSE, frozenset(), root, place)
                    root.children.append(run)
                    nodes.append(run)
                node = run
            node.texts.append((place, piece, links > 0))
            place += 1

    def gap(ends_run: bool = True) -> None:
        nonlocal run
        if ends_run:
            run = None
        text(" ")

    def close_to(index: int) -> None:
        nonlocal links, skip
        while len(stack) > index:
            tag, _ = stack.pop()
            if tag == "a":
                links -= 1
            elif tag in UNREAD:
                skip -= 1
        while loose and loose[-1][0] >= index:
            loose.pop()

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        between = page[at : m.start()]
        if stack[-1][0] == "head" and between.strip():
            close_to(len(stack) - 1)
        text(between)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, end, attributes = tag.lower(), m[1] if m[2] else m[4], m[3] if m[2] else m[6]
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close_to(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            if tag not in INLINE:
                gap()
            continue
        if stack[-1][0] == "head" and tag not in HEAD_CONTENT:
            close_to(len(stack) - 1)
        if loose and loose[-1][1] == skip and (tag in CLOSES_P or tag in ("button", "select", "object")):
            close_to(loose[-1][0])
        if tag in VOID:
            if tag in ("br", "hr"):
                gap(tag == "hr")
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close_to(i)
                    break
                if stack[i][0] in P_SCOPE:
                    break
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            cut = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stops:
                    break
                if stack[i][0] in ends:
                    cut = i
            if cut is not None:
                close_to(cut)
        parent = stack[-1][1]
        if tag not in INLINE:
            gap()
        names = name_tokens(attributes) if "=" in attributes else frozenset()
        if tag in ("html", "body") and not stack[1:]:
            root.names |= names
            continue
        if tag in UNREAD:
            skip += 1
            if tag in RAW:  # text up to its end tag, whatever it holds
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                skip -= 1
                continue
            if tag != "head" and not closed(tag):
                loose.append((len(stack), skip))
            stack.append((tag, parent))
            continue
        if tag == "a":
            links += 1
            parent.links += 1
        if tag not in INLINE or names:
            node = Node(tag, names, parent, place)
            parent.children.append(node)
            nodes.append(node)
            parent = node
        stack.append((tag, parent))
    if stack[-1][0] == "head":
        close_to(len(stack) - 1)
    text(page[at:])
    return nodes


def clean(pieces: list[str]) -> str:
    """Character references decoded, white space runs to one space, trimmed."""
    return " ".join(html.unescape("".join(pieces)).split())
