"""Synthetic pages with known main text, for fitting the extractor. Everything follows from the seed."""

from __future__ import annotations

import random

#: Name tokens that page authors commonly give to parts of a page, by the part's role.
ROLE_NAMES = {
    "nav": ("nav", "menu", "navigation", "navbar", "topnav", "breadcrumb", "pagination", "tabs", "skip", "toc"),
    "header": ("header", "masthead", "banner", "top", "logo", "branding", "site-header"),
    "footer": ("footer", "bottom", "copyright", "colophon", "legal", "site-footer"),
    "side": ("sidebar", "aside", "widget", "rail", "related", "recommended", "trending", "popular", "archive", "tags"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adbox", "promotion"),
    "notice": ("cookie", "consent", "notice", "gdpr", "popup", "modal", "alert", "overlay", "newsletter", "subscribe", "paywall"),
    "comments": ("comments", "comment", "replies", "discussion", "disqus", "responses", "reader-comments"),
    "share": ("share", "social", "sharing", "follow", "meta", "byline-share", "tools"),
    "form": ("form", "search", "login", "signup", "contact-form", "subscribe-form"),
    "main": ("content", "main", "article", "post", "entry", "story", "body", "text", "post-content", "article-body", "entry-content", "page-content"),
    "wrap": ("wrapper", "container", "page", "site", "layout", "row", "col", "inner", "grid", "app"),
}
ROLE_TAGS = {
    "nav": ("nav", "div", "ul", "div"), "header": ("header", "div", "header"), "footer": ("footer", "div", "footer"),
    "side": ("aside", "div", "section"), "ad": ("div", "aside", "ins", "section"), "notice": ("div", "section", "aside", "dialog"),
    "comments": ("div", "section", "ol", "ul"), "share": ("div", "ul"), "form": ("form", "div"),
}
#: Marks loose text that is main text; it has no width and stands in no real page's statistics.
KEPT = "\u2060"
SYLLABLES = "an be ca do el fi go ha in ju ke lo mi no or pa qu re si ta un ve wo xi ya zu é ö ñ ß the and ing tion".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = self.r.random() < 0.3  # a page whose parts mostly carry no names
        self.foreign = self.r.random() < 0.05  # a page whose names nobody knows
        self.known: dict[str, str] = {}

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, least: int, most: int) -> str:
        words = [self.word() for _ in range(self.r.randint(least, most))]
        style = self.r.random()
        if style < 0.06:
            return " ".join(w.upper() + "!!" for w in words)
        if style < 0.12:
            return " ".join(w + self.r.choice(("***", "&amp;&amp;", "%%%", "###")) for w in words)
        return " ".join(words).capitalize() + self.r.choice((".", ".", ".", "?", "!", ""))

    def names(self, role: str, sure: bool = False) -> str:
        if not sure and (self.plain and self.r.random() < 0.7 or self.r.random() < 0.2):
            return ""
        picked = self.r.choice(ROLE_NAMES[role])
        if self.foreign:
            picked = self.known.setdefault(role, "x" + self.word())
        if self.r.random() < 0.3:
            picked += self.r.choice(("-", "_", " ")) + self.r.choice(("1", "box", "block", "area", "wrap", "list"))
        return f' {self.r.choice(("class", "class", "id"))}="{picked}"'

    def paragraphs(self, n: int, keep: bool, long: bool = True) -> list:
        """Pieces (html, keep)."""
        out = []
        for _ in range(n):
            text = " ".join(self.sentence(3, 22) for _ in range(self.r.randint(1, 9 if long else 2)))
            kind = self.r.random()
            if kind < 0.06:
                items = "".join(f"<li>{self.sentence(2, 12)}" + self.r.choice(("", "</li>")) for _ in range(self.r.randint(2, 6)))
                tag = self.r.choice(("ul", "ol"))
                out.append(("open", tag, "", keep))
                out.append(("raw", items, keep))
                out.append(("close", tag))
                continue
            if kind < 0.09:
                out += [("open", "blockquote", "", keep), ("raw", f"<p>{text}</p>", keep), ("close", "blockquote")]
                continue
            if kind < 0.12:
                rows = "".join("<tr>" + "".join(f"<td>{self.sentence(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5)))
                out += [("open", "table", "", keep), ("raw", rows, keep), ("close", "table")]
                continue
            if kind < 0.2:
                text = f"<b>{text}<br>" if self.r.random() < 0.5 else text.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
            tag = "p" if self.r.random() < 0.9 else "div"
            out += [("open", tag, "", keep), ("raw", text, keep), ("close", tag) if self.r.random() < 0.9 or tag == "div" else ("leave", tag)]
        return out

    def part(self, role: str, sure: bool = False) -> list:
        """A part that is no main text; ``sure``: its name says so, as it stands among main text."""
        tag = self.r.choice(ROLE_TAGS[role])
        sure = sure or role == "comments"  # nothing but its name tells a comment from the article
        out = [("open", tag, self.names(role, sure), False)]
        if role == "footer" and self.r.random() < 0.05:  # a line of loose text that is none of the article
            return [("raw", f"<hr>&copy; {self.word()}.example &middot; {self.sentence(3, 9)}", False)]
        links = lambda n: "".join(
            f'<li><a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 3)))}</a></li>' for _ in range(n)
        )
        if role in ("nav", "share"):
            items = links(self.r.randint(3, 12))
            out += [("raw", items, False)] if tag == "ul" else [("open", "ul", "", False), ("raw", items, False), ("close", "ul")]
        elif role == "comments":
            for _ in range(self.r.randint(1, 6)):
                inner = self.r.choice(("div", "li", "article"))
                out += [("open", inner, self.names("comments", inner == "article"), False), *self.paragraphs(self.r.randint(1, 3), False), ("close", inner)]
        elif role == "form":
            out.append(("raw", f"<label>{self.sentence(1, 4)}</label><input name=q><button>{self.word()}</button>", False))
        elif role == "side":
            if self.r.random() < 0.5:
                out.append(("raw", f"<h3>{self.sentence(1, 4)}</h3>", False))
            out += [("open", "ul", "", False), ("raw", links(self.r.randint(3, 9)), False), ("close", "ul")] if self.r.random() < 0.6 else self.paragraphs(self.r.randint(1, 2), False, False)
        elif role == "footer":
            out.append(("raw", f"&copy; {self.word()}.example &middot; {self.sentence(3, 14)}", False))
            if self.r.random() < 0.4:
                out += [("open", "ul", "", False), ("raw", links(self.r.randint(2, 6)), False), ("close", "ul")]
        else:
            out.append(("raw", self.sentence(3, 18) if self.r.random() < 0.7 else f"<p>{self.sentence(3, 18)}</p>", False))
        return [*out, ("close", tag)]

    def page(self) -> list:
        chance = lambda p: self.r.random() < p
        before = [r for r, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.75), ("ad", 0.4), ("form", 0.2)) if chance(p)]
        after = [r for r, p in (("side", 0.45), ("comments", 0.3), ("ad", 0.3), ("form", 0.15), ("notice", 0.15), ("footer", 0.8)) if chance(p)]
        main_tag = self.r.choice(("article", "article", "main", "div", "div", "section"))
        body = [("open", main_tag, "" if main_tag == "article" and chance(0.5) else self.names("main"), True)]
        short = chance(0.25)
        title = self.sentence(1, 5) if short else self.sentence(2, 12)
        if chance(0.85):
            body.append(("raw", f"<h1>{title}</h1>", True))
        for _ in range(self.r.choice((1, 1, 1, 2, 3))):
            if chance(0.25):
                body.append(("raw", f"<h2>{self.sentence(1, 8)}</h2>", True))
            if short:
                text = " ".join(self.sentence(1, 6) for _ in range(self.r.choice((1, 1, 2, 3))))
                body += [("open", "p", "", True), ("raw", text, True), ("close", "p")]
                continue
            body += self.paragraphs(self.r.randint(1, 9), True)
            if chance(0.15):
                body += self.part(self.r.choice(("ad", "share", "side", "notice")), sure=True)
        if chance(0.12):
            body += self.part("comments", sure=True)
        body.append(("close", main_tag))
        if chance(0.15):
            return [*(x for r in before for x in self.part(r)), *self.bare(body[1:-1]), *(x for r in after for x in self.part(r))]
        for _ in range(self.r.choice((0, 0, 1, 2))):
            body = [("open", "div", self.names("wrap"), True), *body, ("close", "div")]
        middle = body
        if chance(0.3):
            side = self.part("side")
            middle = [("open", "div", self.names("wrap"), True), *(side + body if chance(0.5) else body + side), ("close", "div")]
        return [*(x for r in before for x in self.part(r)), *middle, *(x for r in after for x in self.part(r))]


    def bare(self, body: list) -> list:
        """Main text that stands in the body itself, with loose text between its blocks."""
        loose = lambda: ("raw", KEPT + " ".join(self.sentence(3, 20) for _ in range(self.r.randint(1, 5))), True)
        out = [loose()] if self.r.random() < 0.6 else []
        depth = 0
        for piece in body:
            out.append(piece)
            depth += {"open": 1, "close": -1}.get(piece[0], 0)
            if depth == 0 and piece[0] == "close" and self.r.random() < 0.5:
                out.append(loose())
        return out


def render(pieces: list, mark: bool = True) -> str:
    """HTML of the pieces; ``mark`` writes ``data-keep`` on every element so that labels survive parsing."""
    out = ["<!DOCTYPE html><html><body>"]
    for piece in pieces:
        if piece[0] == "open":
            out.append(f"<{piece[1]}{piece[2]}{f' data-keep={int(piece[3])}' if mark else ''}>")
        elif piece[0] == "close":
            out.append(f"</{piece[1]}>")
        elif piece[0] == "raw":
            out.append(piece[1])
    out.append("</body></html>")
    return "".join(out)


def pages(count: int, seed: int = 5):
    """``count`` pages as (pieces, html)."""
    for i in range(count):
        pieces = Maker(seed * 100_003 + i).page()
        yield pieces, render(pieces)
