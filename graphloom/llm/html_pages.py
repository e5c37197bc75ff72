"""Pages with known labels to train the extractor on, generated from a seed.

Each page mixes a main text in one of several kinds of container with boilerplate of many kinds; class names are drawn
from pools, often generic, misleading or missing, so that the trees learn from text and structure as well.
"""

from __future__ import annotations

import random

BOILER, CONTENT, MIXED = 0, 1, 2
#: Container tokens.
MAIN_NAMES = ("content", "article", "post", "entry", "story", "main", "body-text", "article-body", "post-content", "text")
PLAIN_NAMES = ("wrap", "container", "row", "col", "page", "inner", "box", "block", "c1", "layout", "")
AD_NAMES = ("ad", "ads", "advert", "banner-ad", "sponsored", "promo", "ad-slot", "adbox")
SIDE_NAMES = ("sidebar", "side", "widget", "rail", "related", "aside", "trending")
NOTICE_NAMES = ("cookie", "consent", "notice", "gdpr", "popup", "alert", "cookie-banner", "newsletter", "subscribe", "modal")
COMMENT_NAMES = ("comments", "comment-list", "discussion", "respond", "replies", "comment", "reader-comments")
MENU_NAMES = ("nav", "menu", "navbar", "breadcrumb", "topbar", "share", "social", "pagination", "tags")
HEAD_NAMES = ("header", "masthead", "site-header", "top", "banner", "branding")
FOOT_NAMES = ("footer", "site-footer", "bottom", "copyright", "legal")


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.named = False

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        r = self.r
        style = r.random()
        out = []
        for _ in range(r.randint(low, high)):
            s = self.words(1, 14).capitalize()
            if style < 0.1:
                s = s.upper().replace(" ", "!! ")
            elif style < 0.2:
                s = s.replace(" ", r.choice(("### ", "$$$ ", "*** ", "&amp;&amp;&amp; ", " | ")))
            elif r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            if r.random() < 0.08:
                s = s.replace(" ", ' <a href="/x">', 1) + "</a>"
            out.append(s + ".")
        return " ".join(out)

    def node(self, tag: str, inner: str, label: int, names=(), close: bool = True) -> str:
        r = self.r
        name = r.choice(names) if names and (self.named or r.random() < 0.85) else r.choice(PLAIN_NAMES) if r.random() < 0.3 else ""
        attr = f' {r.choice(("class", "id"))}="{name}{r.choice(("", "", " x" + str(r.randint(1, 99))))}"' if name else ""
        return f'<{tag} data-label="{label}"{attr}>{inner}' + (f"</{tag}>" if close else "")

    def bare(self, text: str, label: int) -> str:
        """Text beside blocks; the mark around it is read in training only."""
        return f'<data data-label="{label}">{text}</data>'

    def caption(self, label: int) -> str:
        """Elements that hold a short text of their own."""
        r = self.r
        kind = r.random()
        if kind < 0.35:
            return self.node("figure", '<img src="x">' + self.node("figcaption", self.words(1, 12), label), label)
        if kind < 0.7:
            return self.node("details", self.node("summary", self.words(1, 7), label) + (self.paragraphs(label, 1, 2) if r.random() < 0.7 else self.bare(self.sentences(1, 2), label)), label)
        if kind < 0.85:
            return self.node("dl", "".join(self.node("dt", self.words(1, 3), label) + self.node("dd", self.sentences(1, 2), label) for _ in range(r.randint(1, 3))), label)
        return self.node("blockquote", self.bare(self.sentences(1, 2), label) + self.node("p", self.words(2, 9), label), label)

    def points(self, label: int, depth: int = 0) -> str:
        """A list of short texts, some with a list inside them."""
        r = self.r
        items = []
        for _ in range(r.randint(2, 5) if not depth else r.randint(1, 3)):
            text = self.words(2, 12) if r.random() < 0.7 else self.sentences(1, 2)
            if depth < 2 and r.random() < 0.2:
                text = self.bare(text, label) + self.points(label, depth + 1) + (self.bare(self.words(2, 9), label) if r.random() < 0.4 else "")
            items.append(self.node("li", text, label))
        return self.node(r.choice(("ul", "ol")), "".join(items), label)

    def links(self, label: int, low: int = 2, high: int = 9) -> str:
        item = lambda: self.node("li", f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 4)}</a>', label)
        return self.node("ul", "".join(item() for _ in range(self.r.randint(low, high))), label)

    def paragraphs(self, label: int, low: int, high: int) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(low, high)):
            open_b = r.random() < 0.15
            text = self.sentences(1, r.choice((1, 1, 3, 6)))
            out.append(self.node("p", ("<b>" + text + "<br>") if open_b else text, label, close=r.random() < 0.85))
        return "".join(out)

    def boiler(self) -> str:
        r, b = self.r, BOILER
        kind = r.randrange(11)
        if kind == 0:
            return self.node(r.choice(("nav", "div", "nav")), self.links(b), b, MENU_NAMES)
        if kind == 1:
            return self.node(r.choice(("div", "div", "aside", "section")), self.sentences(1, 3) if r.random() < 0.7 else self.node("p", self.sentences(1, 2), b), b, AD_NAMES)
        if kind == 2:
            inner = self.node("h3", self.words(1, 3), b) + r.choice((self.links(b), self.paragraphs(b, 1, 3)))
            return self.node(r.choice(("aside", "aside", "div", "section")), inner, b, SIDE_NAMES)
        if kind == 3:
            inner = self.sentences(1, 3) if r.random() < 0.6 else self.node("p", self.words(1, 9), b)
            inner += " <button>ok</button>" if r.random() < 0.5 else self.node("form", r.choice((self.words(1, 3), self.node("p", self.words(1, 4), b))) + "<input>", b) if r.random() < 0.4 else ""
            return self.node(r.choice(("div", "section", "div")), inner, b, NOTICE_NAMES)
        if kind == 4:
            fields = f"<label>{self.words(1, 2)}</label><input name=q>" * r.randint(1, 3) + "<button>go</button>"
            return self.node("form", (self.node("p", self.sentences(1, 1), b) if r.random() < 0.5 else "") + fields, b, ("search", "login", "signup"))
        if kind in (5, 6):
            one = lambda: self.node(r.choice(("div", "li", "article", "p")), (self.node("span", self.words(1, 2), b) if r.random() < 0.5 else "") + (self.paragraphs(b, 1, 2) if r.random() < 0.6 else self.sentences(1, 4)), b, COMMENT_NAMES)
            head = self.node("h3", r.choice(("Comments", "Kommentare", self.words(1, 2))), b) if r.random() < 0.6 else ""
            return self.node(r.choice(("section", "div", "ol")), head + "".join(one() for _ in range(r.randint(1, 5))), b, COMMENT_NAMES)
        if kind == 7:
            return self.node(r.choice(("header", "div")), self.node("h2", self.words(1, 3), b) + (self.links(b, 2, 5) if r.random() < 0.5 else ""), b, HEAD_NAMES)
        if kind == 8:
            inner = f"&copy; {self.words(1, 4)}" + r.choice(("", self.links(b, 2, 5), self.node("p", self.sentences(1, 2), b)))
            return self.node(r.choice(("footer", "footer", "div")), inner, b, FOOT_NAMES)
        if kind == 9:
            return self.node("div", self.links(b, 2, 5), b, ("related", "share", "tags", "read-more"))
        return self.node("div", f'<a href="/">{self.words(1, 2)}</a> &gt; <a href="/">{self.words(1, 2)}</a>', b, MENU_NAMES)

    def main(self) -> str:
        r, c = self.r, CONTENT
        parts = [self.node("h1", self.words(1, 9).capitalize(), c)] if r.random() < 0.8 else []
        if parts and r.random() < 0.15:
            parts = [self.node("header", parts[0], c)]
        for _ in range(r.choice((1, 1, 2, 3, 5))):
            kind = r.random()
            if kind < 0.72:
                parts.append(self.paragraphs(c, 1, r.choice((1, 2, 5, 9))))
            elif kind < 0.78:
                parts.append(self.node("h2", self.words(1, 6), c) + self.paragraphs(c, 1, 3))
            elif kind < 0.84:
                parts.append(self.points(c))
            elif kind < 0.88:
                parts.append(self.node("blockquote", self.paragraphs(c, 1, 2), c))
            elif kind < 0.91:
                row = lambda: "<tr data-label=1>" + "".join(f"<td data-label=1>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>"
                parts.append(self.node("table", "".join(row() for _ in range(r.randint(1, 4))), c))
            elif kind < 0.93:
                parts.append(self.node("pre", self.words(3, 20), c))
            elif kind < 0.97:
                parts.append(self.caption(c))
            else:
                parts.append(self.node("div", self.bare(self.sentences(1, 4), c) + self.paragraphs(c, 1, 2) + (self.bare(self.sentences(1, 3), c) if r.random() < 0.5 else ""), c))
            if r.random() < 0.2:
                self.named = True
                parts.append(self.boiler())
                self.named = False
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        body = self.main()
        kind = r.random()
        if kind < 0.45:
            body = self.node(r.choice(("article", "article", "main")), body, CONTENT, MAIN_NAMES if r.random() < 0.4 else ())
        elif kind < 0.85:
            body = self.node(r.choice(("div", "section", "div")), body, CONTENT, MAIN_NAMES)
        if r.random() < 0.06:
            body = ""
        elif r.random() < 0.08:  # text of the article beside its blocks
            body = self.bare(self.sentences(1, 6), CONTENT) + (body if r.random() < 0.6 else self.paragraphs(CONTENT, 1, 2)) + (self.bare(self.sentences(1, 3), CONTENT) if r.random() < 0.3 else "")
        if r.random() < 0.12:
            bare = r.choice((self.paragraphs(CONTENT, 1, 3), self.main(), self.node("div", self.sentences(1, 4), CONTENT)))
            return bare if r.random() < 0.4 else f"<html data-label=2><body data-label=2>{bare}</body></html>"
        before = "".join(self.boiler() for _ in range(r.choice((0, 1, 2, 2, 3))))
        if r.random() < 0.08:  # links and notes beside blocks
            before = self.bare(r.choice((f'<a href="#m">{self.words(1, 4)}</a>', f'<a href="/">{self.words(1, 2)}</a> | <a href="/x">{self.words(1, 2)}</a>', self.words(1, 3))), BOILER) + before
        after = "".join(self.boiler() for _ in range(r.choice((0, 1, 1, 2, 4))))
        if r.random() < 0.35:
            inside = r.random() < 0.7
            body = self.node(r.choice(("div", "main", "section")), (self.boiler() if inside and r.random() < 0.5 else "") + body + (self.boiler() if inside else ""), MIXED, PLAIN_NAMES)
        tail = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html data-label=2><head><title>{self.words(1, 6)}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body data-label=2>{before}{body}{after}{tail}"


def pages(count: int, seed: int = 11) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(count)]
