"""Labelled pages that the content model is trained on: layouts drawn at random from a grammar."""

from __future__ import annotations

import random

#: Names that sites give to the parts of a page.
NAMES = {
    "nav": ("nav", "menu", "navbar", "main-menu", "breadcrumbs", "topnav", "navigation"),
    "header": ("header", "masthead", "site-header", "topbar", "banner"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "colophon"),
    "side": ("sidebar", "side", "widget", "related", "related-posts", "rail", "popular", "recommended"),
    "ad": ("ad", "ads", "advert", "sponsored", "promo", "adsbox", "ad-slot", "banner-ad"),
    "notice": ("notice", "cookie", "cookie-banner", "consent", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"),
    "comment": ("comments", "comment", "comment-list", "reply", "disqus", "discussion", "responses", "user-comments"),
    "share": ("share", "social", "share-buttons", "tags", "toolbar", "pagination", "author-bio"),
    "content": ("content", "article", "post", "entry", "main-content", "story", "article-body", "post-content", "text", "body-text"),
}
_SYLLABLES = "an ber co di el fa gi ha in jo ka le mi no or pa qu re si ta un vo wi ze tion ment".split()


class _Writer:
    """Writes a page; elements whose text is content carry the attribute data-label."""

    def __init__(self, seed: int, varied: bool):
        self.varied = varied
        self.r = random.Random(seed)
        self.apart = random.Random(-seed - 1)
        #: A third of the pages have names that say nothing, or none.
        self.names = self.apart.choice(["known", "known", "known", "known", "odd", "none"])

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(0, len(out), r.randint(5, 12)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += r.choice([".", ".", ",", "!"])
        return " ".join(out)

    def tag(self, name: str, inside: str, kind: str = "", label: bool = False) -> str:
        mark = ""
        if kind and self.names == "odd":
            mark = f' class="{self.r.choice("bcdfghkmpqrxz")}{self.r.randint(0, 99)}"'
        elif kind and self.names == "known" and self.r.random() < 0.9:
            mark = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(NAMES[kind])}"'
        return f"<{name}{mark}{' data-label' if label else ''}>{inside}</{name}>"

    def links(self, low: int, high: int) -> str:
        longest = 10 if self.varied and self.apart.random() < 0.25 else 4
        return self.tag("ul", "".join(self.tag("li", f'<a href="/x">{self.words(longest // 3, longest)}</a>') for _ in range(self.r.randint(low, high))))

    def paragraph(self, label: bool) -> str:
        text = self.words(*self.r.choice([(1, 5), (8, 40), (30, 120)]))
        if self.r.random() < 0.2:
            text += f' <a href="/y">{self.words(1, 3)}</a> <em>{self.words(1, 4)}</em>'
        if self.r.random() < 0.15:
            text = f"<b>{text}<br>"
        mark = " data-label" if label else ""
        return f"<p{mark}>{text}" + ("</p>" if self.r.random() < 0.85 else "")

    def control(self, parts: list[str], rate: float) -> None:
        """Adds a control without content to the parts, drawn apart from the rest of the page."""
        r = self.apart
        if r.random() >= rate:
            return
        self.r, kept = r, self.r
        made = r.choice([
            lambda: self.tag("button", self.words(1, 4), r.choice(["", "share"])),
            lambda: self.tag("select", "".join(self.tag("option", self.words(1, 3)) for _ in range(r.randint(2, 9)))),
            lambda: self.tag("svg", self.tag("text", self.words(1, 4))),
        ])()
        parts.insert(r.randint(0, len(parts)), made)
        self.r = kept

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            parts.append(self.tag("h1", self.words(2, 12), label=True))
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            parts.append(self.paragraph(True))
            if r.random() < 0.15:
                parts.append(self.tag(r.choice(["h2", "h3"]), self.words(1, 8), label=True))
            if r.random() < 0.12:
                parts.append(self.tag(r.choice(["ul", "ol"]), "".join(self.tag("li", self.words(2, 20), label=True) for _ in range(r.randint(2, 6))), label=True))
            if self.varied and self.apart.random() < 0.03 and not self.bare:
                parts.append(self.link_list())
            if r.random() < 0.08:
                parts.append(self.tag("blockquote", self.paragraph(True), label=True))
            if r.random() < 0.05:
                parts.append(self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.words(1, 5), label=True) for _ in range(3)), label=True) for _ in range(3)), label=True))
            if r.random() < 0.05:
                parts.append(self.tag("pre", self.words(3, 20), label=True))
            if r.random() < 0.12 and self.names == "known":
                parts.append(r.choice([lambda: self.tag("div", self.words(2, 15), "ad"), lambda: self.tag("div", self.words(3, 20), "notice"), lambda: self.tag("div", self.links(2, 5), "share"), lambda: self.tag("aside", self.words(5, 30), "side")])())
        if r.random() < 0.12:
            line = self.words(1, 4)
            parts.append("".join(f"<p data-label>{line if r.random() < 0.7 else self.words(1, 6)}</p>" for _ in range(r.choice([5, 12, 30, 80, 400]))))
        if self.varied and self.apart.random() < 0.2:
            parts = parts[: self.apart.choice([1, 1, 2, 9])] + self.sections()
        if self.varied and self.apart.random() < 0.05 and not self.bare:  # without an element around it, it is a menu
            parts = [*parts[:2], self.link_list()]
        self.control(parts, 0.25)
        inside = "".join(parts)
        if r.random() < 0.3:
            inside = self.tag("div", inside, "content", label=True)
        if self.bare:
            return inside
        name = r.choice(["article", "article", "main", "div", "section"])
        return self.tag(name, inside, "content" if name in ("div", "section") or r.random() < 0.3 else "", label=True)

    def comments(self) -> str:
        """Readers' comments under a heading, each with its author or without, or without a heading."""
        r = self.r
        authors = [lambda: self.tag("span", self.words(1, 2)), lambda: f"<b>{self.words(1, 2)}</b>", lambda: f"<div>{self.words(1, 3)}</div>", lambda: "", lambda: f'<a href="/u">{self.words(1, 1)}</a>']
        author = r.choice(authors if self.varied else authors[:1])
        each = lambda: self.tag(r.choice(["div", "li", "article"]), author() + self.paragraph(False), "comment")
        head = self.tag(r.choice(["h2", "h3", "h4"]) if self.varied else "h3", self.words(1, 3)) if not self.varied or author() == "" or r.random() < 0.8 else ""
        items = "".join(each() for _ in range(r.randint(1, 6)))
        if self.varied and r.random() < 0.5:
            items = self.tag(r.choice(["ol", "ul", "div"]), items, r.choice(["", "comment"]))
        return self.tag(r.choice(["section", "div"]), head + items, "comment")

    def sections(self) -> list[str]:
        """Parts of an article that are elements of their own, alike or not."""
        r = self.r
        name, head, count = r.choice(["section", "div", "div"]), r.choice(["h2", "h3", "h4", ""]), r.choice([1, 1, 2, 3])
        each = lambda: self.tag(name, (self.tag(head, self.words(1, 8), label=True) if head else "") + "".join(self.paragraph(True) for _ in range(count)), label=True)
        return [each() for _ in range(r.randint(1, 8) if head else 1)]

    def link_list(self) -> str:
        """An article that is a list of links with words of their own."""
        r = self.r
        each = lambda: self.tag("li", f'<a href="/b">{self.words(*r.choice([(2, 6), (4, 12)]))}</a>' + (f" {self.words(2, 12)}" if r.random() < 0.4 else ""), label=True)
        return self.tag(r.choice(["ul", "ol"]), "".join(each() for _ in range(r.randint(4, 14))), label=True)

    def laid_out(self, before: list[str], article: str, after: list[str]) -> str:
        """The parts of a page in the cells of a table."""
        r = self.r
        menu = r.choice([lambda: self.links(2, 8), lambda: "<br>".join(f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 8)))])()
        cells = [f"<td>{menu}</td>", f"<td data-label>{article}</td>"]
        if r.random() < 0.3:
            cells.append(f"<td>{self.words(1, 3)}{self.links(2, 6)}</td>")
        rows = [f"<tr data-label>{''.join(cells)}</tr>"]
        if r.random() < 0.6:
            rows.insert(0, f"<tr><td colspan=2>{self.words(1, 6)}{''.join(before)}</td></tr>")
        if r.random() < 0.7:
            rows.append(f"<tr><td colspan=2>{r.choice(['&copy; ', 'Copyright ', ''])}{self.words(2, 15)}</td></tr>")
        return f"<table{r.choice(['', ' width=100%', ' border=0'])} data-label>{''.join(rows)}</table>" + "".join(after)

    def plain(self) -> str:
        """Text without elements around it."""
        r = self.r
        text = r.choice(["\n\n", " ", "<br>", "<br><br>", "<hr>"]).join(self.words(*r.choice([(6, 20), (20, 60), (30, 120)])) for _ in range(r.choice([1, 1, 2, 4, 8])))
        return f"<body data-label>{text}" if r.random() < 0.7 else f"<html data-label><head><title>{self.words(2, 9)}</title></head><body>{text}</body></html>"

    def page(self) -> str:
        r, told = self.r, self.names == "known"
        if self.apart.random() < 0.06:
            return self.plain()
        self.bare = self.apart.random() < 0.1
        before, after = [], []
        if r.random() < 0.9:
            before.append(self.tag("nav", self.links(3, 9)) if r.random() < 0.7 else self.tag("div", self.links(3, 9), "nav"))
        if r.random() < 0.5:
            before.append(self.tag(r.choice(["header", "div"]), self.words(1, 8) + (self.links(2, 5) if r.random() < 0.5 else ""), "header"))
        if told and r.random() < 0.5:
            before.append(self.tag("div", self.words(2, 30), "ad"))
        if told and r.random() < 0.3:
            before.append(self.tag(r.choice(["div", "section"]), f"<p>{self.words(5, 40)}</p><a href='/ok'>{self.words(1, 2)}</a>", "notice"))
        if r.random() < 0.3:
            before.append(self.tag("aside" if r.random() < 0.5 else "div", self.words(1, 3) + self.links(2, 8), "side"))
        if (told or self.varied) and r.random() < 0.35:
            after.append(self.comments())
        if r.random() < 0.3:
            after.append(f"<form action='/s'><label>{self.words(1, 5)}</label><p>{self.words(2, 15)}</p></form>")
        if r.random() < 0.4:
            after.append(self.tag("aside" if r.random() < 0.5 else "div", self.tag("h3", self.words(1, 3)) + (self.links(2, 8) if not told or r.random() < 0.6 else f"<p>{self.words(5, 40)}</p>"), "side"))
        if r.random() < 0.9:
            after.append(self.tag("footer", f"&copy; {self.words(2, 25)}") if not told or r.random() < 0.75 else self.tag("div", f"<p>{self.words(2, 25)}</p>", "footer"))
        self.control(before, 0.3)
        self.control(after, 0.3)
        article = self.article()
        body = self.laid_out(before, article, after) if self.varied and self.apart.random() < 0.06 else "".join(before) + article + "".join(after)
        mark = " data-label" if self.bare else ""
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f'<div{r.choice(["", " class=wrapper", " id=page", " class=container"])}{mark}>{body}</div>'
        return f"<html><head><title>{self.words(2, 9)}</title></head><body{mark}>{body}</body></html>"


def labelled_pages(count: int, seed: int = 17, varied: bool = False) -> list[str]:
    """``varied`` pages have comments without names, parts alike, articles of links, long link titles and tables that lay
    them out, too."""
    return [_Writer(seed * 100_003 + i, varied).page() for i in range(count)]
