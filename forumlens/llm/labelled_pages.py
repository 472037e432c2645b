"""Labelled training pages: layouts drawn at random whose parts are known by construction.

A page has an article among menus, headers, notices, adverts, forms, side columns, comments and a footer. Every part is
written with semantic tags or with plain elements and telling names, and sometimes with no sign but its text. Some pages
are laid out in nested tables without any name. Blocks of the article carry the mark of ``blocks.MARK``.
"""

from __future__ import annotations

import random

from forumlens.llm.blocks import MARK

# Usual names of the parts of a page.
NAMES = {
    "menu": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topbar site-nav toolbar tabs pagination".split(),
    "header": "header site-header masthead branding page-header top head logo".split(),
    "footer": "footer site-footer colophon bottom foot copyright page-footer legal".split(),
    "side": "sidebar aside side widget widgets related related-posts rail secondary recommended tags share social".split(),
    "notice": "cookie cookie-notice cookie-banner notice consent gdpr alert popup modal banner warning message".split(),
    "ad": "ad ads advert advertisement adsbygoogle ad-slot sponsor sponsored promo promotion banner-ad".split(),
    "form": "search search-form newsletter subscribe login signup contact-form".split(),
    "comments": "comments comment comment-list commentlist replies discussion responses respond reader-comments".split(),
    "content": "content article post entry entry-content main story article-body post-content page-content text".split(),
}
TAGS = {
    "menu": ("nav", "menu"), "header": ("header",), "footer": ("footer",), "side": ("aside",), "notice": ("aside", "dialog"),
    "ad": ("aside",), "form": ("form",), "comments": ("section", "aside"), "content": ("article", "main"),
}
PHRASES = {
    "notice": ("We use cookies.", "This site uses cookies to improve your visit.", "Accept all", "Privacy policy"),
    "ad": ("Advertisement", "Sponsored", "Buy now"),
    "footer": ("© 2021", "All rights reserved.", "Copyright", "Privacy policy", "Terms"),
    "form": ("Subscribe to our newsletter", "Search", "Sign in", "Your email"),
    "comments": ("Comments", "Leave a reply", "Reply", "3 comments", "Log in to comment"),
    "side": ("Related", "Read more", "Share this", "Popular"),
}
_SYLLABLES = "the an on re in ti st er ou ed ly ble tion que eau ment ver keit und ción rro ña lo mi za pa vi é è ü".split()


class _Writer:
    def __init__(self, number: int):
        self.random = random.Random(number)

    def chance(self, share: float) -> bool:
        return self.random.random() < share

    def words(self, low: int, high: int) -> str:
        count = self.random.randint(low, high)
        made = ["".join(self.random.choices(_SYLLABLES, k=self.random.randint(1, 4))) for _ in range(count)]
        return " ".join(made)

    def sentence(self, low: int = 3, high: int = 18) -> str:
        text = self.words(low, high).capitalize()
        if self.chance(0.1):
            text = text.replace(" ", self.random.choice((" &amp; ", ", ", "*** ", " | ")))
        return text + self.random.choice(("." if self.chance(0.9) else "", "!", "?", "&hellip;", ".", "."))

    def paragraph(self) -> str:
        if self.chance(0.2):
            return self.sentence(1, 3)
        sentences = [self.sentence() for _ in range(self.random.randint(1, 7))]
        for place in range(len(sentences)):
            if self.chance(0.15):
                mark = self.random.choice(("b", "i", "em", "strong", "span", "a", "code"))
                link = ' href="/x"' if mark == "a" else ""
                close = f"</{mark}>" if self.chance(0.8) else ""
                sentences[place] = f"<{mark}{link}>{sentences[place]}{close}"
        if self.chance(0.25):
            sentences[0] = f'{self.words(1, 6).capitalize()} <a href="/x">{self.words(1, 3)}</a> {self.sentence(1, 8)}'
        return self.random.choice((" ", " ", "<br>", "\n")).join(sentences)

    def open(self, kind: str, mark: str | None = None) -> tuple[str, str]:
        """Tags around a part: semantic, named, both or neither."""
        semantic = self.chance(0.55)
        tag = self.random.choice(TAGS[kind]) if semantic else self.random.choice(("div", "div", "div", "section", "td"))
        named = self.chance(0.5) if semantic else self.chance(0.92)
        name = f' {self.random.choice(("class", "class", "id"))}="{self._name(kind)}"' if named else ""
        sign = f' {MARK}="{mark}"' if mark is not None else ""
        return f"<{tag}{name}{sign}>", f"</{tag}>"

    def _name(self, kind: str) -> str:
        name = self.random.choice(NAMES[kind])
        return self.random.choice((name, name, f"{name} {self.random.choice('abcxyz')}{self.random.randint(1, 9)}"))

    def links(self) -> str:
        listed = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.random.randint(2, 8))]
        if self.chance(0.6):
            return "<ul>" + "".join(f"<li>{link}</li>" for link in listed) + "</ul>"
        return self.random.choice((" ", " | ", "")).join(listed)

    def line(self, kind: str) -> str:
        phrases = PHRASES.get(kind)
        text = self.random.choice(phrases) if phrases and self.chance(0.5) else self.sentence(1, 12)
        if kind == "footer" and self.chance(0.6):
            text = f"&copy; {self.words(1, 2)} &middot; {text}"
        return text

    def part(self, kind: str, mark: str | None = None) -> str:
        start, end = self.open(kind, mark)
        if kind in ("menu",) or (kind in ("side", "footer", "header") and self.chance(0.5)):
            inner = self.links()
            if self.chance(0.3):
                inner = f"<h3>{self.line(kind)}</h3>{inner}"
        elif kind == "header" and self.chance(0.6):
            inner = "<{0}>{1}</{0}>".format(self.random.choice(("h1", "h1", "h2", "p")), self.words(1, 3).title())
            if self.chance(0.5):
                inner += f"<nav>{self.links()}</nav>"
        elif kind == "comments":
            each = [f"<p>{self.paragraph()}</p>" for _ in range(self.random.randint(1, 4))]
            wrap = self.random.choice(("div", "li", "article"))
            each = [f'<{wrap} class="{self.random.choice(("comment", "reply", "user"))}">{text}</{wrap}>' for text in each]
            inner = f"<h3>{self.line(kind)}</h3>" + "".join(each)
        elif kind == "form":
            inner = f"<label>{self.line(kind)}</label><input name=q><button>{self.words(1, 2)}</button>"
            if self.chance(0.4):
                inner = f"<p>{self.sentence()}</p>{inner}"
            if "form" not in start:
                inner = f"<form>{inner}</form>"
        else:
            lines = [self.line(kind) for _ in range(self.random.randint(1, 3))]
            wrap = self.random.choice(("", "p", "p", "div", "span"))
            inner = "".join(f"<{wrap}>{text}</{wrap}>" if wrap else f"{text} " for text in lines)
        return start + inner + end

    def body(self) -> str:
        """The blocks of an article; parts inside it that are none of it say so."""
        title = self.words(2, 9).capitalize()
        made = [f"<h1>{title}</h1>" if self.chance(0.9) else f"<h2>{title}</h2>"]
        if self.chance(0.2):
            made.append(f'<p class="byline">{self.words(2, 5)}</p>')
        for _ in range(self.random.randint(1, 14)):
            draw = self.random.random()
            if draw < 0.69:
                made.append(f"<p>{self.paragraph()}" + ("</p>" if self.chance(0.9) else ""))
            elif draw < 0.77:
                made.append(f"<{(h := self.random.choice(('h2', 'h3', 'h4')))}>{self.words(1, 7)}</{h}>")
            elif draw < 0.83:
                items = "".join(f"<li>{self.sentence(1, 9)}</li>" for _ in range(self.random.randint(2, 5)))
                made.append(f"<ul>{items}</ul>")
            elif draw < 0.86:
                made.append(f"<blockquote>{self.sentence()}</blockquote>")
            elif draw < 0.88:
                made.append(f"<pre>{self.words(2, 9)}\n{self.words(2, 9)}</pre>")
            elif draw < 0.90:
                made.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif draw < 0.92:
                made.append(f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>")
            else:
                made.append(self.part(self.random.choice(("ad", "side", "form", "ad", "notice")), "0"))
        if self.chance(0.15):
            made.append(self.part("comments", "0"))
        if self.chance(0.1):
            made.append(self.part("footer", "0"))
        return "".join(made)

    def page(self) -> str:
        start, end = self.open("content", "1")
        if self.chance(0.08):  # an element without any sign
            start, end = f'<div {MARK}="1">', "</div>"
        elif not any(sign in start for sign in ("article", "main", "class", "id")):
            start, end = f'<article {MARK}="1">', "</article>"
        before = [kind for kind in ("header", "menu", "notice", "ad", "menu", "form", "side") if self.chance(0.45)]
        after = [kind for kind in ("comments", "side", "ad", "form", "notice") if self.chance(0.3)]
        self.random.shuffle(before)
        self.random.shuffle(after)
        if self.chance(0.9):
            after.append("footer")
        if self.chance(0.06):  # a page of nothing but text
            tag = self.random.choice(("p", "p", "div"))
            return "".join(f'<{tag} {MARK}="1">{self.paragraph()}</{tag}>' for _ in range(self.random.randint(1, 3)))
        made = [self.part(kind) for kind in before]
        made.append(start + self.body() + end)
        made += [self.part(kind) for kind in after]
        inner = "".join(part + self.random.choice(("", "\n", "<!-- x -->")) for part in made)
        if self.chance(0.2):
            inner = f'<div id="{self.random.choice(("page", "wrapper", "container", "root"))}">{inner}</div>'
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        page = f"<!DOCTYPE html><html lang=en>{head}<body>{inner}"
        return page + ("</body></html>" if self.chance(0.9) else "")


    def row(self, *cells: str) -> str:
        style = self.random.choice(("", "", " valign=top", " width=150", " bgcolor=#eeeeee"))
        return "<tr>" + "".join(f"<td{style}>{cell}</td>" for cell in cells) + "</tr>"

    def table_page(self) -> str:
        """A page whose parts are cells of nested tables."""
        menu = self.random.choice(("<br>", " ", " | ", " - ")).join(
            f'<a href="/{i}">{self.words(1, 3).title()}</a>' for i in range(self.random.randint(1, 9))
        )
        if self.chance(0.5):
            menu = f"<b>{self.words(1, 2).title()}</b><br>{menu}"
        if self.chance(0.5):
            paragraphs = [f"<h1>{self.words(2, 9).capitalize()}</h1>", *[f"<p>{self.paragraph()}</p>" for _ in range(self.random.randint(1, 6))]]
            if self.chance(0.5):
                paragraphs = [paragraph[3:-4] if paragraph.startswith("<p>") else paragraph for paragraph in paragraphs]
            article = f'<table {MARK}="1">{"".join(map(self.row, paragraphs))}</table>'
        else:
            article = f'<div {MARK}="1">{self.body()}</div>' if self.chance(0.5) else f'<font {MARK}="1">{self.body()}</font>'
        cells = [menu, article] if self.chance(0.7) else [article]
        if self.chance(0.3):
            cells.append(self.line(self.random.choice(("side", "ad", "notice"))))
        rows = [self.row(*cells)]
        if self.chance(0.8):
            rows.insert(0, self.row(self.links() if self.chance(0.7) else self.words(1, 3).title()))
        if self.chance(0.8):
            rows.append(self.row(self.line("footer")))
        return f"<html><head><title>{self.words(2, 6)}</title></head><body><table width=100%>{''.join(rows)}</table></body></html>"


# One page of so many is laid out in tables.
TABLE_PAGES = 20


def labelled_page(number: int) -> str:
    """The training page of a number."""
    return _Writer(number).table_page() if number % TABLE_PAGES == 5 else _Writer(number).page()
