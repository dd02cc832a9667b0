"""Generated web pages with known main text, from which the block classifier is trained.

No table says which blocks of a page are its article, so pages are made: an
article in one of several kinds of container (or in none), with headings,
paragraphs of one word to many sentences, lists, tables, quotations and
sections named after topics, some of whose names hold a word that also names
page furniture; around and inside it menus, headers, footers, sidebars,
notices, adverts, forms, link lists and reader comments, marked by an element,
by a class, id or role, or not at all. Words are made of syllables, so nothing
depends on a language.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html import escape
from random import Random

_SYLLABLES = "ba ke lo mi nu ra so ti va ze dor fel gan hus jit kem lund mar nes pol".split()
#: Names of topics, and of page furniture, which classes and ids are made of.
TOPICS = "policy history results science kitchen travel law gems garden music work market school weather energy".split()
FURNITURE = {
    "menu": "nav menu navbar main-nav site-navigation top-menu breadcrumbs mainMenu".split(),
    "header": "header site-header masthead page-header topbar".split(),
    "footer": "footer site-footer page_footer footer-links".split(),
    "sidebar": "sidebar left-sidebar sidebar-widget sidenav".split(),
    "notice": "notice cookie-banner cookie-notice consent-box alert gdpr site-notice".split(),
    "advert": "ad ads advert ad-slot sponsored advertisement ad-wrapper promo-box".split(),
    "comments": "comments comment-list user-comments commentlist article-comments comment".split(),
    "related": "related related-posts recommended related-links".split(),
    "share": "share social-share share-buttons sharing".split(),
    "form": "newsletter newsletter-signup subscribe-form login".split(),
}
#: Words that name furniture but stand in topics' names as well, and names of containers.
MIXED = "social search related hidden tags share menu comment notice banner discussion alert".split()
CONTENT = "content post-content entry-content story-body article-body main-content post entry text page-content".split()


@dataclass
class Draft:
    """A page under way: its HTML and its blocks as (text, whether main text)."""

    rng: Random
    names: dict[str, list[str]]
    topics: list[str]
    containers: list[str]
    html: list[str] = field(default_factory=list)
    blocks: list[tuple[str, bool]] = field(default_factory=list)

    def words(self, least: int, most: int) -> list[str]:
        r = self.rng
        return ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(least, most))]

    def sentences(self, least: int, most: int) -> str:
        out = []
        for _ in range(self.rng.randint(least, most)):
            w = self.words(3, 18)
            if len(w) > 6 and self.rng.random() < 0.5:
                w[len(w) // 2] += ","
            out.append(" ".join(w).capitalize() + self.rng.choice("...!?"))
        return " ".join(out)

    def block(self, tag: str, text: str, good: bool, linked: str = "", marks: str = "") -> None:
        """``linked`` is ``all``, ``some`` (its middle word) or ``each`` word's own link."""
        w = text.split()
        if linked == "all":
            inner = f'<a href="/x">{escape(text)}</a>'
        elif linked == "each":
            inner = " ".join(f'<a href="/{i}">{escape(x)}</a>' for i, x in enumerate(w))
        elif linked == "some":
            w = [escape(x) for x in w]
            w[len(w) // 2] = f'<a href="#">{w[len(w) // 2]}</a>'
            inner = " ".join(w)
        else:
            inner = escape(text)
        self.html.append(f"<{tag}{marks}>{inner}</{tag}>")
        self.blocks.append((" ".join(text.split()), good))

    def named(self, kind: str) -> str:
        r = self.rng
        return f' {r.choice(("class", "class", "id"))}="{r.choice(self.names[kind])}"'

    def topical(self) -> str:
        """Marks of a part of the article: a topic, or a topic joined to a word that also names furniture."""
        r = self.rng
        if r.random() < 0.5:
            both = [r.choice(self.topics), r.choice(MIXED)]
            r.shuffle(both)
            return f' class="{"-".join(both)}"'
        return f' class="{r.choice(self.topics)}"'

    def links(self, good: bool = False) -> None:
        self.html.append("<ul>")
        for _ in range(self.rng.randint(2, 7)):
            self.block("li", " ".join(self.words(1, 5)), good, "all")
        self.html.append("</ul>")

    def furniture(self, kind: str, marked: bool = True) -> None:
        r = self.rng
        element = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        if element and r.random() < 0.5:
            tag, marks = element, "" if r.random() < 0.5 else self.named(kind)
            if kind == "header":
                tag, marks = "div", self.named(kind)
        else:
            tag, marks = r.choice(("div", "div", "section")), self.named(kind) if marked else ""
            if marked and r.random() < 0.06:
                marks = f' class="{r.choice(self.names[kind])}-{r.choice(self.topics)}"'
        self.html.append(f"<{tag}{marks}>")
        if kind in ("menu", "related"):
            self.links()
        elif kind in ("header", "share"):
            self.block(r.choice(("p", "span", "div")) if kind == "share" else "p", " ".join(self.words(1, 5)), False, r.choice(("all", "", "each")))
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                if r.random() < 0.4:
                    self.block("div", " ".join(self.words(1, 3)), False)
                self.block("p", self.sentences(1, 8), False)
        else:
            for _ in range(r.randint(1, 3)):
                self.block(r.choice(("p", "div")), self.sentences(1, r.choice((2, 8))) if r.random() < 0.7 else " ".join(self.words(1, 6)), False, r.choice(("", "", "some", "all")))
            if r.random() < 0.4:
                self.links()
        self.html.append(f"</{tag}>")

    def paragraph(self, good: bool = True) -> None:
        r = self.rng
        kind = r.random()
        if kind < 0.12:
            self.block("p", " ".join(self.words(1, 3)) + r.choice(("", ".")), good)
        elif kind < 0.18:
            self.block("p", self.sentences(1, 2), good, "all")
        elif kind < 0.26:
            self.block("p", " ".join(self.words(8, r.choice((20, 60, 300)))), good, r.choice(("", "some")))
        else:
            self.block("p", self.sentences(1, 8), good, r.choice(("", "", "some")))

    def article(self, headed: bool = True) -> None:
        r = self.rng
        if headed and r.random() < 0.8:
            inside = r.random() < 0.3
            self.html.append("<div>" if inside else "")
            self.block(r.choice(("h1", "h1", "h2")), " ".join(self.words(2, 10)), True)
            self.html.append("</div>" if inside else "")
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.6:
                self.paragraph()
            elif kind < 0.68:
                self.block(r.choice(("h2", "h3")), " ".join(self.words(1, 7)), True)
            elif kind < 0.75:
                tag = r.choice(("ul", "ol"))
                self.html.append(f"<{tag}>")
                for _ in range(r.randint(2, 5)):
                    self.block("li", " ".join(self.words(1, 12)), True, r.choice(("", "", "some")))
                self.html.append(f"</{tag}>")
            elif kind < 0.8:
                self.html.append("<table>")
                for _ in range(r.randint(1, 3)):
                    self.html.append("<tr>")
                    for _ in range(3):
                        self.block("td", " ".join(self.words(1, 3)), True)
                    self.html.append("</tr>")
                self.html.append("</table>")
            elif kind < 0.85:
                self.html.append("<blockquote>")
                self.block("p", self.sentences(1, 3), True)
                self.html.append("</blockquote>")
            elif kind < 0.97:
                tag = r.choice(("div", "section"))
                self.html.append(f"<{tag}{self.topical()}>")
                for _ in range(r.randint(1, 3)):
                    self.paragraph()
                self.html.append(f"</{tag}>")
            else:
                self.block("p", self.sentences(1, 4), True, marks=self.topical())
            if r.random() < 0.06:
                self.furniture(r.choice(("advert", "share", "form", "sidebar", "related", "notice")))


def page(rng: Random, names: dict[str, list[str]] = FURNITURE, topics: list[str] = TOPICS, containers: list[str] = CONTENT) -> tuple[str, list[tuple[str, bool]]]:
    """HTML of a page, and its blocks in order as (text, whether main text)."""
    d = Draft(rng, names, topics, containers)
    kind = rng.random()
    small = kind > 0.85
    if not small:
        for what, share in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("advert", 0.4), ("form", 0.15)):
            if rng.random() < share:
                d.furniture(what)
        if rng.random() < 0.2:
            d.links()
    around = {
        0: ("<article>", "</article>"),
        1: ('<main><article class="post">', "</article></main>"),
        2: ("<main>", "</main>"),
        3: (f'<div {rng.choice(("class", "id"))}="{rng.choice(d.containers)}">', "</div>"),
        4: ("<div>", "</div>"),
        5: ("", ""),
    }[5 if small else min(5, int(kind / 0.85 * 6.9))]
    d.html.append(around[0])
    if small:
        for _ in range(rng.randint(1, 3)):
            d.paragraph()
    else:
        d.article()
    if not small and around[0] and rng.random() < 0.2:
        d.furniture("comments")
    d.html.append(around[1])
    if not small:
        for what, share in (("share", 0.3), ("related", 0.4), ("sidebar", 0.5), ("advert", 0.2), ("comments", 0.5), ("form", 0.2)):
            if rng.random() < share:
                d.furniture(what)
        if rng.random() < 0.15:
            d.links()
    if rng.random() < (0.3 if small else 0.8):
        d.furniture("footer")
    elif rng.random() < 0.3:
        d.block("p", "© 2020 " + " ".join(d.words(1, 4)), False)
    head = "<!DOCTYPE html><html><head><title>x</title></head><body>" if rng.random() < 0.8 else ""
    return head + "\n".join(d.html) + ("</body></html>" if head else ""), d.blocks
