"""Synthetic pages with known blocks, to fit the block labeller on: many layouts, invented words."""

from __future__ import annotations

import random
from collections.abc import Callable

SYLLABLES = "ba ce di fo gu ha je ki lo mu na or pe qui ra se ti un ve wa xo yl za th en er st al".split()
#: Names that page authors give to the containers of an article.
CONTENT = "content post article entry story main-content post-body article-body entry-content text body-copy page-content hentry".split()
AD = "ad ads advert advertisement banner sponsor sponsored promo adsbygoogle ad-slot ad-container dfp".split()
SIDE = "sidebar widget related aside right-col secondary recommended trending most-read".split()
NOTICE = "cookie cookie-notice gdpr consent notice alert newsletter subscribe-box paywall popup modal".split()
TALK = "comments comment discussion replies disqus comment-list responses".split()
MENU = "nav menu navbar breadcrumbs topnav main-menu navigation links tabs".split()
TOP = "header masthead site-header top branding page-header".split()
BOTTOM = "footer site-footer bottom copyright legal foot page-footer".split()
PHRASES = {
    "notice": ["We use cookies to improve your experience.", "Accept all cookies", "Subscribe to our newsletter", "Sign up for updates"],
    "foot": ["All rights reserved.", "Privacy policy", "Terms of use", "Copyright 2021", "Contact us", "Imprint"],
    "menu": ["Home", "About", "Contact", "Login", "Search", "News", "Archive", "Sports", "Shop"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer"],
    "talk": ["Reply", "Leave a comment", "Report", "3 comments", "Anonymous says:"],
    "form": ["Name", "Email", "Submit", "Search", "Password", "Your message", "Send"],
    "side": ["Related articles", "Most read", "Popular posts", "You may also like", "Tags", "Recent comments"],
}


class Page:
    """Collects markup and, for each leaf block in page order, whether it belongs to the article."""

    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.labels = rng, [], []

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def prose(self, sentences: int) -> str:
        if self.rng.random() < 0.03:
            return " ".join([self.word()] * self.rng.randint(5, 80))
        return " ".join(self.words(1, 14).capitalize() + self.rng.choice(["."] * 8 + ["!", "?", "***", "%%%"]) for _ in range(sentences))

    def leaf(self, tag: str, text: str, keep: bool, attributes: str = "") -> None:
        rng = self.rng
        if keep and rng.random() < 0.2:
            cut = text.split(" ")
            i = rng.randrange(len(cut))
            cut[i] = rng.choice(["<b>%s</b>", "<em>%s</em>", '<a href="/x">%s</a>', "<b>%s", "%s<br>"]) % cut[i]
            text = " ".join(cut)
        end = "" if tag in ("p", "li") and rng.random() < 0.1 else f"</{tag}>"
        self.parts.append(f"<{tag}{attributes}>{text}{end}")
        self.labels.append(keep)

    def box(self, tag: str, names: list[str], fill: Callable[[], None]) -> None:
        rng = self.rng
        kind = rng.random()
        attributes = f' class="{rng.choice(names)}"' if kind < 0.6 else f' id="{rng.choice(names)}"' if kind < 0.8 else f' class="{rng.choice(names)} {self.word()}"'
        self.parts.append(f"<{tag}{attributes if tag in ('div', 'section', 'td', 'ul', 'table', 'form') or rng.random() < 0.4 else ''}>")
        fill()
        self.parts.append(f"</{tag}>")
        if rng.random() < 0.2:
            self.parts.append("\n")

    # What a page is made of.

    def menu(self, tag: str | None = None) -> None:
        rng = self.rng

        def items() -> None:
            listed = rng.random() < 0.7
            if listed:
                self.parts.append("<ul>")
            for _ in range(rng.randint(2, 9)):
                text = rng.choice(PHRASES["menu"]) if rng.random() < 0.3 else self.words(1, 2)
                self.leaf("li" if listed else "div", f'<a href="/{self.word()}">{text}</a>', False)
            if listed:
                self.parts.append("</ul>")

        self.box(tag or rng.choice(["nav", "nav", "div", "div", "section"]), MENU, items)

    def top(self) -> None:
        def fill() -> None:
            self.leaf(self.rng.choice(["h1", "div", "p", "h2"]), self.words(1, 5), False)
            if self.rng.random() < 0.4:
                self.menu()

        self.box(self.rng.choice(["header", "header", "div"]), TOP, fill)

    def bottom(self) -> None:
        def fill() -> None:
            for _ in range(self.rng.randint(1, 4)):
                text = self.rng.choice([self.words(1, 5), self.prose(2), "&copy; " + self.words(1, 6), self.rng.choice(PHRASES["foot"])])
                self.leaf(self.rng.choice(["p", "div"]), text, False)

        def bare() -> None:
            self.parts.append("&copy; " + self.words(2, 8) + " &middot; " + self.prose(1))
            self.labels.append(False)

        self.box(self.rng.choice(["footer", "footer", "div"]), BOTTOM, bare if self.rng.random() < 0.4 else fill)

    def loose(self, names: list[str], phrases: str, tags: list[str], sentences: int) -> None:
        """A box of one text, or of a few, that is not the article's."""
        tag = self.rng.choice(tags)

        def bare() -> None:
            self.parts.append(self.rng.choice(PHRASES[phrases]) if self.rng.random() < 0.3 else self.prose(self.rng.randint(1, sentences)))
            self.labels.append(False)

        def fill() -> None:
            if self.rng.random() < 0.5:
                self.leaf(self.rng.choice(["h3", "h4"]), self.rng.choice(PHRASES[phrases]), False)
            for _ in range(self.rng.randint(1, 4)):
                self.leaf("p", self.prose(self.rng.randint(1, sentences)), False)

        self.box(tag, names, bare if self.rng.random() < 0.5 else fill)

    def side(self) -> None:
        def fill() -> None:
            self.leaf(self.rng.choice(["h3", "h4", "h2"]), self.rng.choice(PHRASES["side"]), False)
            for _ in range(self.rng.randint(2, 6)):
                self.leaf(self.rng.choice(["li", "p", "div"]), f'<a href="/{self.word()}">{self.words(3, 9)}</a>' if self.rng.random() < 0.7 else self.prose(1), False)

        self.box(self.rng.choice(["aside", "aside", "div", "section"]), SIDE, fill)

    def talk(self) -> None:
        def fill() -> None:
            self.leaf(self.rng.choice(["h3", "h2", "div"]), self.rng.choice(PHRASES["talk"]), False)
            for _ in range(self.rng.randint(1, 6)):
                if self.rng.random() < 0.5:
                    self.leaf("div", self.words(1, 2), False, ' class="author"')
                self.leaf(self.rng.choice(["p", "div", "li"]), self.prose(self.rng.randint(1, 4)), False, self.rng.choice(["", ' class="comment"', ' class="comment-body"']))
                if self.rng.random() < 0.3:
                    self.leaf("div", '<a href="#r">Reply</a>', False)

        self.box(self.rng.choice(["section", "div", "div"]), TALK, fill)

    def form(self) -> None:
        def fill() -> None:
            for _ in range(self.rng.randint(1, 3)):
                self.leaf(self.rng.choice(["p", "div"]), f"<label>{self.rng.choice(PHRASES['form'])}</label><input name=a>", False)
            self.parts.append(f"<div><button>{self.rng.choice(PHRASES['form'])}</button></div>")  # no block

        self.box("form", ["search", "login", "contact", "signup"], fill)

    def article(self) -> None:
        rng = self.rng

        def fill() -> None:
            if rng.random() < 0.85:
                self.leaf(rng.choice(["h1", "h1", "h2"]), self.words(2, 12).capitalize() + rng.choice(["", "."]), True)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 8, 12, 20])):
                kind = rng.random()
                if kind < 0.78:
                    self.leaf("p", self.prose(rng.choice([1, 1, 2, 3, 5, 8])), True)
                elif kind < 0.84:
                    self.leaf(rng.choice(["h2", "h3"]), self.words(1, 6), True)
                elif kind < 0.9:
                    self.parts.append("<ul>")
                    for _ in range(rng.randint(2, 5)):
                        self.leaf("li", self.prose(1), True)
                    self.parts.append("</ul>")
                elif kind < 0.93:
                    self.parts.append("<blockquote>")
                    self.leaf("p", self.prose(2), True)
                    self.parts.append("</blockquote>")
                elif kind < 0.95:
                    self.leaf("pre", self.words(3, 20), True)
                elif kind < 0.98:
                    self.loose(AD, "ad", ["div", "aside"], 2)
                else:
                    self.side()

        tag = rng.choice(["article"] * 4 + ["main", "main", "div", "div", "section", "td"])
        if tag == "td":
            self.parts.append("<table><tr>")
        if tag in ("div", "section", "td"):
            self.box(tag, CONTENT, fill)
        else:
            self.parts.append(f"<{tag}{rng.choice(['', '', f' class={chr(34)}{rng.choice(CONTENT)}{chr(34)}'])}>")
            if tag == "main" and rng.random() < 0.4:
                self.parts.append(rng.choice(["<article>", "<div>", "<section>"]))
            fill()
            self.parts.append(f"</{tag}>")
        if tag == "td":
            self.parts.append("</tr></table>")

    def whole(self) -> tuple[str, list[bool]]:
        rng = self.rng
        wrapped = rng.random() < 0.3
        self.parts.append(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(2, 9)}</title><style>p{{a:b}}</style><script>var t="</p>";</script></head><body>' + ("<div class='wrap'>" if wrapped else ""))
        self.labels.append(False)
        before = [self.menu, self.top, lambda: self.loose(NOTICE, "notice", ["div", "section"], 2), lambda: self.loose(AD, "ad", ["div", "div", "aside"], 2), self.form, self.side]
        after = [self.side, self.talk, self.bottom, self.bottom, lambda: self.loose(AD, "ad", ["div", "div", "aside"], 2), self.form, lambda: self.loose(NOTICE, "notice", ["div", "section"], 2), self.menu]
        for part in rng.sample(before, rng.randint(0, 4)):
            part()
        self.article()
        for part in rng.sample(after, rng.randint(0, 4)):
            part()
        self.parts.append(("</div>" if wrapped else "") + rng.choice(["</body></html>", ""]))
        return "".join(self.parts), self.labels


def pages(count: int, seed: int) -> list[tuple[str, list[bool]]]:
    return [Page(random.Random(f"{seed}/{i}")).whole() for i in range(count)]
