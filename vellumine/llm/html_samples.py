"""Invented web pages with known main text, to train the block labeller on."""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = "an be ci do el fa go hu in jo ka lo mi no or pu qua re sa ti un ve wi xo ya ze th er ing tion ment ée ü ß ñ ou st".split()
_MENU = "menu nav navigation navbar topnav links breadcrumb breadcrumbs".split()
_SIDE = "sidebar side aside widget related rail recommended popular".split()
_AD = "ad ads advert advertisement banner sponsored promo".split()
_NOTICE = "notice cookie cookies consent alert popup gdpr modal message".split()
_COMMENTS = "comments comment-list responses discussion disqus replies".split()
_FORM = "form newsletter subscribe signup login search contact".split()
_FOOT = "footer foot bottom colophon copyright site-footer".split()
_HEAD = "header masthead top site-header branding logo".split()
_MAIN = "content article post entry main story post-body entry-content article-body text main-content page-content".split()
_NEUTRAL = "row col col-8 col-md-4 container wrapper inner box block section a1 c2 x9 grid left right span12 holder".split()
_BEFORE, _AFTER = "site- page- js- the- my".split(), "-wrap -area Block -box _1 s Container".split()


class _Maker:
    def __init__(self, rng: random.Random):
        self.r, self.oddness = rng, 0.0

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        out = []
        for _ in range(self.r.randint(lo, hi)):
            s = self.words(2, 16)
            if self.r.random() < 0.3:
                s = s.replace(" ", ", ", 1)
            out.append(s[:1].upper() + s[1:] + self.r.choice("...?!"))
        return " ".join(out)

    def attr(self, names: list[str], sure: float = 0.85) -> str:
        if self.r.random() > sure:
            return self.r.choice(("", f' class="{self.r.choice(_NEUTRAL)}"'))
        name = self.r.choice(names)
        if self.r.random() < 0.25:
            name = self.r.choice(_BEFORE) + name
        if self.r.random() < 0.25:
            name += self.r.choice(_AFTER)
        key = self.r.choice(("class", "class", "id"))
        extra = f" {self.r.choice(_NEUTRAL)}" if key == "class" and self.r.random() < 0.3 else ""
        return f' {key}="{name}{extra}"'

    def links(self, lo: int, hi: int) -> list[str]:
        return [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(lo, hi))]

    def link_list(self, lo: int = 2, hi: int = 8) -> str:
        if self.r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}{self.r.choice(('', '</li>'))}" for x in self.links(lo, hi)) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(self.links(lo, hi))

    def nav(self) -> str:
        return f"<nav{self.attr(_MENU, 0.3)}>{self.link_list()}</nav>" if self.r.random() < 0.7 else f"<div{self.attr(_MENU, 1)}>{self.link_list()}</div>"

    def header(self) -> str:
        tag, a = ("header", self.attr(_HEAD, 0.3)) if self.r.random() < 0.7 else ("div", self.attr(_HEAD, 1))
        inner = self.r.choice((f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 4)}</h1><p>{self.words(3, 8)}</p>", f"<div class=logo>{self.words(1, 2)}</div>{self.nav()}"))
        return f"<{tag}{a}>{inner}</{tag}>"

    def aside(self) -> str:
        tag, a = ("aside", self.attr(_SIDE, 0.5)) if self.r.random() < 0.6 else ("div", self.attr(_SIDE, 1))
        inner = self.r.choice((f"<h3>{self.words(1, 3)}</h3>{self.link_list()}", f"<h4>{self.words(1, 3)}</h4><p>{self.sentences(1, 3)}</p>", f"<p>{self.sentences(1, 2)}</p>"))
        return f"<{tag}{a}>{inner}</{tag}>"

    def ad(self) -> str:
        inner = self.r.choice((self.sentences(1, 2), f"<p>{self.sentences(1, 2)}</p>", f'<a href="https://{self.word()}.example">{self.words(2, 9)}</a>'))
        return f"{self.r.choice(('', '<!-- ad -->'))}<div{self.attr(_AD, 1)}>{inner}</div>"

    def notice(self) -> str:
        return f"<div{self.attr(_NOTICE, 1)}>{self.r.choice((self.sentences(1, 2), f'<p>{self.sentences(1, 3)}</p><button>{self.words(1, 2)}</button>'))}</div>"

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>"
        return f"<form{self.attr(_FORM, 0.5)}><p>{self.words(2, 9)}</p>{inner}</form>" if self.r.random() < 0.6 else f"<div{self.attr(_FORM, 1)}><p>{self.sentences(1, 1)}</p><form>{inner}</form></div>"

    def comments(self) -> str:
        one = lambda: self.r.choice((f"<b>{self.words(1, 2)}</b> <p>{self.sentences(1, 4)}</p>", f"<p>{self.sentences(1, 4)}</p>", self.sentences(1, 3)))
        kind = self.r.choice(("div", "li", "article", "p"))
        if kind == "p":
            each = "".join(f"<p>{self.sentences(1, 4)}</p>" for _ in range(self.r.randint(1, 5)))
        else:
            each = "".join(f'<{kind}{self.attr(["comment", "reply", "comment-body", "response"], 0.6)}>{one()}</{kind}>' for _ in range(self.r.randint(1, 5)))
        if kind == "li":
            each = f"<ol{self.attr(_COMMENTS, 0.5)}>{each}</ol>"
        head = f"<h3>{self.words(1, 3)}</h3>" if self.r.random() < 0.6 else ""
        form = f"<form{self.attr(['comment-form', 'reply-form'], 0.7)}><label>{self.words(1, 4)}</label><textarea>{self.words(1, 3)}</textarea><button>{self.words(1, 2)}</button></form>" if self.r.random() < 0.3 else ""
        tag = self.r.choice(("section", "div", "div"))
        return f"<{tag}{self.attr([*_COMMENTS, 'comment-form', 'reader-comments'], 1)}>{head}{''.join(self.r.sample((each, form), 2))}</{tag}>"

    def footer(self) -> str:
        tag, a = ("footer", self.attr(_FOOT, 0.3)) if self.r.random() < 0.75 else ("div", self.attr(_FOOT, 1))
        inner = self.r.choice((f"&copy; {self.word()}.example &middot; {self.sentences(1, 2)}", f"<p>&copy; {self.words(2, 6)}</p>{self.link_list(1, 4)}", f"{self.sentences(1, 3)}"))
        return f"<{tag}{a}>{inner}</{tag}>"

    def paragraph(self) -> tuple[str, list[str]]:
        """Markup of one block and the texts that it shows."""
        kind = self.r.random()
        s = self.odd() if self.r.random() < self.oddness else self.sentences(1, 7) if self.r.random() < 0.8 else self.words(1, 4) + "."
        if kind < 0.62:
            return f"<p>{s}{self.r.choice(('</p>', '</p>', ''))}", [s]
        if kind < 0.72:
            return f"<p><b>{s}<br>", [s]
        if kind < 0.8:
            return f"<h{self.r.randint(2, 4)}>{s}</h2>".replace("</h2>", ""), [s]
        if kind < 0.88:
            items = [self.sentences(1, 2) for _ in range(self.r.randint(1, 4))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", items
        if kind < 0.94:
            t = self.sentences(1, 3)
            return f'<p>{s} <a href="/{self.word()}">{t}</a></p>', [f"{s} {t}"]
        return f"<blockquote>{s}</blockquote>", [s]

    def odd(self) -> str:
        """A line that isn't prose: a word again and again, signs, numbers, a bare word, a long run."""
        w = self.word()
        return self.r.choice((
            " ".join([w] * self.r.randint(1, 40)),
            " ".join(x + self.r.choice(("$$$", "###", "***", "%%%", "", "==")) for x in self.words(3, 60).split()),
            f"{w} {self.r.randint(0, 99999)} +1 ({self.r.randint(100, 999)}) {self.r.randint(0, 9)}.{self.r.randint(0, 9)} {w}@{w}.example",
            w,
            f"Licensed under {self.words(1, 3)} {self.r.randint(1, 4)}.0.",
            self.words(80, 250),
        ))

    def article(self) -> tuple[str, list[str]]:
        body, texts = [], []
        if self.r.random() < 0.85:
            h = self.words(3, 12)
            body.append(f"<h1>{h}</h1>")
            texts.append(h)
        self.oddness = self.r.choice((0, 0, 0.1, 0.7))
        for _ in range(self.r.choice((1, 1, 2, 3, 4, 6, 9, 14, 14, 30, 70))):
            markup, shown = self.paragraph()
            if markup.startswith("<h") and not markup.endswith(">"):
                markup += f"</{markup[1:3]}>"
            body.append(markup)
            texts += shown
            if self.r.random() < 0.04:
                body.append(self.r.choice((self.ad, self.aside, self.form, self.notice))())
        if self.r.random() < 0.15:
            body.append(self.comments())
        inner = self.wrapped("".join(body), 0.15)
        kind = self.r.random()
        if kind < 0.5:
            return f"<article{self.attr(_MAIN, 0.3)}>{inner}</article>", texts
        if kind < 0.65:
            return f"<main{self.attr(_MAIN, 0.3)}>{inner}</main>", texts
        if kind < 0.93:
            return f"<div{self.attr(_MAIN, 1)}>{inner}</div>", texts
        return inner, texts

    def wrapped(self, inner: str, share: float) -> str:
        """inner within elements that say nothing."""
        while self.r.random() < share:
            inner = f"<div{self.attr(_NEUTRAL, 0.9)}>{inner}</div>"
        return inner

    def page(self) -> tuple[str, set[str]]:
        article, texts = self.article()
        article = self.wrapped(article, 0.3)
        parts = [self.wrapped(p(), 0.15) for p, share in ((self.notice, 0.2), (self.header, 0.4), (self.nav, 0.8), (self.ad, 0.5), (self.form, 0.15), (self.aside, 0.25)) if self.r.random() < share]
        after = [self.wrapped(p(), 0.15) for p, share in ((self.comments, 0.35), (self.aside, 0.25), (self.ad, 0.3), (self.form, 0.15), (self.nav, 0.1), (self.footer, 0.85), (self.notice, 0.1)) if self.r.random() < share]
        middle = "".join([*parts, article, *after])
        middle = self.wrapped(middle, 0.3)
        head = f"<head><meta charset=utf-8><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{middle}{self.r.choice(('</body></html>', '</body></html>', ''))}", {" ".join(t.split()) for t in texts}


def sample_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """(page, texts of its main blocks)."""
    maker = _Maker(random.Random(seed))
    for _ in range(n):
        yield maker.page()
