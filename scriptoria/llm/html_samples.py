"""Labelled web pages for the fit of the main-text classifier, written from a seed.

A page has a header, navigation, notices, adverts, an article, a side column, comments and a footer, each in one of several common forms: by element, by class or id, or
by neither. Words of the article begin with CONTENT, all others don't.
"""

from __future__ import annotations

import random

CONTENT = "k"
_LETTERS = "aeiourstlnmdv"
_PLAIN = "c1 box wrap row col-8 inner block x-42 grid unit section module layout-2 js-item css-1q2w".split()


def is_content(text: str) -> bool:
    return text.startswith(CONTENT)


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int, own: bool) -> str:
        first = CONTENT if own else "b"
        return " ".join(first + "".join(self.r.choice(_LETTERS) for _ in range(self.r.randint(1, 8))) for _ in range(n))

    def sentences(self, n: int, own: bool) -> str:
        return " ".join(self.words(self.r.randint(4, 18), own) + self.r.choice("...?!:") for _ in range(n))

    def link(self, own: bool, n: int = 0) -> str:
        return f'<a href="/x">{self.words(n or self.r.randint(1, 4), own)}</a>'

    def named(self, names: str) -> str:
        """An attribute with one of the names (comma-separated), or with one that says nothing."""
        r = self.r.random()
        if r < 0.3:
            return self.r.choice(["", f' class="{self.r.choice(_PLAIN)}"'])
        name = self.r.choice(names.split(","))
        return f' id="{name}"' if r < 0.45 else f' class="{name}"' if r < 0.85 else f' class="{self.r.choice(_PLAIN)} {name}"'

    def links(self) -> str:
        form = self.r.randrange(3)
        own = [self.link(False) for _ in range(self.r.randint(2, 9))]
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>"
        return " | ".join(own) if form == 1 else "".join(f"<div>{x}</div>" for x in own)

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(2, False)}</h1>", f"<div>{self.words(3, False)}</div>", self.link(False)]) + self.r.choice(["", f"<p>{self.words(6, False)}</p>"])
        return f"<header>{inner}</header>" if self.r.random() < 0.5 else f"<div{self.named('header,masthead,site-header,topbar,banner')}>{inner}</div>"

    def nav(self) -> str:
        return f"<nav>{self.links()}</nav>" if self.r.random() < 0.5 else f"<div{self.named('menu,nav,navbar,main-menu,breadcrumbs,navigation')}>{self.links()}</div>"

    def notice(self) -> str:
        names = "cookie-banner,cookie-content,consent,newsletter-body,modal-text,popup,notice,alert,gdpr-text,subscribe-main,overlay"
        return f"<div{self.named(names)}><p>{self.sentences(self.r.randint(1, 2), False)}</p>{self.r.choice(['', '<button>' + self.words(1, False) + '</button>'])}</div>"

    def advert(self) -> str:
        text = self.sentences(1, False) if self.r.random() < 0.7 else self.link(False)
        return f"<div{self.named('ad,ads,advert,sponsored-post,promo,sponsor-content,advertisement')}>{self.r.choice([text, f'<p>{text}</p>'])}</div>"

    def form(self) -> str:
        return f"<form>{self.r.choice(['', f'<p>{self.sentences(1, False)}</p>'])}<label>{self.words(2, False)}</label><input><button>{self.words(1, False)}</button></form>"

    def side(self) -> str:
        inner = f"<h3>{self.words(2, False)}</h3>{self.links()}" + self.r.choice(["", f"<p>{self.sentences(1, False)}</p>"])
        return f"<aside>{inner}</aside>" if self.r.random() < 0.4 else f"<div{self.named('sidebar,related,widget,trending,popular-posts,recommended,rail')}>{inner}</div>"

    def comments(self) -> str:
        own = "".join(f"<{t}>{self.words(2, False)} <p>{self.sentences(self.r.randint(1, 4), False)}</p></{t}>" for t in [self.r.choice(["li", "div"])] for _ in range(self.r.randint(1, 5)))
        tag = self.r.choice(["div", "section"])
        return f'<{tag} {self.r.choice(["id", "class"])}="{self.r.choice(["comments", "comment-list", "replies", "disqus", "user-comments"])}"><h3>{self.words(2, False)}</h3>{own}</{tag}>'

    def footer(self) -> str:
        inner = self.r.choice([f"<p>{self.words(5, False)}</p>", self.links(), f"&copy; {self.words(4, False)}.", self.links() + f"<p>{self.sentences(1, False)}</p>"])
        return f"<footer>{inner}</footer>" if self.r.random() < 0.55 else f"<div{self.named('footer,foot,copyright,site-footer,legal')}>{inner}</div>"

    def body_part(self) -> str:
        r = self.r.random()
        p = f"<p>{self.sentences(self.r.randint(1, 6), True)}</p>"
        if r < 0.6:
            return p
        if r < 0.66:
            return f"<p>{self.words(self.r.randint(1, 5), True)}</p>"
        if r < 0.72:
            return f"<h2>{self.words(self.r.randint(1, 6), True)}</h2>{p}"
        if r < 0.79:
            return "<ul>" + "".join(f"<li>{self.words(self.r.randint(1, 12), True)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if r < 0.83:
            return f"<blockquote>{self.sentences(1, True)}</blockquote>"
        if r < 0.86:
            return "<table>" + "".join(f"<tr><td>{self.words(1, True)}</td><td>{self.words(2, True)}</td></tr>" for _ in range(3)) + "</table>"
        if r < 0.92:
            name = self.r.choice("legal,discussion,tagline legal,feedback,notice,disclaimer,alert,header,popular,copyright,form".split(","))
            return f'<section {self.r.choice(["id", "class"])}="{name}">{p}{self.r.choice(["", p])}</section>' if self.r.random() < 0.7 else f'<p class="{name}">{self.sentences(1, True)}</p>'
        if r < 0.95:
            return f"<p>{self.words(5, True)} {self.link(True)} {self.sentences(1, True)}</p>"
        inside = [f'<p class="share">{self.words(2, False)}</p>', f'<div class="related"><h4>{self.words(2, False)}</h4>{self.links()}</div>', f'<div class="ad">{self.sentences(1, False)}</div>', f'<div class="newsletter-signup"><p>{self.sentences(1, False)}</p></div>']
        return self.r.choice(inside) + p

    def article(self) -> str:
        parts = "".join(self.body_part() for _ in range(self.r.randint(1, 9)))
        head = self.r.choice([f"<h1>{self.words(self.r.randint(2, 9), True)}</h1>", f"<h2>{self.words(4, True)}</h2>", ""])
        head = f"<header>{head}</header>" if head and self.r.random() < 0.15 else head
        inner = head + parts + (self.comments() if self.r.random() < 0.12 else "")
        form = self.r.random()
        if form < 0.4:
            return f"<article>{inner}</article>"
        if form < 0.5:
            return f'<main>{self.r.choice(["", "<div>"])}{inner}</main>'
        return f"<div{self.named('content,post,post-content,entry,story,article-body,main-text')}>{inner}</div>"

    def page(self) -> str:
        if self.r.random() < 0.08:
            return self.r.choice([self.sentences(2, True), f"<p>{self.words(self.r.randint(2, 9), True)}</p>", f"<body><p>{self.sentences(1, True)}<p>{self.words(4, True)}</body>"])
        if self.r.random() < 0.06:  # nothing but what stands around an article
            return f"<body>{self.r.choice([self.nav, self.footer, self.side])()}{self.r.choice(['', self.notice(), self.footer()])}</body>"
        chance = lambda p, make: make() if self.r.random() < p else ""
        top = [self.header() if self.r.random() < 0.8 else "", chance(0.85, self.nav), chance(0.35, self.notice), chance(0.4, self.advert)]
        self.r.shuffle(top)
        middle = [self.article(), chance(0.5, self.side)]
        self.r.shuffle(middle)
        after = [chance(0.35, self.comments), chance(0.25, self.form), chance(0.25, self.advert), chance(0.2, self.notice), self.footer() if self.r.random() < 0.9 else ""]
        inner = "".join(middle)
        if self.r.random() < 0.4:
            inner = f'<div class="{self.r.choice([*_PLAIN, "with-sidebar", "main-wrap"])}">{inner}</div>'
        whole = "".join(top) + inner + "".join(after)
        if self.r.random() < 0.08:
            whole = f'<form method="post">{whole.replace("<form>", "<div>").replace("</form>", "</div>")}</form>'
        return f"<html><head><title>{self.words(3, False)}</title></head><body>{whole}</body></html>"


def page(seed: int) -> str:
    return _Writer(seed).page()
