"""Labelled pages for training: layouts whose parts are known because they are built here.

Every page deals its furniture (menus, headers, notices, adverts, side columns, forms, comments, footers) around and into an article,
in one of several markups: elements of their own, containers with telling names, or containers with names that tell
nothing.  The attribute ``data-label`` says which part is the article; features never look at it.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ber ci do en fal ga her in jo kel la men nor os pal qui ren sol ta un ver wi xa yor zen tion ment ed ing able ly".split()

# What each kind of part may be called; the second half of every list is kept for held-out pages.
NAMES = {
    "nav": ["menu", "navbar", "main-nav", "breadcrumbs", "nav-links", "navigation", "top_menu", "pagination"],
    "header": ["header", "masthead", "site-header", "page-header", "logo", "topHeader", "branding", "banner"],
    "footer": ["footer", "site-footer", "copyright", "foot", "legal", "page_footer", "colophon", "footerLinks"],
    "side": ["sidebar", "side-column", "widget", "right-rail", "aside", "sideBar", "widgets", "secondary"],
    "ad": ["ad", "advert", "ad-slot", "sponsored", "promo", "advertisement", "ads", "promoted-box"],
    "notice": ["cookie-notice", "notice", "consent", "alert", "gdpr-popup", "cookies", "notification", "privacy-overlay"],
    "comments": ["comments", "comment-list", "replies", "discussion", "responses", "commentSection", "reader-comments", "thread"],
    "form": ["newsletter", "subscribe", "search-form", "login", "contact", "signup", "poll", "search"],
    "related": ["related", "share", "author", "tags", "more-stories", "social", "byline", "recommended"],
    "main": ["content", "post", "article-body", "entry", "story", "main-content", "post_body", "articleText"],
}
ELEMENTS = {
    "nav": "nav", "header": "header", "footer": "footer", "side": "aside", "ad": "aside", "notice": "section", "comments": "section",
    "form": "form", "related": "section", "main": "article",
}


class _Page:
    def __init__(self, seed: int, held_out: bool):
        self.r = random.Random(f"{held_out}-{seed}")
        self.held_out = held_out
        # How this page marks its parts.
        self.style = self.r.choice(("elements", "names", "both", "both", "plain"))

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3)))) for _ in range(n))

    def sentence(self, least: int = 1, most: int = 25) -> str:
        text = self.words(self.r.randint(least, most))
        if self.chance(0.4):
            text = text.replace(" ", ", ", 1)
        return text.capitalize() + self.r.choice("....?!")

    def prose(self, most: int = 8) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, most))))
        if self.chance(0.15):
            words = text.split()
            text = " ".join(w + self.r.choice(("", "", "%%%", "&amp;&amp;", "###", " | ", " 20" + str(self.r.randint(10, 30)))) for w in words)
        return text

    def part(self, kind: str, inner: str, main: bool = False) -> str:
        names = NAMES[kind]
        half = len(names) // 2
        name = self.r.choice(names[half:] if self.held_out and kind != "ad" else names[:half] if not self.held_out else names)
        tag, attributes = "div", ""
        if self.style in ("elements", "both") and not (kind in ("notice", "related") and self.chance(0.5)):
            tag = ELEMENTS[kind]
        if self.style in ("names", "both") or tag in ("section", "div") and self.style == "elements" or (tag == "aside" and kind == "ad"):
            attributes = self.r.choice((f' class="{name}"', f' id="{name}"', f' class="x{self.r.randint(1, 99)} {name}"'))
        if self.style == "plain" and kind in ("nav", "footer", "ad", "comments", "notice", "side", "form"):
            # A page that gives no names: only what the parts look like tells them apart.
            tag = {"nav": "ul", "form": "form"}.get(kind, tag)
            if kind in ("ad", "comments", "notice", "side"):
                attributes = f' class="{name}"'
        return f'<{tag}{attributes} data-label="{int(main)}">{inner}</{tag}>'

    def links(self, n: int, wrap: str = "li") -> str:
        one = lambda: f'<a href="/{self.r.randint(1, 999)}">{self.words(self.r.choice((1, 1, 2, 3))).capitalize()}{"." if self.chance(0.1) else ""}</a>'
        if wrap == "li":
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", " &raquo; ")).join(one() for _ in range(n))

    def nav(self) -> str:
        return self.part("nav", self.links(self.r.randint(2, 9), self.r.choice(("li", "li", "in"))))

    def header(self) -> str:
        return self.part("header", self.r.choice(("<a href='/'>{}</a>", "<h1>{}</h1>", "<h1><a href='/'>{}</a></h1>")).format(self.words(2)) + (f"<p>{self.sentence(2, 8)}</p>" if self.chance(0.5) else "") + (self.nav() if self.chance(0.4) else ""))

    def footer(self) -> str:
        rights = self.r.choice(("&copy; ", "Copyright ", "&copy; 20" + str(self.r.randint(10, 30)) + " ", ""))
        inner = f"{rights}{self.words(1)}.example.com" + self.r.choice((" &middot; ", " - ", "<br>", " | ")) + self.sentence(1, 12)
        return self.part("footer", inner + (self.links(self.r.randint(2, 5), self.r.choice(("li", "in"))) if self.chance(0.4) else ""))

    def side(self) -> str:
        inner = "".join(
            self.r.choice((f"<h3>{self.words(2).capitalize()}</h3>", f"<p>{self.prose(2)}</p>", self.links(4))) for _ in range(self.r.randint(1, 4)))
        return self.part("side", inner)

    def ad(self) -> str:
        inner = self.r.choice((self.sentence(), self.prose(3), f"<a href='//ad'>{self.sentence(2, 9)}</a>", f"<p>{self.sentence(3)}</p>"))
        return self.part("ad", inner)

    def notice(self) -> str:
        what = self.r.choice(("We use cookies to", "This site uses cookies and", "Please accept our privacy", "", ""))
        return self.part("notice", f"<p>{what} {self.sentence(4)}</p><button>{self.words(1)}</button>")

    def form(self) -> str:
        what = self.r.choice(("Subscribe to our newsletter", "Sign up", "Search", self.sentence(2, 9)))
        inner = f"<label>{what}</label><input name=q><button>{self.words(1)}</button>"
        return self.part("form", inner if self.style != "names" else f"<form>{inner}</form>")

    def comments(self) -> str:
        one = lambda: self.r.choice((
            "<div class='comment'><b>{n}</b><p>{t}</p></div>", "<li><span>{n}</span> <p>{t}</p></li>", "<article class='comment'><h4>{n}</h4><p>{t}</p></article>",
            "<div><p>{t}</p><small>{n}</small></div>")).format(n=self.words(1).capitalize(), t=self.prose(4))
        head = f"<h3>{self.r.choice(('Comments', self.words(2).capitalize(), '3 comments'))}</h3>" if self.chance(0.6) else ""
        return self.part("comments", head + "".join(one() for _ in range(self.r.randint(1, 6))))

    def related(self) -> str:
        return self.part("related", self.r.choice((
            self.links(4), f"<h3>{self.words(2)}</h3>" + self.links(3), self.links(3, "in"), f"<p>By {self.words(2)}</p>")))

    def article(self) -> str:
        title = self.r.choice((self.sentence(2, 12), self.words(self.r.randint(1, 10)).capitalize(), self.prose(1)))
        parts = [f"<h1>{title}</h1>"] if self.chance(0.85) else []
        if self.chance(0.15):
            # An article's own head stands in the article.
            parts = [f"<header><h1>{title}</h1>" + (f"<p>{self.sentence(2, 12)}</p>" if self.chance(0.6) else "") + "</header>"]
        inside = [self.ad, self.related, self.form, self.notice] if self.style != "plain" else [self.ad]
        for _ in range(self.r.choice((1, 2, 4, 7, 12))):
            text = self.prose()
            parts.append(self.r.choices((
                f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}<p>{self.prose(2)}", f"<h2>{self.words(3).capitalize()}</h2><p>{text}</p>",
                "<ul>" + "".join(f"<li>{self.sentence(1, 12)}</li>" for _ in range(3)) + "</ul>", f"<blockquote><p>{text}</p></blockquote>",
                f"<table><tr><td>{self.words(2)}</td><td>{self.r.randint(1, 999)}</td></tr></table>", f"<pre>{self.words(6)}</pre>",
                f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>", f"<div>{text}</div>",
                f"<section><h2>{self.words(3)}</h2><p>{text}</p><p>{self.prose(3)}</p></section>",
                f"<p>{self.sentence()} <a href='/x'>{self.words(2)}</a> {self.sentence()}</p>", f"<p><a href='/x'>{self.sentence(2)}</a></p>",
            ), (30, 10, 8, 6, 4, 3, 2, 1, 2, 5, 3, 5, 1))[0])
            if self.chance(0.2):
                parts.append(self.r.choice(inside)())
        if self.style != "plain" and self.chance(0.2):
            parts.append(self.comments())
        if self.style != "plain" and self.chance(0.15):
            parts.append(self.related())
        return "".join(parts)

    def page(self) -> str:
        if self.chance(0.06):
            # No container at all, or not even a tag.
            inner = self.article() if self.chance(0.6) else self.prose()
            return f'<body data-label="1">{inner}' + (self.footer() if self.chance(0.3) else "")
        main = self.part("main", self.article(), main=True)
        if self.style in ("elements", "both") and self.chance(0.3):
            main = f"<main>{main}</main>"
        some = lambda *kinds: "".join(k() for k in kinds if self.chance(0.5))
        head = f"<head><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        before = some(self.header, self.nav, self.notice, self.ad, self.form, self.side)
        after = some(self.ad, self.related, self.comments, self.side, self.form, self.nav, self.footer, self.notice)
        if self.style == "plain":
            before, after = some(self.nav, self.ad, self.notice), some(self.comments, self.ad, self.footer, self.side)
        return f"<!DOCTYPE html><html>{head}<body>{before}{main}{after}" + ("</body></html>" if self.chance(0.9) else "")


def labelled_page(seed: int, held_out: bool = False) -> str:
    """One page; the same for the same seed.  Held-out pages call their parts by names no training page uses."""
    return _Page(seed, held_out).page()
