"""Generated pages with known main text: what the extraction model is trained on.

A page is put together from a header, menus, notices, adverts, forms, sidebars, teasers, comments, a
footer and one article, in semantic elements, classed boxes, bare boxes or layout tables, with unclosed tags
and wrappers of any depth. ``data-mark`` tells main text (``in``) from the rest (``out``); the reader
hands it on, the features never see it. Words are random letters, so nothing is learnt from content.
"""

from __future__ import annotations

import random

#: Names that sites give to their boxes, by what the box holds.
NAMES = {
    "article": "article post entry content story text body main single post-content entry-content article-body story-body page-content mainContent main-text articleText rich-text prose field-body copy news-text".split(),
    "nav": "nav menu navigation navbar topnav main-menu site-nav breadcrumbs breadcrumb links pager pagination tabs toc-menu submenu".split(),
    "header": "header masthead site-header top branding banner topbar page-header logo hero-head".split(),
    "footer": "footer site-footer bottom colophon copyright legal footer-links imprint credits".split(),
    "aside": "sidebar aside widget secondary right-col side rail related recommended promo-box popular teaser most-read tagcloud archive trending".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo banner-ad adsbox ad-slot partner commercial outbrain taboola".split(),
    "notice": "cookie cookie-notice consent notice alert gdpr privacy-banner popup modal overlay message warning-box toast announcement paywall".split(),
    "form": "form login search newsletter subscribe signup contact-form searchbox register feedback poll survey".split(),
    "share": "share social share-bar sharing follow social-links tools actions print-mail buttons".split(),
    "comments": "comments comment-list commentlist responses discussion disqus replies user-comments reader-comments reviews comment-section thread".split(),
}
TAGS = {"article": ["article", "main", "section", "div"], "nav": ["nav", "menu", "ul"], "header": ["header"], "footer": ["footer"], "aside": ["aside"], "ad": ["div", "aside", "section"], "notice": ["div", "section", "dialog"], "form": ["form"], "share": ["div", "ul"], "comments": ["section", "div", "ol"]}
WRAPPERS = "page wrapper container wrap site outer inner layout row col grid app root columns".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.semantic = r.random() < 0.55  # how the site marks its parts
        self.named = r.random() < 0.75
        self.unclosed = r.random() < 0.2
        self.rate = r.choice([0.15, 0.4, 0.8])

    def word(self) -> str:
        r = self.r
        w = "".join(r.choice("aeiounrstlmdhcgbpéäöñ") for _ in range(max(1, int(r.gauss(5, 2.4)))))
        return w + (r.choice(["%%%", "***", "###", "$$$", "&amp;", "12", "-"]) if r.random() < 0.01 else "")

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(max(1, n)))

    def sentence(self) -> str:
        r, s = self.r, self.words(self.r.randrange(3, 26)).capitalize()
        if r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        if r.random() < 0.06:
            s = f'{s} <a href="/{self.word()}">{self.words(2)}</a> {self.words(4)}'
        if r.random() < 0.05:
            s = f"{s} <{(t := r.choice(['b', 'em', 'i', 'span', 'strong', 'code']))}>{self.words(2)}</{t}>"
        return s + r.choice("...!?:")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randrange(low, high + 1)))

    def link(self, n: int = 2) -> str:
        return f'<a href="/{self.word()}">{self.words(self.r.randrange(1, n + 1)).capitalize()}</a>'

    def attributes(self, kind: str | None, mark: str | None) -> str:
        r, out = self.r, ""
        if kind and self.named and r.random() < 0.9:
            name = r.choice(NAMES[kind]) if kind in NAMES else kind
            if r.random() < 0.2:
                name = f"{r.choice(['c', 'm', 'site', 'block', 'wp', 'td'])}-{name}"
            out += f' {r.choice(["class", "class", "id"])}="{name}{" " + self.word() if r.random() < 0.2 else ""}"'
        if mark:
            out += f' data-mark="{mark}"'
        return out

    def box(self, kind: str | None, inner: str, mark: str | None = None, tag: str | None = None) -> str:
        tag = tag or (self.r.choice(TAGS[kind]) if kind and self.semantic and self.r.random() < 0.85 else "div")
        if tag in ("ul", "ol", "menu") and "<li" not in inner:
            tag = "div"
        return f"<{tag}{self.attributes(kind, mark)}>{inner}</{tag}>"

    def paragraph(self, low: int = 1, high: int = 6) -> str:
        p = self.prose(low, high)
        if self.unclosed and self.r.random() < 0.4:
            return self.r.choice(["<p>", "<p><b>", "<p>"]) + p + self.r.choice(["", "<br>"])
        return f"<p>{p}</p>"

    def link_list(self, n: int, words: int = 2) -> str:
        r = self.r
        if r.random() < 0.7:
            t = r.choice(["ul", "ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{self.link(words)}</li>" for _ in range(n)) + f"</{t}>"
        return r.choice([" | ", " ", "<br>"]).join(self.link(words) for _ in range(n))

    def part(self, kind: str) -> str:
        """A block that is no main text."""
        r = self.r
        if kind == "nav":
            inner = self.link_list(r.randrange(2, 14))
        elif kind == "header":
            inner = r.choice([f"<h1>{self.words(2)}</h1>", f"<p>{self.words(3)}</p>", f"<h2>{self.link()}</h2>", f"<div>{self.words(2)}</div><p>{self.sentence()}</p>"]) + (self.part("nav") if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = f"&copy; {r.randrange(1990, 2030)} {self.words(2)} " + r.choice(["", f"&middot; {self.prose(1, 3)}", f"<p>{self.prose(1, 3)}</p>", self.link_list(r.randrange(2, 8))])
        elif kind == "aside":
            inner = "".join(f"<{(h := r.choice(['h2', 'h3', 'h4', 'p']))}>{self.words(2)}</{h}>" + r.choice([lambda: self.link_list(r.randrange(2, 9), 7), lambda: self.paragraph(1, 3), lambda: self.teasers(2)])() for _ in range(r.randrange(1, 4)))
        elif kind == "ad":
            inner = r.choice([lambda: self.prose(1, 3), lambda: self.link(5), lambda: f"<p>{self.sentence()}</p>{self.link(3)}", lambda: f"{self.words(1)} <img src=x>{self.words(3)}"])()
        elif kind == "notice":
            inner = r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>"]) + r.choice(["", "<button>ok</button>", f"<a href=#>{self.word()}</a>"])
        elif kind == "form":
            inner = r.choice(["", f"<h3>{self.words(3)}</h3>", f"<p>{self.prose(1, 2)}</p>"]) + "".join(f"<label>{self.words(2)}</label><input name=x>" for _ in range(r.randrange(1, 4))) + f"<button>{self.word()}</button>"
        elif kind == "share":
            inner = self.link_list(r.randrange(2, 6), 1)
        elif kind == "comments":
            each = lambda: r.choice(["<li>", "<div>", '<div class="comment">'] if self.named else ["<li>", "<div>"])
            inner = f"<h{(h := r.choice('234'))}>{self.words(2)}</h{h}>"
            for _ in range(r.randrange(1, 12)):
                t = each()
                who = r.choice([f"<b>{self.words(2)}</b> ", f"<p>{self.link(2)} {r.randrange(1, 30)}.{r.randrange(1, 12)}.</p>", f"<cite>{self.words(1)}</cite>: ", f"<h4>{self.words(2)}</h4>"])
                inner += t + who + r.choice([self.prose(1, 3), self.paragraph(1, 4)]) + r.choice(["", self.link(1)]) + ("</li>" if t == "<li>" else "</div>")
        else:
            raise ValueError(kind)
        tag = None
        if kind == "form" and r.random() < 0.8:
            tag = "form"
        hidden = ' style="display:none"' if r.random() < 0.03 else ""
        out = self.box(kind, inner, "out", tag)
        return out.replace(" data-mark", hidden + " data-mark", 1)

    def teasers(self, n: int) -> str:
        return "".join(f"<div><h3>{self.link(6)}</h3><p>{self.sentence()} {self.link(2)}</p></div>" for _ in range(n))

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.words(r.randrange(2, 12)).capitalize()}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.1:
            title = f"<header>{title}</header>"
        body: list[str] = []
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.7:
                body.append(self.paragraph(1, r.choice([1, 3, 6, 12])))
            elif kind < 0.78:
                body.append(f"<h{(h := r.choice('234'))}>{self.words(r.randrange(1, 8)).capitalize()}</h{h}>")
            elif kind < 0.85:
                body.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{r.choice([self.words(r.randrange(1, 9)), self.sentence()])}</li>" for _ in range(r.randrange(2, 7))) + f"</{t}>")
            elif kind < 0.9:
                body.append(f"<blockquote>{r.choice([self.prose(1, 3), self.paragraph(1, 3)])}</blockquote>")
            elif kind < 0.94:
                body.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(r.randrange(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randrange(1, 5))) + "</table>")
            elif kind < 0.97:
                body.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            else:
                body.append(r.choice([f"<pre>{self.words(12)}</pre>", self.prose(1, 5), f"<div>{self.prose(1, 4)}</div>"]))
        if not title and not body:
            body.append(self.paragraph(1, 3))
        for kind in ("ad", "share", "aside", "form", "notice", "nav", "ad"):
            if r.random() < self.rate * 0.25:
                body.insert(r.randrange(len(body) + 1), self.part(kind))
        if r.random() < self.rate * 0.2:
            body.append(self.part("comments"))
        if r.random() < self.rate * 0.15:
            body.append(self.box("footer" if r.random() < 0.5 else None, self.words(4) + " " + self.link(2), "out", "footer"))
        inner = title + "".join(body)
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = self.box(r.choice([None, "article"]), inner, None, "div")
        return self.box("article", inner, "in")

    def page(self) -> str:
        r = self.r
        some = lambda kind, p: [self.part(kind)] if r.random() < p else []
        top = some("notice", 0.3 * self.rate + 0.1) + some("header", 0.55) + some("nav", 0.75) + some("ad", 0.5) + some("form", 0.3 * self.rate) + some("nav", 0.2)
        if r.random() < 0.3:
            r.shuffle(top)
        left, right = some("aside", 0.25), some("aside", 0.4) + some("ad", 0.3 * self.rate)
        after = some("share", 0.3) + some("comments", 0.4) + (some("aside", 0.3)) + some("form", 0.25) + some("ad", 0.2)
        if r.random() < 0.15:
            after.append(self.box("aside", self.teasers(r.randrange(2, 6)), "out"))
        end = some("footer", 0.8) + some("notice", 0.2) + some("nav", 0.15)
        article = self.article()
        if r.random() < 0.08:  # a layout table
            cells = "".join(f"<td valign=top>{c}</td>" for c in (["".join(left) or self.part("nav")] + [article + "".join(after)] + (["".join(right)] if right else [])))
            middle = f"<table width=100%><tr>{cells}</tr></table>"
        else:
            centre = article + "".join(after)
            if r.random() < 0.4:
                centre = self.box(r.choice([None, r.choice(WRAPPERS), "article"]), centre, "out", r.choice(["div", "main", "section"]) if self.semantic else "div").replace(article, article, 1)
            middle = "".join(left) + centre + "".join(right)
            if r.random() < 0.5:
                middle = self.box(r.choice(WRAPPERS) if r.random() < 0.7 else None, middle, "out", "div")
        body = "".join(top) + middle + "".join(end)
        if r.random() < 0.05:  # one form around the page
            body = f"<form{self.attributes(r.choice([None, 'page']), 'out')}>{body}</form>"
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            body = self.box(r.choice(WRAPPERS) if r.random() < 0.7 else None, body, "out", "div")
        head = f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>"
        tail = r.choice(["</body></html>", "", "</body></html>"])
        return f"{head}<body>{r.choice(['', '<!-- note -->'])}{body}{tail}"


def pages(count: int, seed: int = 11) -> list[str]:
    return [Writer(seed * 1_000_003 + i).page() for i in range(count)]
