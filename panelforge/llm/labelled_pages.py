"""Pages with labels to train the extraction model on: every element says whether its own text is the article's.

The pages are drawn from a small grammar of layouts, tag soup included. Labels stand in the attribute data-article."""

from __future__ import annotations

import random

NAV = "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs links tabs pagination pager toc".split()
SIDE = "sidebar side aside widget related recommended trending popular tags categories archive recent promo rail".split()
ADS = "ad ads advert advertisement sponsor sponsored banner promo adslot ad-container promotion".split()
NOTICE = "cookie cookies consent notice alert popup modal newsletter subscribe signup gdpr overlay message privacy paywall".split()
COMMENTS = "comments comment replies reply disqus discussion responses commentlist respond thread".split()
FOOT = "footer foot copyright legal bottom colophon site-footer".split()
HEAD = "header masthead site-header top branding logo topbar".split()
SHARE = "share social sharing buttons follow toolbar tools meta byline-links".split()
MAIN = "article content main post entry story body text article-body post-content entry-content story-body main-content page-content".split()
WORDS = "on the of and a in to is it that for was are with be this by from der die und das en le la les des un une el los que con por".split()


class Pages:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = [r.choice(WORDS) if r.random() < 0.35 else "".join(r.choice(["er", "in", "th", "on", "an", "re", "es", "ou", "ti", "st", "lo", "ka"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(out)
        for _ in range(len(out) // 9):
            k = text.find(" ", r.randrange(len(text)))
            if k > 0:
                text = text[:k] + r.choice([". ", ", "]) + text[k + 1 :]
        return text.capitalize() + r.choice([".", ".", "", "!", " &amp;&amp;&amp;", "&hellip;"])

    def el(self, tag: str, label: int, inside: str, names: list[str] | None = None, close: bool = True) -> str:
        r, attr = self.r, ""
        if names and r.random() < 0.85:
            name = r.choice(names)
            name = r.choice([name, name, f"{name}-{r.choice(['wrap', 'box', 'inner', 'list', 'block', '1'])}", f"{r.choice(['site', 'page', 'l', 'js', 'main'])}-{name}"])
            attr = f' {r.choice(["class", "class", "id"])}="{name}"'
        return f'<{tag}{attr} data-article="{label}">{inside}' + (f"</{tag}>" if close else "")

    def anchors(self, count: int, low: int = 1, high: int = 3) -> list[str]:
        return [f'<a href="/{i}">{self.words(low, high)}</a>' for i in range(count)]

    def menu(self, names: list[str], tag: str) -> str:
        r = self.r
        links = self.anchors(r.randint(2, 9))
        if r.random() < 0.75:
            inside = self.el("ul", 0, "".join(self.el("li", 0, a, close=r.random() < 0.8) for a in links))
        else:
            inside = r.choice([" | ", " ", " &middot; "]).join(links)
        return self.el(tag, 0, inside, names if tag != "nav" or r.random() < 0.5 else None)

    def paragraph(self, label: int) -> str:
        r = self.r
        text = self.words(1, 90) if r.random() < 0.75 else self.words(1, 8)
        if r.random() < 0.2:
            text = text.replace(" ", f' <a href="#">{self.words(1, 2)}</a> ', 1)
        if r.random() < 0.15:
            return self.el("p", label, f"<b>{text}<br>", close=False)
        if r.random() < 0.1:
            text = f"<{(t := r.choice(['b', 'em', 'strong', 'span']))}>{text}</{t}>"
        return self.el("p", label, text, close=r.random() < 0.8)

    def article_parts(self) -> list[str]:
        r = self.r
        out = [self.el(r.choice(["h1", "h1", "h2"]), 1, self.words(1, 12))] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 4, 8, 15, 15, 40, 90])):
            kind = r.random()
            if kind < 0.72:
                out.append(self.paragraph(1))
            elif kind < 0.78:
                out.append(self.el(r.choice(["h2", "h3"]), 1, self.words(1, 7)))
            elif kind < 0.84:
                out.append(self.el(r.choice(["ul", "ol"]), 1, "".join(self.el("li", 1, self.words(1, 25), close=r.random() < 0.7) for _ in range(r.randint(1, 6)))))
            elif kind < 0.88:
                out.append(self.el("blockquote", 1, self.paragraph(1)))
            elif kind < 0.90:
                out.append(self.el("pre", 1, self.words(3, 30)))
            elif kind < 0.92:
                out.append(self.el("table", 1, self.el("tr", 1, self.el("td", 1, self.words(1, 6)) + self.el("td", 1, self.words(1, 6)))))
            elif kind < 0.94:
                out.append(self.el("figure", 1, '<img src="x.png">' + self.el("figcaption", 1, self.words(3, 12))))
            elif kind < 0.96:
                out.append(self.el("div", 1, self.words(4, 60), r.choice([None, ["text", "para", "section", "intro", "lead"]])))
            else:
                out.append(self.boilerplate(inner=True))
        return out

    def boilerplate(self, inner: bool = False) -> str:
        r = self.r
        kind = r.choice(["ad", "ad", "notice", "share", "side"] if inner else ["ad", "ad", "notice", "side", "form", "comments", "share", "menu"])
        if kind == "ad":
            return self.el(r.choice(["div", "div", "aside", "section"]), 0, r.choice([self.words(2, 14), self.el("p", 0, self.words(2, 14)), f'<a href="/x">{self.words(2, 8)}</a>']), ADS)
        if kind == "notice":
            return self.el(r.choice(["div", "section", "aside"]), 0, self.el("p", 0, self.words(4, 30)) + "<button>OK</button>" if r.random() < 0.6 else self.words(4, 30), NOTICE)
        if kind == "share":
            return self.el(r.choice(["div", "ul"]), 0, "".join(self.anchors(r.randint(2, 5), 1, 1)), SHARE)
        if kind == "side":
            if inner:
                return self.el("aside", 0, self.el("p", 0, self.words(3, 25)), SIDE)
            return self.el(r.choice(["aside", "div", "section"]), 0, self.el(r.choice(["h2", "h3", "h4"]), 0, self.words(1, 4)) + (self.menu(SIDE, "div") if r.random() < 0.6 else self.el("p", 0, self.words(3, 40))), SIDE)
        if kind == "form":
            return self.el("form", 0, r.choice([self.el("p", 0, self.words(2, 12)), f"<label>{self.words(1, 4)}</label>"]) + f'<input name="q"><button>{self.words(1, 2)}</button>', ["search", "login", "contact", "subscribe"])
        if kind == "comments":
            one = lambda: self.el(r.choice(["div", "li", "div", "li", "article"]), 0, self.el(r.choice(["span", "b", "h4"]), 0, self.words(1, 2)) + self.el("p", 0, self.words(3, 60)), COMMENTS)
            return self.el(r.choice(["section", "div", "ol"]), 0, self.el("h3", 0, self.words(1, 3)) + "".join(one() for _ in range(r.randint(1, 6))), COMMENTS)
        return self.menu(NAV, r.choice(["nav", "div"]))

    def page(self) -> str:
        r = self.r
        before = []
        if r.random() < 0.45:
            logo = r.choice([self.el("div", 0, self.words(1, 4), HEAD), self.el("p", 0, self.words(1, 6)), f'<a href="/">{self.words(1, 3)}</a>', self.el(r.choice(["h1", "h2"]), 0, self.words(1, 4))])
            before.append(self.el(r.choice(["header", "header", "div"]), 0, logo + (self.menu(NAV, r.choice(["nav", "div"])) if r.random() < 0.6 else ""), HEAD))
        if r.random() < 0.7:
            before.append(self.menu(NAV, r.choice(["nav", "nav", "div", "ul"]) if r.random() < 0.9 else "div"))
        before += [self.boilerplate() for _ in range(r.choice([0, 0, 1, 1, 2]))]
        parts = self.article_parts()
        if r.random() < 0.08:  # a bare fragment
            return "".join(parts) if r.random() < 0.5 else f'<html><body data-article="0">{"".join(parts)}</body></html>'
        style = r.random()
        if style < 0.5:
            core = self.el("article", 1, "".join(parts), MAIN if r.random() < 0.4 else None)
        elif style < 0.85:
            core = self.el(r.choice(["div", "section", "main"]), 1, "".join(parts), MAIN)
        elif style < 0.95:
            core = self.el("article", 1, self.el("header", 1, parts[0]) + self.el("div", 1, "".join(parts[1:]), MAIN))
        else:
            core = "".join(parts)
        if r.random() < 0.35:
            core = self.el(r.choice(["main", "div"]), 0, core + (self.boilerplate() if r.random() < 0.4 else ""), ["wrapper", "container", "page", "layout", "main", "row", "col"])
        after = [self.boilerplate() for _ in range(r.choice([0, 0, 1, 1, 2]))]
        if r.random() < 0.85:
            foot = f"&copy; {self.words(1, 3)} &middot; {self.words(2, 12)}" if r.random() < 0.6 else self.el("p", 0, self.words(2, 20)) + self.menu(FOOT, "div")
            after.append(self.el("footer" if r.random() < 0.75 else "div", 0, foot, FOOT))
        return f'<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title></head><body data-article="0">{"".join(before)}{core}{"".join(after)}</body></html>'


def labelled_pages(count: int = 400, seed: int = 11) -> list[str]:
    pages = Pages(seed)
    return [pages.page() for _ in range(count)]
