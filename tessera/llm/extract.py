"""Main text of web pages as the maximum-scoring subsequence of tokens.

A page is a sequence of words and tags.  Elements that say what they are by
their name or by words of class, id and role are judged by a logistic model;
those of menus, adverts, comments and the like leave the sequence with all
that they hold.  Of what is left, words of content score positive, other
words and all tags negative, and a linear scan finds the contiguous region
with the best sum.  Both models are trained on the labelled pages below.
"""

from __future__ import annotations

import html as _html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_texts

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is never text of the page.
_RAW = {"script", "style", "noscript", "template", "svg", "textarea", "select", "title", "iframe", "object", "canvas", "audio", "video", "head", "button", "datalist"}
#: Those of them that go on to the end of the page when nothing closes them.
_TO_END = {"script", "style", "textarea", "title", "iframe"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: Elements that part blocks; all others are within a line.
_BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose name tells their role.
_MARKS = {"article", "aside", "dialog", "footer", "form", "header", "main", "menu", "nav", "search", "section"}
#: Closed by the start of another of these.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: What an end tag or a start that closes may pass on its way up: other
#: elements keep what stands outside them open.
_WALLS = {"table", "td", "th", "ul", "ol", "div", "section", "article", "aside", "main", "body"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Logits: below which an element is not content, above which it surely is,
#: and of an element whose names say nothing.
_OUT, _IN, _KEEP = 0.0, 1.5, 0.5


class Page:
    """The tokens of a page and its elements, in one pass; the work for a
    tag does not depend on its depth."""

    def __init__(self, html: str):
        #: kind (word, tag), text or tag name, element, whether in a link
        self.runs: list[tuple[str, str, int, bool]] = []
        self.parent, self.name, self.hints = [-1], [""], [()]
        self.holds = [False]  # an article or a main part
        self.closed = [True]
        stack, open_ = [0], {}
        links = 0
        at, end = 0, len(html)

        def close(upto: int) -> None:
            nonlocal links
            while len(stack) > upto:
                e = stack.pop()
                open_[self.name[e]] -= 1
                links -= self.name[e] == "a"

        def text(a: int, b: int) -> None:
            if b > a:
                self.runs.append(("word", html[a:b], stack[-1], links > 0))

        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                text(at, end)
                break
            two = html[lt + 1 : lt + 2]
            if two in ("!", "?"):
                text(at, lt)
                if html.startswith("<!--", lt):
                    stop = html.find("-->", lt + 2)  # <!--> is a whole comment
                    at = end if stop < 0 else stop + 3
                elif html.startswith("<![CDATA[", lt):
                    stop = html.find("]]>", lt)
                    at = end if stop < 0 else stop + 3
                else:
                    stop = html.find(">", lt)
                    at = end if stop < 0 else stop + 1
                continue
            if not (two.isalpha() and two.isascii() or two == "/" and html[lt + 2 : lt + 3].isalpha()):
                text(at, lt + 1)
                at = lt + 1
                continue
            stop = html.find(">", lt)
            if stop < 0:  # no tag ends any more: all of it is text
                text(at, end)
                break
            m = _TAG.match(html, lt)
            # Quotes that nothing closes do not swallow the page.
            slash, name, attrs = (m[1], m[2].lower(), m[3]) if m else (two * (two == "/"), re.match(r"</?([^\s/>]*)", html[lt : stop + 1])[1].lower(), html[lt + 1 : stop])
            text(at, lt)
            at = m.end() if m else stop + 1
            if slash:
                if open_.get(name):
                    k = len(stack) - 1
                    while self.name[stack[k]] != name:
                        k -= 1
                    self.runs.append(("tag", name, stack[k], links > 0))
                    self.closed[stack[k]] = True
                    close(k)
                elif name == "p" or name == "br":
                    self.runs.append(("tag", "br", stack[-1], links > 0))
                continue
            if name in _RAW and not attrs.endswith("/"):
                again = "" if name in _TO_END or name == "head" else rf"|<{re.escape(name)}(?=[\s/>])"
                found = re.compile(rf"</{re.escape(name)}\s*>{again}", re.I).search(html, at)
                if found and found[0][1] != "/":  # another begins: what stands between is not lost
                    found = None
                if found or name in _TO_END:  # others that nothing closes are ordinary
                    at = found.end() if found else end
                    self.runs.append(("tag", name, stack[-1], links > 0))
                    continue
                if name == "head":
                    continue
            if name in _ENDS_P and open_.get("p"):
                self._implied(stack, {"p"}, close)
            elif name in _CLOSES:
                self._implied(stack, _CLOSES[name], close)
            parent = stack[-1]
            if name in _VOID or attrs.endswith("/") and name not in _BLOCK:
                self.runs.append(("tag", name, parent, links > 0))
                continue
            e = len(self.name)
            self.parent.append(parent)
            self.name.append(name)
            own = dict.fromkeys(w.lower() for _, v in _ATTR.findall(attrs) for w in _HINT.findall(v)) if attrs else ()
            self.hints.append(tuple(w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w for w in own))
            self.holds.append(False)
            self.closed.append(False)
            self.runs.append(("tag", name, e, links > 0))
            stack.append(e)
            open_[name] = open_.get(name, 0) + 1
            links += name == "a"
        for e in range(len(self.name) - 1, 0, -1):
            if self.holds[e] or self.name[e] in ("article", "main") and not {"comment", "reply", "response"} & set(self.hints[e]):
                self.holds[self.parent[e]] = True

    def _implied(self, stack: list[int], names: set[str], close) -> None:
        """Closes an element of these names that is open within the wall."""
        for k in range(len(stack) - 1, 0, -1):
            name = self.name[stack[k]]
            if name in names:
                self.closed[stack[k]] = True
                close(k)
                return
            if name in _WALLS:
                return


def _own(page: Page, e: int, inside: bool) -> list[str]:
    """Features by which an element says what it is."""
    name = page.name[e]
    own = [f"t:{name}"] * (name in _MARKS) + [f"h:{w}" for w in page.hints[e]]
    return own + [f"{x}|{'in' if inside else 'out'}" for x in own]


#: Classes and ids of the labelled pages, by what the elements hold.
_CONTENT_NAMES = ["content", "post", "entry", "article", "story", "main", "post content", "entry content", "article body", "story body", "main content", "page content", "body text", "blog post", "news item", "single post", "hentry", "markdown body", "text", "prose", "field body", "mw content", "post body", "rich text", "article text", "post wrapper"]
_HEAD_NAMES = ["post header", "entry header", "article header", "entry title", "post title", "article title", "story header", "post meta", "entry meta", "byline", "author", "lead", "summary", "headline", "title", "dateline", "subtitle", "caption", "figure", "quote", "pullquote", "note", "footnotes", "references", "abstract", "introduction", "code block", "highlight", "table wrapper", "section", "chapter", "paragraph"]
_OTHER_NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "top nav", "main menu", "site nav", "nav bar", "primary nav", "breadcrumb", "breadcrumbs", "pagination", "pager", "skip link", "sub menu", "toolbar", "topbar", "tabs nav", "toc", "site map"],
    "header": ["site header", "page header top", "masthead", "header", "top header", "logo", "branding", "site title", "site branding", "global header", "hero banner"],
    "footer": ["footer", "site footer", "page footer", "footer widgets", "copyright", "legal", "colophon", "credits", "imprint", "contentinfo"],
    "side": ["sidebar", "side bar", "aside", "widget", "widget area", "right rail", "rail", "complementary", "secondary", "tag cloud", "archive list", "recent posts", "popular posts", "blogroll"],
    "advert": ["ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsored", "sponsor", "promo", "promotion", "promoted", "banner", "ad slot", "ad container", "dfp", "outbrain", "taboola", "commercial", "affiliate", "partner offer", "marketing", "teaser promo", "upsell", "paid content", "call action cta"],
    "notice": ["cookie", "cookie notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "announcement", "cookie banner", "paywall", "privacy notice", "warning bar", "toast", "interstitial", "notification"],
    "form": ["form", "search", "search form", "login", "signup", "sign in", "newsletter", "subscribe", "subscription", "contact form", "mailing list", "register", "poll", "survey"],
    "comments": ["comments", "comment", "comment list", "comments area", "commentlist", "discussion", "respond", "reply", "replies", "reply list", "reader responses", "responses", "reader comments", "disqus thread", "user reviews", "feedback", "talkback", "reader letters", "thread", "conversation", "fb comments", "guestbook", "commentary reader"],
    "social": ["share", "social", "sharing", "social links", "share buttons", "follow us", "addthis", "related", "related posts", "recommended", "recommendations", "read more next", "more stories", "you may like", "trending", "most read", "tags", "tag list", "author bio box", "print links", "related articles"],
}


def _labelled(n: int = 600, seed: int = 5) -> list[str]:
    """Pages whose words of content begin with U+0001."""
    rng = random.Random(seed)

    def words(k: int, mark: bool) -> str:
        return " ".join(("\x01" if mark else "") + f"w{i}" for i in range(k))

    c, o = (lambda k: words(k, True)), (lambda k: words(k, False))
    tag = lambda name: (lambda a: f"{a}" + "".join(rng.choice((" x", " js", " main2")) for _ in range(rng.randrange(2))))(name).replace(" ", rng.choice(" -_"))

    def named(element: str, name: str, inner: str) -> str:
        at = rng.choice(("class", "class", "id"))
        return f"<{element} {at}='{tag(name)}'>{inner}</{element}>"

    def links(k: int, mark: bool = False, wrap: str | None = None) -> str:
        one = [f"<a href=/{i}>{words(rng.randint(1, 3), mark)}</a>" for i in range(k)]
        wrap = wrap or rng.choice(("ul", "div", "p"))
        return f"<ul>{''.join(f'<li>{x}</li>' for x in one)}</ul>" if wrap == "ul" else f"<{wrap}>{rng.choice((' ', ' | ', ', ')).join(one)}</{wrap}>"

    def other(kind: str, within: bool) -> str:
        name = rng.choice(_OTHER_NAMES[kind])
        said = "".join(f"<p>{o(rng.randint(4, 40))}</p>" for _ in range(rng.randint(1, 4)))
        if kind == "menu":
            return rng.choice((named("div", name, links(rng.randint(3, 9))), named("nav", name, links(rng.randint(3, 9))), f"<nav>{rng.choice((o(3), links(rng.randint(3, 9))))}</nav>", named("ul", name, "".join(f"<li><a href=x>{o(1)}</a></li>" for _ in range(5)))))
        if kind == "header":
            inner = f"<h1>{o(2)}</h1><p>{o(rng.randint(2, 9))}</p>" + rng.choice(("", links(4)))
            return named("div", name, inner) if within or rng.random() < 0.5 else rng.choice((named("header", name, inner), f"<header>{inner}</header>"))
        if kind == "footer":
            inner = rng.choice((o(8), f"<p>{o(12)}</p>", links(5) + f"<p>{o(6)}</p>"))
            return rng.choice((named("div", name, inner), named("footer", name, inner), f"<footer>{inner}</footer>"))
        if kind == "side":
            inner = f"<h3>{o(2)}</h3>" + rng.choice((links(5), said))
            return rng.choice((named("div", name, inner), named("aside", name, inner), f"<aside>{inner}</aside>"))
        if kind == "notice":
            return rng.choice((named("div", name, said), named("section", name, said), f"<dialog open>{said}</dialog>"))
        if kind == "form":
            inner = f"<label>{o(2)}</label><input><p>{o(9)}</p>"
            return rng.choice((named("div", name, inner), named("form", name, inner), f"<form>{inner}</form>", f"<search>{inner}</search>"))
        if kind == "comments":
            inner = f"<h3>{o(1)}</h3>" + "".join(named("div", rng.choice(("comment", "reply", "response", "comment body")), f"<p>{o(rng.randint(5, 60))}</p>") for _ in range(rng.randint(1, 4)))
            inner = rng.choice((inner, said, inner.replace("<div", "<article").replace("</div", "</article")))
            return rng.choice((named("div", name, inner), named("section", name, inner), named("ol", name, f"<li>{said}</li>")))
        if kind == "social":
            return rng.choice((named("div", name, links(5)), named("section", name, f"<h3>{o(2)}</h3>" + links(4)), named("ul", name, f"<li><a>{o(2)}</a></li>" * 4)))
        return rng.choice((named("div", name, said), named("section", name, said), named("div", name, o(9)), named("aside", name, said)))

    def piece() -> str:
        """A part of an article."""
        return rng.choice(
            (
                lambda: f"<p>{c(rng.randint(8, 60))}</p>",
                lambda: f"<p>{c(rng.randint(8, 60))}</p>",
                lambda: f"<p>{c(20)} <a href=x>{c(2)}</a> {c(9)}</p>",
                lambda: f"<p>{c(rng.randint(1, 5))}</p>",
                lambda: f"<{(h := rng.choice(('h2', 'h3', 'h4')))}>{c(rng.randint(1, 6))}</{h}><p>{c(25)}</p>",
                lambda: f"<ul>{''.join(f'<li>{c(rng.randint(2, 12))}</li>' for _ in range(4))}</ul>",
                lambda: f"<ol>{''.join(f'<li><a href=x>{c(3)}</a> {c(5)}</li>' for _ in range(3))}</ol>",
                lambda: f"<blockquote><p>{c(14)}</p></blockquote>",
                lambda: f"<table><tr><th>{c(1)}</th><th>{c(2)}</th></tr><tr><td>{c(2)}</td><td>{c(3)}</td></tr></table>",
                lambda: f"<pre><code>{c(8)}</code></pre>",
                lambda: f"<figure><img><figcaption>{c(6)}</figcaption></figure>",
                lambda: f"<dl><dt>{c(2)}</dt><dd>{c(9)}</dd></dl>",
                lambda: named(rng.choice(("div", "section", "p")), rng.choice(_HEAD_NAMES), rng.choice((c(20), f"<p>{c(20)}</p>"))),
                lambda: f"<section><h2>{c(3)}</h2><p>{c(30)}</p></section>",
                lambda: f"<div>{c(30)}</div>",
                lambda: f"{c(40)}<br><br>{c(30)}",
            )
        )()

    heads = (lambda t: f"<h1>{t}</h1>", lambda t: f"<header><h1>{t}</h1></header>", lambda t: f"<header><h1>{t}</h1><p>{c(4)}</p></header>", lambda t: named("div", rng.choice(_HEAD_NAMES), f"<h1>{t}</h1>"), lambda t: named("header", rng.choice(_HEAD_NAMES[:8]), f"<h1>{t}</h1><p>{c(3)}</p>"), lambda t: t, lambda t: "")
    whole = (
        lambda x: f"<article>{x}</article>",
        lambda x: f"<main><article>{x}</article></main>",
        lambda x: f"<main>{x}</main>",
        lambda x: named(rng.choice(("div", "section", "article", "main")), rng.choice(_CONTENT_NAMES), x),
        lambda x: named("div", "main", named("div", rng.choice(_CONTENT_NAMES), x)),
        lambda x: f"<div role='main'>{x}</div>",
        lambda x: f"<section>{x}</section>",
        lambda x: f"<div><div>{x}</div></div>",
        lambda x: x,
    )
    pages = []
    for _ in range(n):
        around = rng.choice(whole)
        head = rng.choice(heads)
        if around in whole[-3:] and head in heads[1:3]:  # there it would be the page's own header
            head = heads[0]
        title = head(c(rng.randint(2, 9)))
        parts = [piece() for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randint(0, len(parts)), other(rng.choice(("advert", "advert", "notice", "social", "form", "side", "footer")), True))
        if rng.random() < 0.25:
            parts.append(other("comments", True))
        if rng.random() < 0.1:
            parts = [rng.choice((c(rng.randint(5, 80)), f"<p>{c(rng.randint(1, 5))}</p>"))]
        before = [other(k, False) for k in ("menu", "header", "notice", "advert", "form", "social") if rng.random() < 0.4]
        after = [other(k, False) for k in ("comments", "social", "side", "advert", "footer", "menu") if rng.random() < 0.4]
        rng.shuffle(before)
        for x in (before, after):  # some that do not say what they are
            if rng.random() < 0.3:
                x.insert(0, rng.choice((links(rng.randint(4, 12)), f"<div>{links(6)}</div>")))
        pages.append(f"<html><head><title>{o(4)}</title></head><body>{''.join(before)}{around(title + ''.join(parts))}{''.join(after)}</body></html>")
    return pages


def _logistic(rows: dict[tuple[tuple[str, ...], bool], float], rounds: int, decay: float, bias: float | None = None) -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias if none is given, from counts of
    (features, label)."""
    names = sorted({f for fs, _ in rows for f in fs})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, -1] = 1
    for i, (fs, _) in enumerate(rows):
        x[i, [at[f] for f in fs]] = 1
    y, n = np.array([y for _, y in rows], np.float32), np.sqrt(np.array(list(rows.values()), np.float32))
    w, sq = np.zeros(x.shape[1], np.float32), np.full(x.shape[1], 1e-6, np.float32)
    w[-1] = bias or 0
    for _ in range(rounds):
        g = x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) * n) / n.sum() + decay * w
        g[-1] *= bias is None
        sq += g * g
        w -= 0.3 * g / np.sqrt(sq)
    return dict(zip(names, map(float, w))), float(w[-1])


def _block(page: Page, tag: str, words: int, linked: int, inside: bool, some: bool) -> tuple[str, ...]:
    """Features of the words of a block."""
    place = "in" if inside else "beside" if some else "alone"
    size = "1" if words < 4 else "4" if words < 12 else "12"
    link = "all" if 10 * linked >= 9 * words else "half" if 2 * linked >= words else "few"
    kind = "h" if tag in _HEADINGS else tag if tag in ("p", "li", "td", "th") else "other"
    return (f"place:{place}", f"link:{link}", f"link:{link}|{place}", f"size:{size}|{link}", f"tag:{kind}", f"tag:{kind}|{place}")


class Weights:
    """What the labelled pages teach: weights of elements, words and tags."""

    def __init__(self, rounds: int = 200):
        pages = [Page(p) for p in _labelled()]
        marked = []
        rows: dict[tuple[tuple[str, ...], bool], float] = {}
        for page in pages:
            holds = [False] * len(page.name)
            for kind, x, e, _ in page.runs:
                holds[e] |= kind == "word" and "\x01" in x
            for e in range(len(holds) - 1, 0, -1):
                holds[page.parent[e]] |= holds[e]
            marked.append(holds)
            inside = [False] * len(holds)
            for e in range(1, len(holds)):
                above = inside[page.parent[e]]
                inside[e] = above or holds[e] and (page.name[e] in ("article", "main") or page.name[e] in ("div", "section") and bool(page.hints[e]))
                fs = tuple(_own(page, e, above))
                if fs:
                    rows[fs, holds[e]] = rows.get((fs, holds[e]), 0) + 1
        self.element, _ = _logistic(rows, rounds, 1e-4, _KEEP)
        words: dict = {}
        tags: dict = {}
        for page, holds in zip(pages, marked):
            out, inside, some = self.judge(page)
            runs = [(i, r) for i, r in enumerate(page.runs) if not out[r[2]]]
            good = [i for i, r in runs if r[0] == "word" and "\x01" in r[1]]
            for fs, members in self.blocks(page, runs, inside, some):
                for i in members:
                    n = len(page.runs[i][1].split())
                    k = fs, "\x01" in page.runs[i][1]
                    words[k] = words.get(k, 0) + n
            for i, (kind, x, e, _) in runs:
                if kind == "tag" and good:
                    k = (f"tag:{x if x in _BLOCK else 'inline'}", f"place:{inside[e]}{some}"), good[0] <= i <= good[-1]
                    tags[k] = tags.get(k, 0) + 1
        self.word, self.word_bias = _logistic({k: n for k, n in words.items() if n}, rounds, 1e-4)
        self.tag_, self.tag_bias = _logistic(tags, rounds, 1e-3)
        self.known: dict = {}

    def judge(self, page: Page, wide: float = 0.0) -> tuple[list[bool], list[bool], bool]:
        """For each element whether it leaves the page, whether it is in one
        that is surely content, and whether the page has such a one.

        Elements around an article or a main part stay; so do, with ``wide``,
        those named by class or id alone that hold over this share of the words.
        """
        n = len(page.name)
        out, inside = [False] * n, [False] * n
        held = [0] * n
        if wide:
            for kind, x, e, _ in page.runs:
                if kind == "word":
                    held[e] += len(x.split())
            for e in range(n - 1, 0, -1):
                held[page.parent[e]] += held[e]
        some = False
        for e in range(1, n):
            p, name = page.parent[e], page.name[e]
            out[e], inside[e] = out[p] or name in ("option", "optgroup"), inside[p]
            if out[e] or name in ("body", "html") or not (page.hints[e] or name in _MARKS):
                continue
            score = _KEEP + sum(self.element.get(f, 0.0) for f in _own(page, e, inside[p]))
            if score < _OUT and name != "main" and not page.holds[e] and not (wide and name not in _MARKS and held[e] > wide * held[0]):
                out[e] = True
            elif name in ("article", "main") or score > _IN and name not in ("a", "span", "i", "b", "header", "p"):
                inside[e] = some = True
        return out, inside, some

    def blocks(self, page: Page, runs, inside: list[bool], some: bool):
        """Features of each block with the places of its words."""
        members: list[int] = []
        words = linked = 0
        tag, place = "", False
        for i, (kind, x, e, link) in runs:
            if kind == "word":
                n = len(x.split())
                if n:
                    if not members:
                        b = e
                        while page.name[b] not in _BLOCK and b:
                            b = page.parent[b]
                        tag, place = page.name[b], inside[e]
                    members.append(i)
                    words += n
                    linked += n * link
            elif x in _BLOCK and members:
                yield _block(page, tag, words, linked, place, some), members
                members, words, linked = [], 0, 0
        if members:
            yield _block(page, tag, words, linked, place, some), members

    def of_word(self, features: tuple[str, ...]) -> float:
        got = self.known.get(features)
        if got is None:
            got = self.known[features] = float(np.clip(self.word_bias + sum(self.word.get(f, 0.0) for f in features), -4, 4))
        return got

    def of_tag(self, name: str, place: str) -> float:
        fs = (f"tag:{name if name in _BLOCK else 'inline'}", f"place:{place}")
        got = self.known.get(fs)
        if got is None:
            got = self.known[fs] = float(np.clip(self.tag_bias + sum(self.tag_.get(f, 0.0) for f in fs) - 1, -1, -0.05))
        return got


_TRAINED: list[Weights] = []


def trained() -> Weights:
    """The same weights every time, once in a process."""
    if not _TRAINED:
        _TRAINED.append(Weights())
    return _TRAINED[0]


def best_region(scores: list[float]) -> tuple[int, int] | None:
    """First and last place of the contiguous stretch with the best sum, by
    one scan; of stretches that score alike the one that ends first.  None
    if no sum is above zero."""
    best, region, total, start = 0.0, None, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i)
    return region


def main_text(html: str, weights: Weights) -> str:
    """The text of the best region.  Empty if no word scores above zero.

    Where all words stand in elements that leave the page, those that class
    or id alone names and that hold most words are taken for wrappers.
    """
    page = Page(html)
    for wide in (0.0, 0.5):
        out, inside, some = weights.judge(page, wide)
        runs = [(i, r) for i, r in enumerate(page.runs) if not out[r[2]]]
        of = {}
        for fs, members in weights.blocks(page, runs, inside, some):
            w = weights.of_word(fs)
            for i in members:
                of[i] = w * len(page.runs[i][1].split())
        if of:
            break
    scores = [of.get(i, 0.0) if r[0] == "word" else weights.of_tag(r[1], f"{inside[r[2]]}{some}") for i, r in runs]
    region = best_region(scores)
    if region is None:
        return ""
    parts = []
    for _, (kind, x, _, _) in runs[region[0] : region[1] + 1]:
        if kind == "word":
            parts.append(_html.unescape(x))
        elif x in _BLOCK:
            parts.append(" ")
    return " ".join("".join(parts).split())


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and ``text string`` for every page, from the whole html.

    White space (Unicode's) becomes one space, blocks are joined by one
    space.  Null and empty pages, and pages without words of content, give
    the empty text.  Elements that nothing closes end with the element around
    them; where one around an article would leave the page, it stays.  Pages
    of any depth take time in proportion to their length.  Repeated rows stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(trained())  # some thousand numbers

    def run(_, pages: list[str]) -> list:
        return [pa.array([main_text(p, shared.value) for p in pages], pa.string())]

    kept = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep)
    return map_texts(df, html, f"{kept}, text string", run, list(keep))
