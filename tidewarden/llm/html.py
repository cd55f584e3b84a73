"""Main text of HTML pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks: text between the tags that begin or end a block. Each block has binary
features of its ancestor tags and its text; the field scores each block and each pair of neighbours as main text or
not, and the best labelling of the whole page is found by Viterbi's method. The weights are learned from labelled pages
that ``training_pages`` lays out in the ways pages commonly are; the tables have no labelled pages.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import text_of

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object svg title textarea select button datalist annotation "
                   "annotation-xml mphantom".split())
HEAD_HOLDS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())   # all else ends it
FALLBACKS = ("noscript", "iframe", "object")
PAGE_PARTS = frozenset("body article main header footer nav".split())   # never part of a fallback: what is still open ends
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr br "
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mprescripts mroot mrow ms "
                   "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
SPACED = frozenset("br mspace mtd mtr".split())   # inline, but what is on both sides does not run together
CLOSED_BY = {   # an open element of the key ends where one of these begins
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
    "option": frozenset(["option"])}
TAGS = frozenset("article main nav header footer aside form section table ul ol li dl blockquote pre figure figcaption "
                 "h1 h2 h3 h4 h5 h6 p div button address details td th menu dialog".split())
HOLDERS = frozenset("article main nav header footer aside form menu dialog address".split())
HINTS = {   # what class, id and role values say
    "nav": "nav|menu|breadcrumb|pagination|pager|toc|tabs|skip",
    "head": "header|masthead|topbar|logo|branding",
    "foot": "footer|copyright|colophon|legal",
    "side": "sidebar|side|widget|related|recommended|trending|popular|complementary",
    "ad": "ad|ads|advert|advertisement|banner|sponsor|sponsored|promo|promotion",
    "note": "cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall",
    "talk": "comment|comments|reply|replies|respond|discussion|disqus",
    "form": "form|search|login|contact",
    "share": "share|social|follow|tags|author|byline|meta",
    "main": "article|content|post|entry|story|main|body|text|prose"}
_WORDS = {word: hint for hint, words in HINTS.items() for word in words.split("|")}
_END_TAGS = re.compile(r"</([A-Za-z][A-Za-z0-9-]*)")
_MARKS = re.compile(r"<!--|-->|</?(?:script|style)\b", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hints(attrs) -> set[str]:
    found = set()
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            found.update(_WORDS[w] for w in (m.lower() for m in _PARTS.findall(value)) if w in _WORDS)
    return found


class _Blocks(HTMLParser):
    """Collects leaf blocks: (text, share of it in links, features of the ancestors)."""

    def __init__(self, html: str = ""):
        super().__init__(convert_charrefs=True)
        self.ends = Counter(name.lower() for name in _END_TAGS.findall(html))    # end tags still to come
        self.blocks: list[tuple[str, float, frozenset[str]]] = []
        self.open: list[tuple[str, frozenset[str], str]] = []   # tag, features up to here, nearest holder
        self.held: dict[str, int] = {}                          # how often each tag is open
        self.parts: list[str] = []
        self.linked = 0
        self.title: list[str] = []

    def _count(self, tag: str, by: int) -> None:
        self.held[tag] = self.held.get(tag, 0) + by

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            features, holder = (self.open[-1][1], self.open[-1][2]) if self.open else (frozenset(), "none")
            tag = next((t for t, _, _ in reversed(self.open) if t not in INLINE), "none")
            self.blocks.append((text, min(1.0, self.linked / len(text)),
                                features | {f"near:{holder}", f"tag:{tag if tag in TAGS else 'other'}"}))
        self.parts, self.linked = [], 0

    def _in_head(self) -> bool:
        """Whether a head is the innermost open element: its end tag may be missing."""
        return bool(self.open) and self.open[-1][0] == "head"

    def handle_starttag(self, tag, attrs):
        if self.held.get("head") and (tag == "body" or self._in_head() and tag not in HEAD_HOLDS):
            self._close("head")
        for name in FALLBACKS if tag in PAGE_PARTS else ():
            if self.held.get(name):
                self._close(name)
        if tag in UNSEEN and tag not in ("head", *self.CDATA_CONTENT_ELEMENTS) and self.ends[tag] <= 0:
            self.flush()   # it never ends: what follows is seen
            return
        if tag in SPACED:
            self.parts.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE and tag not in UNSEEN:
            self.flush()
            while self.open and tag in CLOSED_BY.get(self._leaf(), ()):
                self._close(self._leaf())
        features, holder = (self.open[-1][1], self.open[-1][2]) if self.open else (frozenset(), "none")
        own = {f"in:{tag}"} if tag in TAGS else set()
        hints = _hints(attrs) if tag not in ("html", "body") else set()
        own |= {f"hint:{h}" for h in hints}
        if tag in HOLDERS:
            holder = tag
        elif hints:
            bad = sorted(hints - {"main"})
            holder = f"hint-{bad[0] if bad else 'main'}"
        self.open.append((tag, features if own <= features else features | own, holder))
        self._count(tag, 1)

    def handle_startendtag(self, tag, attrs):
        self.ends[tag] += 1
        self.handle_starttag(tag, attrs)
        if tag in VOID:
            self.ends[tag] -= 1
        else:
            self.handle_endtag(tag)

    def _leaf(self) -> str:
        """The innermost open element that is not inline."""
        for tag, _, _ in reversed(self.open):
            if tag not in INLINE:
                return tag
        return ""

    def _close(self, tag: str) -> None:
        while self.open:
            last = self.open.pop()[0]
            self._count(last, -1)
            if last == tag:
                return

    def handle_endtag(self, tag):
        self.ends[tag] -= 1
        if tag not in INLINE and tag not in UNSEEN:
            self.flush()
        if self.held.get(tag):
            self._close(tag)

    def handle_data(self, data):
        if self._in_head() and data.strip():
            self._close("head")
        if any(self.held.get(t) for t in UNSEEN):
            return
        self.parts.append(data)
        if self.held.get("a"):
            self.linked += len(data.strip())


def _without_open_comment(html: str) -> str:
    """The page up to a comment that never ends, which hides the rest; inside a script or style there are no comments."""
    inside, at = "", 0
    for mark in _MARKS.finditer(html):
        found = mark.group().lower()
        if inside:
            if found == inside:
                inside = ""
        elif found == "<!--":
            inside, at = "-->", mark.start()
        elif found in ("<script", "<style"):
            inside = "</" + found[1:]
    return html[:at] if inside == "-->" else html


def blocks(html: str) -> list[tuple[str, float, frozenset[str]]]:
    html = _without_open_comment(html)
    parser = _Blocks(html)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def features(found: list[tuple[str, float, frozenset[str]]]) -> list[set[str]]:
    out = []
    for i, (text, linked, above) in enumerate(found):
        words = text.count(" ") + 1
        own = set(above)
        own.add(f"words:{min(6, words.bit_length())}")
        own.add(f"links:{int(linked * 2.99)}")
        if text[-1] in ".!?:\"'”»…":
            own.add("ends")
        if "©" in text or "Copyright" in text:
            own.add("copyright")
        if i == 0:
            own.add("first")
        if i == len(found) - 1:
            own.add("last")
        out.append(own)
    return out


class Field:
    """Two labels, 1 for main text: weights of each feature, of each pair of neighbouring labels, of the first."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.names, self.unary, self.pair = names, unary, pair

    def score(self, sets: list[set[str]]) -> np.ndarray:
        """Score of label 1 over label 0 of each block by itself."""
        get, w = self.names.get, self.unary
        return np.array([w[-1] + sum(w[j] for j in map(get, own) if j is not None) for own in sets])

    def decode(self, sets: list[set[str]]) -> list[int]:
        """The best labelling (Viterbi); of equal ones, main text."""
        if not sets:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        own = self.score(sets).tolist()
        a0, a1, back = 0.0, own[0], []
        for s in own[1:]:
            from0, from1 = a1 + p10 >= a0 + p00, a1 + p11 >= a0 + p01
            back.append((from0, from1))
            a0, a1 = (a1 + p10 if from0 else a0 + p00), (a1 + p11 if from1 else a0 + p01) + s
        label = int(a1 >= a0)
        out = [label]
        for from0, from1 in reversed(back):
            label = int(from1 if label else from0)
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[set[str]], list[int]]], steps: int = 300, rate: float = 1.0, ridge: float = 1e-4) -> Field:
    """Maximum likelihood with a ridge, by gradient steps; forward and backward sums over all pages at once."""
    names = {f: i for i, f in enumerate(sorted({f for sets, _ in pages for own in sets for f in own}))}
    n, long, d = len(pages), max(len(sets) for sets, _ in pages), len(names) + 1
    x = np.zeros((n, long, d))
    y = np.zeros((n, long), int)
    there = np.zeros((n, long), bool)
    for i, (sets, labels) in enumerate(pages):
        there[i, :len(sets)] = True
        y[i, :len(sets)] = labels
        for t, own in enumerate(sets):
            x[i, t, [names[f] for f in own]] = 1
            x[i, t, -1] = 1
    both = there[:, 1:]
    w, pair = np.zeros(d), np.zeros((2, 2))
    seen_pairs = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    speed_w, speed_p = np.zeros(d), np.zeros((2, 2))
    size = there.sum()
    for _ in range(steps):
        own = np.stack([np.zeros((n, long)), x @ w], axis=2)
        forward = np.zeros((n, long, 2))
        backward = np.zeros((n, long, 2))
        forward[:, 0] = own[:, 0]
        for t in range(1, long):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + pair[None], axis=1) + own[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        for t in range(long - 2, -1, -1):
            step = np.logaddexp.reduce(pair[None] + (own[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        p = np.exp(forward + backward - total[:, None, None])[:, :, 1] * there
        joint = np.exp(forward[:, :-1, :, None] + pair[None, None]
                       + (own[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        grad_w = np.einsum("nt,ntd->d", (y - p) * there, x) / size - ridge * w
        grad_p = (seen_pairs - (joint * both[:, :, None, None]).sum(axis=(0, 1))) / size - ridge * pair
        speed_w, speed_p = 0.9 * speed_w + rate * grad_w, 0.9 * speed_p + rate * grad_p
        w, pair = w + speed_w, pair + speed_p
    return Field(names, w, pair)


def training_pages(n: int = 300, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Labelled pages: (html, its main blocks in order), of several layouts with changing names and parts."""
    draw = random.Random(seed)
    number = [0]

    def words(lo: int, hi: int, stop: str = "") -> str:
        number[0] += 1
        some = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(lo, hi))]
        return f"{' '.join(some)} x{number[0]}".capitalize() + stop   # each text occurs once

    def links(k: int, tag: str = "ul") -> str:
        items = "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k))
        return f"<{tag}>{items}</{tag}>"

    def one(*names: str) -> str:
        return draw.choice(names)

    def extras() -> list[str]:
        """Parts that are no main text, in any place."""
        stop = one(".", "", "!")
        kinds = [
            f'<div class="{one("ad", "ads", "advert", "banner-ad", "sponsored")}">{words(2, 25, stop)}</div>',
            f'<div class="{one("cookie-notice", "notice", "consent", "alert", "newsletter")}"><p>{words(4, 30, stop)}</p></div>',
            f'<aside>{words(3, 30, stop)}</aside>',
            f'<aside class="{one("sidebar", "related", "widget")}"><h3>{words(1, 3)}</h3>{links(draw.randint(2, 5))}</aside>',
            f'<form><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button><p>{words(3, 12, stop)}</p></form>',
            f'<div class="{one("share", "social", "tags", "byline")}">{words(1, 5)}</div>']
        return draw.sample(kinds, draw.randint(0, 3))

    def comments() -> str:
        tag = one("div", "section")
        each = "".join(f'<{one("div", "article")} class="comment"><p>{words(3, 40, ".")}</p></{"div"}>'
                       for _ in range(draw.randint(1, 4)))
        return f'<{tag} {one("class", "id")}="{one("comments", "comment-list", "replies", "discussion")}"><h3>{words(1, 3)}</h3>{each}</{tag}>'

    pages = []
    for _ in range(n):
        main: list[str] = []

        def keep(lo: int, hi: int, stop: str = "") -> str:
            main.append(words(lo, hi, stop))
            return main[-1]

        def body() -> str:
            """Main blocks, now and then with a part inside that is none."""
            out = []
            for _ in range(draw.choice((1, 1, 2, 3, 4, 6, 9))):
                kind = draw.random()
                stop = one(".", ".", ".", "", "!", "?")
                if kind < 0.62:
                    text = keep(1, draw.choice((5, 20, 60)), stop)
                    if draw.random() < 0.3:
                        text = f"<b>{text}<br>" if draw.random() < 0.5 else f"<em>{text}</em>"
                    out.append(f"<p>{text}" + ("</p>" if draw.random() < 0.9 else ""))
                elif kind < 0.72:
                    out.append(f"<h2>{keep(1, 8)}</h2>")
                elif kind < 0.78:
                    out.append("<ul>" + "".join(f"<li>{keep(1, 12, stop)}</li>" for _ in range(3)) + "</ul>")
                elif kind < 0.82:
                    out.append(f"<blockquote>{keep(3, 30, stop)}</blockquote>")
                elif kind < 0.85:
                    out.append(f"<pre>{keep(2, 10)}</pre>")
                elif kind < 0.88:
                    out.append(f"<table><tr><td>{keep(1, 3)}</td><td>{keep(1, 3)}</td></tr></table>")
                elif kind < 0.92:
                    out.append(f"<div>{keep(2, 40, stop)}</div>")
                elif extra := extras():
                    out.append(extra[0])
            return "".join(out)

        nav = f'<nav>{links(draw.randint(2, 7), one("ul", "ol"))}</nav>'
        if draw.random() < 0.3:
            nav = f'<div class="{one("menu", "nav", "breadcrumbs", "topnav")}">{links(draw.randint(2, 6))}</div>'
        if draw.random() < 0.4:
            nav = f'<header><div class="logo">{words(1, 3)}</div>{nav}</header>'
        where = draw.random()
        head = f"<h1>{keep(2, 12)}</h1>" if where < 0.97 and draw.random() < 0.85 else ""
        if where < 0.45:
            inner = f"<article>{head}{body()}</article>"
        elif where < 0.6:
            inner = f'<main><article><header>{head}</header><div class="{one("entry-content", "post-body", "text")}">{body()}</div></article></main>'
        elif where < 0.75:
            inner = f'<main>{head}{body()}</main>'
        elif where < 0.93:
            inner = f'<div {one("class", "id")}="{one("content", "post", "story", "article-body", "main")}">{head}{body()}</div>'
        elif where < 0.96:
            inner = f"<div>{head}{body()}</div>"
        else:
            inner = head + body() if draw.random() < 0.5 else f"<p>{keep(1, 30, '.')}</p>"
        if draw.random() < 0.25 and inner.endswith(("</article>", "</main>", "</div>")):
            inner = inner.rsplit("</", 1)[0] + comments() + "</" + inner.rsplit("</", 1)[1]
        elif draw.random() < 0.25:
            inner += comments()
        foot = f"<footer>&copy; {words(1, 3)} &middot; {words(1, 20, one('.', ''))}</footer>"
        if draw.random() < 0.25:
            foot = f'<div class="{one("footer", "copyright", "legal")}"><p>{words(2, 20, one(".", ""))}</p></div>'
        nav, foot = nav * (draw.random() < 0.85), foot * (draw.random() < 0.8)
        parts = [nav, *extras(), inner, *extras(), foot] if draw.random() < 0.9 else [inner]
        title = f"<head><title>{main[0] if main else words(1, 5)}</title><style>p{{}}</style></head>"
        pages.append((f"<html>{title}<body>{''.join(parts)}" + ("</body></html>" if draw.random() < 0.9 else ""), main))
    return pages


def labelled(pages: list[tuple[str, list[str]]]) -> list[tuple[list[set[str]], list[int]]]:
    out = []
    for html, main in pages:
        found, wanted = blocks(html), set(main)
        out.append((features(found), [int(text in wanted) for text, _, _ in found]))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return fit(labelled(training_pages()))


def main_text(html: str, field: Field) -> str:
    found = blocks(html)
    return "\n".join(text for (text, _, _), label in zip(found, field.decode(features(found))) if label)


def extract(pages: DataFrame, id_name: str = "page_id", url_name: str = "url", html_name: str = "html",
            field: Field | None = None) -> DataFrame:
    """One row per page: (id, url, text, n_chars) with the main text, its blocks in page order, one per line.

    A null or empty page, or one without a main block, has an empty text. All white space inside a block, also what a
    character reference stands for and ``<br>``, becomes one space. Repeated rows come out as often; other columns are
    ignored; an empty table gives no rows.
    """
    field = field or trained()
    rows = pages.select(F.col(id_name).alias("_id"), F.col(url_name).alias("_url"), text_of(html_name).alias("_html"))
    kind = rows.schema["_id"].dataType.simpleString()

    def read(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), field) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    return rows.mapInArrow(read, f"_id {kind}, _url string, text string, n_chars long").select(
        F.col("_id").alias(id_name), F.col("_url").alias(url_name), "text", "n_chars")
