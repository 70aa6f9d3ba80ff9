"""Main text of web pages: the maximum-scoring run of words and tags, words scoring positive and tags negative.

A page is read as words and tags. Weights come from labelled pages, pairs of a page and its main text: labelled() makes those that
ship. A logistic model over the elements around a word, by their names and by their whole class, id and role names, gives the word's
log-odds of being main text; between -0.02 and 1 they are its score. A tag costs the more, the rarer it is in main text, and
the tag that opens an element with names of menus, adverts and the like costs most, so that such a box inside an article doesn't
part it, however long it is. A linear scan finds the run with the largest score. The run is then taken whole: blocks whose words are
against it go, and blocks whose words are for it join from the rest of the innermost element that holds the run,
unless that is the page itself.

Defined results: a null html is empty; an empty page, or one without words, gives an empty text; very long pages are taken
whole; unclosed elements end with what encloses them; of equal runs the first, longest wins; repeated rows and an empty
table pass through; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|button|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attr>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_IMPLIED = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Parts of a class name that say where or how large a thing is, not what: "site-footer" is a "footer".
_FRAME = frozenset("site page box bar list wrap wrapper container section area block item inner outer top bottom left right col column row holder panel slot unit group region global primary secondary".split())
#: Elements that say nothing as a word's surroundings.
_PLAIN = frozenset("html body div p".split())


def names_of(attr: str) -> list[str]:
    """Whole names in class, id, role and label, without parts that only place the element, and numbers."""
    out = []
    for a, b, c in _NAMED.findall(attr):
        for x in (a or b or c).lower().split():
            parts = [y for y in re.split(r"[-_]+", x) if y not in _FRAME and not y.isdigit()]
            if parts:
                out.append("." + "-".join(parts))
    return out


class Block:
    """Words between block tags: text, words, how many of them are linked, the features around, the tags since the last
    block with their features, and the path of elements (numbers)."""

    __slots__ = ("text", "words", "linked", "around", "tags", "path")

    def __init__(self, text, linked, around, tags, path):
        self.text, self.words, self.linked, self.around, self.tags, self.path = text, text.count(" ") + 1, linked, around, tags, path


def blocks(page: str) -> list[Block]:
    out, parts, tags = [], [], []
    stack: list[tuple[str, tuple, int]] = []  # name, features of it and all around, number
    made = linked = chars = link_chars = 0

    def flush():
        nonlocal chars, link_chars, tags
        if parts:
            s = " ".join("".join(parts).split())
            if s:
                around = stack[-1][1] if stack else ()
                n = s.count(" ") + 1
                out.append(Block(s, min(n, round(n * link_chars / max(1, chars))), around, tags, tuple(x[2] for x in stack)))
                tags = []
            parts.clear()
            chars = link_chars = 0

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            s = html.unescape(text) if "&" in text else text
            parts.append(s)
            n = len(s.strip())
            chars += n
            if linked:
                link_chars += n
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        if name == "a":
            linked = 0 if m["end"] else 1
        if name not in _BLOCK:
            tags.append((name,))
            continue
        flush()
        if name in _VOID or m["end"]:
            tags.append((name,))
            if name not in _VOID:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            continue
        linked = 0
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name in _IMPLIED:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _STOPS[name]:
                    break
                if stack[k][0] in _IMPLIED[name]:
                    del stack[k:]
                    break
        around = stack[-1][1] if stack else ()
        within = "article" in around or "main" in around
        own = [] if name in _PLAIN else [name + "@in" if within and name not in ("article", "main") else name]
        if m["attr"] and name not in ("html", "body"):
            own += names_of(m["attr"])
        own = tuple(x for x in dict.fromkeys(own) if x not in around)
        tags.append((name, *own))
        stack.append((name, around + own, made))
        made += 1
    flush()
    return out


class Weights:
    """Learned weights: of features around words (with "" the bias, "a" for linked words), and of tags."""

    def __init__(self, around: dict[str, float], tags: dict[str, float]):
        self.around, self.tags, self.seen = around, tags, {}

    def odds(self, around: tuple) -> tuple[float, float]:
        """Log-odds of a plain and of a linked word."""
        if around not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            z = self.around.get("", 0.0) + sum(self.around.get(f, 0.0) for f in around)
            self.seen[around] = (z, z + self.around.get("a", 0.0))
        return self.seen[around]

    def block(self, b: Block) -> float:
        """Log-odds of the block's words together."""
        plain, linked = self.odds(b.around)
        return (b.words - b.linked) * plain + b.linked * linked

    def words(self, b: Block) -> float:
        plain, linked = (min(1.0, max(-0.02, z)) for z in self.odds(b.around))
        return (b.words - b.linked) * plain + b.linked * linked

    def tag(self, tag: tuple) -> float:
        return self.tags.get(tag[0], -0.2) + max(-3.0, min(0.0, sum(self.around.get(f, 0.0) for f in tag[1:])))


def learn(pages, epochs: int = 400, rate: float = 0.3, decay: float = 2e-4) -> Weights:
    """Weights from (page, main text) pairs: a block is main text if it is a line of it, as often as it is there."""
    rows, inside, outside = [], Counter(), Counter()
    for page, text in pages:
        left = Counter((text or "").split("\n"))
        for b in blocks(page or ""):
            y = left[b.text] > 0
            left[b.text] -= y
            for linked, n in ((False, b.words - b.linked), (True, b.linked)):
                if n:
                    rows.append(((*b.around, *(["a"] * linked)), min(n, 8), y))
            for t in b.tags:
                (inside if y else outside)[t[0]] += 1
    names = {f: i for i, f in enumerate(sorted({f for r in rows for f in r[0]}))}
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]).astype(np.int64)
    col = np.array([names[f] for r in rows for f in r[0]], np.int64)
    n, y = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    w, g2 = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-6)
    for _ in range(epochs if len(rows) else 0):
        z = np.bincount(row, w[:-1][col], len(rows)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * n / n.sum()
        g = np.append(np.bincount(col, err[row], len(names)), err.sum()) + decay * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    around = {f: float(w[i]) for f, i in names.items()} | {"": float(w[-1]) if len(rows) else 1.0}
    return Weights(around, {t: -min(2.0, 0.02 + 0.3 * log(1 + outside[t] / (inside[t] + 1))) for t in {*inside, *outside}})


#: Names of what is no main text, and of what is, in the labelled pages.
_NOT = (
    "ad ads advert advertisement advertising sponsor sponsored sponsors promo promotion banner nav navigation navbar menu submenu sidebar breadcrumb breadcrumbs footer "
    "header masthead cookie cookies cookie-banner cookie-notice consent gdpr notice notices alert popup modal newsletter newsletter-signup subscribe social social-share share sharing "
    "related related-posts related-articles recommended recommendations teaser teasers comments comment comment-body commentlist replies reply respond disqus "
    "login search search-form pagination pager copyright legal disclaimer skip skip-link toolbar widget contentinfo complementary dialog"
).split()
_IS = "content main article post entry entry-content post-content article-body story body text headline title lead summary quote chapter related-work search-results header-image".split()


def labelled():
    """The labelled pages that ship: layouts of our own, filled in turn with names of boxes and of article elements. Text is
    numbered words, so that nothing but elements and their names can be learned."""
    n = 0

    def said(k):
        nonlocal n
        n += k
        return " ".join(f"w{i}" for i in range(n - k, n))

    def link(k):
        return f'<a href="/{n}">{said(k)}</a>'

    for i, bad in enumerate(_NOT):
        good, other = _IS[i % len(_IS)], _NOT[(i * 7 + 3) % len(_NOT)]
        menu = "<ul>" + "".join(f"<li>{link(1)}</li>" for _ in range(5)) + "</ul>"
        h1, p1, p2, p3, li1, li2, cap = said(4), said(25), said(30), said(12), said(6), said(5), said(7)
        top = (f"<nav>{menu}</nav>", f"<header>{said(3)}{menu}</header>", f'<div class="{other}">{menu}</div>', f'<div id="{bad}">{said(9)}</div>')[i % 4]
        low = (f"<footer><p>{said(8)}</p></footer>", f'<div class="{bad}"><p>{said(6)}</p></div>', f"<aside><h3>{said(2)}</h3><p>{link(5)}</p></aside>", f"<form><label>{said(2)}</label></form>")[i % 4]
        box = f'<div class="{bad}"><p>{said(15)}</p><p>{link(4)}</p></div>'
        whole = f'<p><a href="/x">{p3}</a></p>'  # a linked paragraph is text
        body = f"<h1>{h1}</h1>{box if i % 2 else ''}<p>{p1}</p>{'' if i % 2 else box}{whole}<blockquote>{p2}</blockquote><ul><li>{li1}</li><li><a>{li2}</a></li></ul><figure><figcaption>{cap}</figcaption></figure>"
        lines = [h1, p1, p3, p2, li1, li2, cap]
        if i % 3 == 0:  # the article's own header and footer
            by, end = said(3), said(4)
            body, lines = f"<header><h2>{by}</h2></header>{body}<section class=\"{good}\"><p>{end}</p></section>", [by, *lines, end]
        frame = (f"<article>{body}</article>", f'<main class="{good}">{body}</main>', f'<div class="{good}">{body}</div>', f'<div><div class="{good}">{body}</div></div>', f"<section>{body}</section>", f"<div>{body}</div>", body)[i % 7]
        extra = (f'<section class="{bad}"><h3>{said(1)}</h3><p>{said(20)}</p></section>', f"<aside>{said(10)}</aside>", f'<ol class="{bad}"><li>{said(9)}</li><li>{said(9)}</li></ol>')[i % 3]
        page = f"{top}{frame}{extra}{low}"
        if i % 9 == 4:  # a form round the whole page
            page = f"<form>{page}</form>"
        yield f"<html><body>{page}</body></html>", "\n".join(lines)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the run with the largest sum, if it is over 0; of equal ones the first, then the longest."""
    best, top, start, total = (0, 0), 0.0, 0, 0.0
    for i, s in enumerate(scores):
        if total < 0:
            start, total = i, 0.0
        total += s
        if total > top or total == top and best[1] and best[0] == start:
            best, top = (start, i + 1), total
    return best


def extract(page: str | None, weights: Weights) -> str:
    """The main text of one page."""
    b = blocks(page or "")
    scores = []
    for x in b:  # tags of a block, then its words: a best run never ends among tags
        scores += [sum(map(weights.tag, x.tags)), weights.words(x)]
    start, end = best_run(scores)
    run = range(start // 2, (end + 1) // 2)
    good = [weights.block(x) > 0 for x in b]
    if not len(run) or not any(good[i] for i in run):
        return ""
    paths = [b[i].path[:-1] for i in run if good[i]]  # elements around their blocks' own
    hold = paths[0]
    for p in paths[1:]:
        k = 0
        while k < min(len(hold), len(p)) and hold[k] == p[k]:
            k += 1
        hold = hold[:k]
    whole = len(hold) > _shared(b)
    return "\n".join(x.text for i, x in enumerate(b) if good[i] and (i in run or whole and x.path[: len(hold)] == hold))


def _shared(b: list[Block]) -> int:
    """How many elements hold every block of the page."""
    k = 0
    while all(len(x.path) > k and x.path[k] == b[0].path[k] for x in b) and len(b[0].path) > k + 1:
        k += 1
    return k


def main_text(pages: DataFrame, labels=None) -> DataFrame:
    """page_id, url, text, n_chars of every page; labels: (page, main text) pairs to learn from, else those that ship."""
    weights = learn(labelled() if labels is None else labels)
    bounded(pages.sparkSession)

    def run(batches):
        for b in batches:
            text = [extract(h, weights) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
