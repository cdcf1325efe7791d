"""Main text of HTML pages by flat text blocks and a decision tree.

A page is cut into blocks of text at block-level tags. A block's features are its own and its neighbours' word counts and link densities, and
what it stands in: an element that by tag, class, id or role is furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, hidden parts) or holds an article. The tree is grown on a small labelled table of page fragments and kept as arrays.

Defined results: null and empty pages, and pages without an article block, have the empty text; unclosed tags, comments and scripts end with
the page; a stray closing tag is left out; equal rows get equal results; an empty table gives an empty result. Other columns are kept; those
named like added ones are replaced.
"""

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title|head)\b(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs2>[^>]*+)>?",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BARE_VALUE = re.compile(r"=\s*[^\s\"'>]*/>\Z")  # the slash belongs to a value without quotes
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of HTML by what they are here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the start of an element ends though its end tag is left out, and what such an end does not reach beyond.
ENDS = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "td": ["td", "th"], "th": ["td", "th"], "tr": "tr td th caption".split(), "option": ["option"]}
ENDS |= {t: "thead tbody tfoot tr td th caption".split() for t in ("thead", "tbody", "tfoot")}
_HOLDS = """article aside blockquote body button caption center details dialog dir dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
    hgroup main menu nav ol pre section summary table tbody td tfoot th thead tr ul""".split()
BARRIERS = {"li": _HOLDS + ["dd", "dt"], "dt": _HOLDS + ["li"], "dd": _HOLDS + ["li"], "td": ["table", "tr"], "th": ["table", "tr"], "option": []}
BARRIERS |= {t: ["table"] for t in "tr thead tbody tfoot".split()}
#: What an end tag does not reach beyond.
SCOPES = {t: ["table"] for t in "td th tr thead tbody tfoot caption".split()} | {t: "button caption table td th".split() for t in ("p", "dt", "dd")}
SCOPES["li"] = SCOPES["p"] + ["ol", "ul"]
ENDS_P = HEADINGS | frozenset(
    """address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu
    nav ol p pre section summary table ul""".split()
)
FURNITURE_TAGS = frozenset("nav header footer aside form button dialog menu fieldset".split())
FURNITURE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header
    masthead topbar banner footer bottom sidebar aside rail widget related recommended trending popular cookie cookies consent gdpr notice notices
    notification alert popup modal overlay dialog newsletter subscribe subscription signup login register search form comment comments commentlist
    reply replies respond discussion disqus social share sharing follow tags tagcloud pagination pager toolbar copyright legal disclaimer skip
    contentinfo complementary alertdialog""".split()
)
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_NAMES = frozenset("article main content post entry story articlebody".split())
FEATURES = "words links words_before links_before words_after links_after furniture article page_has_article ends_sentence heading".split()


class _Place:
    """Open elements that matter, with their places by tag: how many are furniture, how many hold an article."""

    def __init__(self):
        self.open, self.at, self.furniture, self.article = [], {}, 0, 0

    def enter(self, tag, attrs):
        named = set()
        for m in _NAMED.finditer(attrs) if "=" in attrs else ():
            named.update(p.lower() for p in _PART.findall(m.group(1) or m.group(2) or m.group(3) or ""))
        article = tag in ARTICLE_TAGS or bool(named & ARTICLE_NAMES) and not named & FURNITURE_NAMES
        header = tag == "header" and self.article and not named & FURNITURE_NAMES  # an article's own head
        furniture = not header and tag not in ("body", "html") and (tag in FURNITURE_TAGS or (bool(named & FURNITURE_NAMES) and tag not in ARTICLE_TAGS) or bool(attrs and _HIDDEN.search(attrs)))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, furniture, article))
        self.furniture += furniture
        self.article += article

    def _last(self, tag):
        at = self.at.get(tag)
        return at[-1] if at else -1

    def _cut(self, k):
        for tag, f, a in self.open[k:]:
            self.at[tag].pop()
            self.furniture -= f
            self.article -= a
        del self.open[k:]

    def leave(self, tag):
        """The innermost open element of that name ends with all inside it, at any depth, but not beyond what holds such elements."""
        k = self._last(tag)
        if k >= 0 and all(self._last(b) < k for b in SCOPES.get(tag, ())):
            self._cut(k)

    def implied(self, tag):
        """Elements whose end may be left out and that end where ``tag`` begins."""
        if tag in ENDS:
            floor = max(map(self._last, BARRIERS[tag]), default=-1)
            found = [k for k in map(self._last, ENDS[tag]) if k > floor]
            if found:
                self._cut(min(found))
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self._cut(len(self.open) - 1)
        if tag in ENDS_P:
            self.leave("p")


def blocks(page):
    """(text, words, words in links, furniture, article, heading) of each block with text, in page order."""
    page = page or ""
    out, parts, place, link, heading, at = [], [], _Place(), 0, 0, 0
    n_words = n_link = 0

    def close():
        nonlocal parts, n_words, n_link
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, n_words, n_link, place.furniture > 0, place.article > 0, heading > 0))
        parts, n_words, n_link = [], 0, 0

    def add(raw):
        nonlocal n_words, n_link
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        k = len(text.split())
        n_words += k
        n_link += k if link else 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        raw = m.group("raw")
        if raw:
            close()
            if raw.lower() in ("svg", "math") and m.group().endswith("/>") and not _BARE_VALUE.search(m.group()):
                continue
            e = re.compile(rf"</{raw}\b[^>]*>?", re.I).search(page, at)
            at = e.end() if e else len(page) if raw.lower() != "head" else at
            continue
        tag = m.group("tag") or m.group("tag2")
        if not tag:
            continue
        tag, end = tag.lower(), m.group("end") or m.group("end2")
        attrs = m.group("attrs") or m.group("attrs2") or ""
        if tag == "a":
            link = 0 if end else 1
        if tag == "br":
            parts.append(" ")
        if tag in INLINE or tag not in _BLOCK:
            if attrs and not end and tag not in VOID and tag != "a" and (_HIDDEN.search(attrs) or "=" in attrs):
                place.enter(tag, attrs)
            elif end:
                place.leave(tag)
            continue
        close()
        if tag[0] == "h" and tag[1:] in "123456" and len(tag) == 2:
            heading = 0 if end else 1
        elif not end:
            heading = 0
        link = 0 if tag in ("p", "div", "article", "section") else link
        if end:
            place.leave(tag)
            continue
        place.implied(tag)
        if tag not in VOID and not attrs.endswith("/"):
            place.enter(tag, attrs)
    if at < len(page):
        add(page[at:])
    close()
    return out


# Block-level elements.
_BLOCK = frozenset(
    """address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video
    audio""".split()
)


def features(found):
    """One row of FEATURES per block of a page."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b[1] for b in found], float)
        links = np.array([b[2] for b in found], float) / np.maximum(1, words)
        x[:, 0], x[:, 1] = words, links
        x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
        x[:, 6:8] = [(b[3], b[4]) for b in found]
        x[:, 8] = x[:, 7].max()
        x[:, 9] = [b[0][-1] in ".!?\"')" for b in found]
        x[:, 10] = [b[5] for b in found]
    return x


class Tree:
    """``feature``, ``threshold``, ``left``, ``right``, ``value`` by node; a leaf's feature is -1."""

    def __init__(self, x, y, depth=7, least=3):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y, depth, least)
        self.feature, self.threshold, self.left, self.right, self.value = map(np.array, (self.feature, self.threshold, self.left, self.right, self.value))

    def _grow(self, x, y, depth, least):
        me = len(self.feature)
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, float(y.mean()))):
            column.append(v)
        best = (1e-9, None, None)
        if depth and 0 < y.mean() < 1:
            for j in range(x.shape[1]):
                order = np.argsort(x[:, j], kind="stable")
                v, s = x[order, j], np.cumsum(y[order])
                k = np.arange(1, len(y))
                ok = (v[1:] > v[:-1]) & (k >= least) & (len(y) - k >= least)
                if ok.any():
                    p, q = s[:-1] / k, (s[-1] - s[:-1]) / (len(y) - k)
                    impurity = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
                    gain = np.where(ok, len(y) * y.mean() * (1 - y.mean()) - impurity, -1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], j, (v[i] + v[i + 1]) / 2)
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            self.feature[me], self.threshold[me] = best[1], best[2]
            self.left[me] = self._grow(x[low], y[low], depth - 1, least)
            self.right[me] = self._grow(x[~low], y[~low], depth - 1, least)
        return me

    def predict(self, x):
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            f = np.maximum(self.feature[at], 0)
            go = np.where(x[np.arange(len(x)), f] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, go, at)
        return self.value[at] > 0.5


#: The labelled table: fragments of pages, {n} standing for n made-up words. Text of an article, inside it.
ARTICLE_PARTS = """<h1>{6}</h1>|<h2>{3}</h2>|<p>{40}.</p>|<p>{25}.</p>|<p>{12}.</p>|<p>{2}.</p>|<p>{1}.</p>|<p>{1}</p>|<p><b>{20}.<br><p>{30}.</p>|<p>{9} <a href="/x">{2}</a> {14}.</p>
<blockquote>{18}.</blockquote>|<ul><li>{6}</li><li>{9}</li><li>{2}</li></ul>|<pre>{8}</pre>|<figure><figcaption>{7}.</figcaption></figure>|<table><tr><td>{2}</td><td>{1}</td></tr></table>
<header><h1>{7}</h1></header>|<div>{16}.</div>|<section><h3>{4}</h3><p>{22}.</p></section>|<p><a href="/y">{3}</a></p>|<p>{8}, {5}! {9}</p>""".replace("\n", "|").split("|")
#: Furniture, in or around an article.
FURNITURE_PARTS = """<nav><ul><li><a href="/a">{1}</a></li><li><a href="/b">{2}</a></li><li><a href="/c">{1}</a></li></ul></nav>|<header><a href="/">{2}</a><p>{5}</p></header>
<footer>{12}.</footer>|<footer><p>&copy; {3}</p><a href="/t">{2}</a></footer>|<aside><h3>{2}</h3><p>{20}.</p></aside>|<div class="ad">{14}.</div>|<div class="ad">{4}.</div>
<div class="cookie-notice"><p>{16}.</p><button>{1}</button></div>|<div id="sidebar"><ul><li><a href="/r">{5}</a></li></ul><p>{9}.</p></div>|<form><label>{2}</label><input><p>{8}.</p></form>
<section class="comments"><h3>{1}</h3><div class="comment"><p>{24}.</p></div><div class="comment"><p>{6}!</p></div></section>|<div class="related"><a href="/q">{7}</a><a href="/w">{8}</a></div>
<div class="share-buttons"><a href="/s">{1}</a><a href="/s2">{1}</a></div>|<ul class="breadcrumb"><li><a href="/h">{1}</a></li><li>{1}</li></ul>|<div role="navigation"><a href="/n">{1}</a></div>
<div class="newsletter-signup"><p>{15}.</p></div>|<div style="display:none">{10}.</div>|<div id="comments"><p>{30}.</p></div>|<p class="notice">{11}.</p>|<div class="promo"><p>{13}.</p></div>""".replace("\n", "|").split("|")
#: Furniture without a name, told by its words and links.
BARE_PARTS = """<ul><li><a href="/a">{1}</a></li><li><a href="/b">{2}</a></li><li><a href="/c">{1}</a></li><li><a href="/d">{2}</a></li></ul>|<div><a href="/e">{4}</a></div>|<div>{2}</div>
<p><a href="/f">{1}</a> <a href="/g">{1}</a> <a href="/h">{1}</a></p>|<div><a href="/i">{2}</a> {1}</div>""".replace("\n", "|").split("|")
WRAPPERS = ["<article>", "<main>", '<div class="content">', '<div class="post-body">', "<main><article>", "<div>", "<div>"]


def labelled_table(pages=260, seed=4):
    """Features and labels (1: article) of the blocks of pages put together by rule from the fragments."""
    r = np.random.default_rng(seed)
    fill = lambda part: re.sub(r"\{(\d+)\}", lambda m: " ".join("w" * r.integers(1, 9) for _ in range(max(1, int(int(m[1]) * r.uniform(0.6, 1.5))))), part)
    some = lambda parts, low, high: [parts[k] for k in r.integers(0, len(parts), r.integers(low, high))]
    xs, ys = [], []
    for k in range(pages):
        wrap = WRAPPERS[k % len(WRAPPERS)]
        bare = wrap == "<div>"
        inner = [(1, p) for p in some([p for p in ARTICLE_PARTS if not bare or "{1}" not in p and "{2}" not in p], 2, 9)]
        if not bare and r.random() < 0.4:
            inner.insert(int(r.integers(0, len(inner) + 1)), (0, some(FURNITURE_PARTS[4:], 1, 2)[0]))
        outside = lambda: [(0, p) for p in some(FURNITURE_PARTS + BARE_PARTS * 2, 1, 4)]
        closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", wrap)))
        # marks of the part ahead of each text tell the label of a block
        page = "".join(_marked(fill(p), label) for label, p in outside()) + wrap
        page += "".join(_marked(fill(p), label) for label, p in inner) + closing
        page += "".join(_marked(fill(p), label) for label, p in outside())
        found = blocks(page)
        xs.append(features([(b[0].replace("\x01", "").replace("\x02", ""), *b[1:]) for b in found]))
        ys += [b[0].count("\x02") > 0 for b in found]
    return np.concatenate(xs), np.array(ys, float)


def _marked(part, label):
    """A mark before the first letter of each text of a fragment: \\x02 in an article, \\x01 in furniture."""
    return re.sub(r">([^<\s])", lambda m: ">" + ("\x02" if label else "\x01") + m[1], part)


def train():
    return Tree(*labelled_table())


def main_text(page, tree):
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(features(found))
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def with_main_text(pages, tree):
    """``pages`` with ``text``, the main text of ``html``."""

    @F.pandas_udf("string")
    def extract(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, tree) for h in htmls], dtype=object)

    return pages.withColumn("text", extract(F.col("html").cast("string")))
