"""Main text of web pages: boosted trees over DOM nodes, decoded from the root down.

Every block of a page gets features of its subtree (text, words, links, density of tags), of its
place (depth, siblings, order) and of its attribute tokens. The trees say whether it belongs to the
article or holds part of it. The labelling of a page maximises the summed log-odds, weighted by text,
under one rule: a block inside a dropped block is dropped. So no descendant contradicts its ancestor.
Three rules of structure stand beside the trees: what is called comments goes, a heading stays with
the block it stands over and a caption with its article, and a page in which the trees see nothing (a line or two) gives the texts
outside all boilerplate.

The given pages carry no labels. Training pages come from them: of a bounded sample, those with one
<article> or <main> give article blocks and boilerplate blocks, and these are set again into page
layouts of many kinds (semantic tags, plain divisions with telling or neutral names, nested columns,
notices, comments, forms), where every block's label is known. No layout is tied to a site.

Edge cases: null html is the empty page, with empty text; markup that never closes is read as far as
it goes; a page of any length is read whole, in time that grows with it; repeated rows stay rows; a sample without any article falls back to paragraphs against lists;
columns of the output's names are replaced.
"""

from __future__ import annotations

import functools
import html
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.boosting import Boosted
from tabscope.llm.dom import Page
from tabscope.llm.rows import with_columns_from

TRAIN_PAGES = 250  # sampled pages, about
LAYOUTS = 5  # training pages made of each
# fixed values: roots of attribute words, each a feature
ROOTS = (
    "nav menu breadcrumb head foot side aside widget relat recommend ad ads banner sponsor promo cookie consent notice alert popup modal "
    "comment reply discuss form search login subscri newsletter share social copyright legal content article main post entry story body text"
).split()
TAGS = "article main section div p h1 h2 h3 li ul ol nav header footer aside form table td blockquote pre figure figcaption #text dl dd button fieldset".split()
_WORDS = T.StructType([T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())])


@functools.lru_cache(maxsize=1 << 16)
def _roots_of(token: str) -> int:
    """Bits of the roots that an attribute word has."""
    return sum(1 << k for k, root in enumerate(ROOTS) if token == root or (len(root) > 3 and (token.startswith(root) or (root in token and len(token) < 16))))


def _bits(masks: list[int], width: int) -> np.ndarray:
    return (np.array(masks, np.uint64)[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.float32)


def features(page: Page) -> np.ndarray:
    """One row per block."""
    n = len(page.tag)
    parent = np.array(page.parent)
    chars = np.array([len(t) for t in page.text], float)
    words = np.array([t.count(" ") + bool(t) for t in page.text], float)
    stops = np.array([t.count(".") + t.count(",") for t in page.text], float)
    links = np.minimum(np.array(page.linked, float), chars)
    blocks = np.ones(n)
    paragraphs = np.array([t in ("p", "pre", "blockquote") for t in page.tag], float)
    depth, order, siblings = np.zeros(n), np.zeros(n), np.zeros(n)
    children = np.zeros(n, int)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
        order[i] = children[parent[i]]
        children[parent[i]] += 1
    siblings[1:] = children[parent[1:]]
    up_list = page.parent
    summed = [m.tolist() for m in (chars, words, stops, links, blocks, paragraphs)]
    for column in summed:
        for i in range(n - 1, 0, -1):
            column[up_list[i]] += column[i]
    chars, words, stops, links, blocks, paragraphs = map(np.array, summed)
    up = np.maximum(parent, 0)
    total = max(chars[0], 1.0)
    above, within = [0] * n, [0] * n  # bits of the block and all around it
    kind = np.array([TAGS.index(t) if t in TAGS else len(TAGS) for t in page.tag])
    for i, (tokens, tag) in enumerate(zip(page.tokens, kind.tolist())):
        own = 0
        for token in tokens[1:]:
            own |= _roots_of(token)
        above[i], within[i] = own, 1 << tag
        if i:
            above[i] |= above[up_list[i]]
            within[i] |= within[up_list[i]]
    over = np.zeros((n, len(TAGS) + 1), np.float32)
    over[np.arange(n), kind] = 1
    start = np.cumsum([len(t) for t in page.text]) / total
    plain = np.stack([
        np.log1p(chars), np.log1p(words), stops / np.maximum(words, 1), links / np.maximum(chars, 1), chars / blocks, chars / total,
        np.log1p(blocks), paragraphs, depth, order, siblings, order / np.maximum(siblings, 1), start, children.astype(float),
        paragraphs[up], paragraphs[up] / blocks[up], np.log1p(chars[up]), chars[up] / total, links[up] / np.maximum(chars[up], 1), chars / np.maximum(chars[up], 1), np.arange(n) / n, words / np.maximum(blocks, 1),
    ], axis=1)
    return np.concatenate([plain.astype(np.float32), over, _bits(within, len(TAGS) + 1), _bits(above, len(ROOTS))], axis=1)


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which blocks are kept: the best labelling in which nothing is kept inside a dropped block."""
    n = len(page.tag)
    weight = np.sqrt(1.0 + np.array([len(t) for t in page.text]))
    gain = odds * weight
    gain[0] = 0.0
    for i in range(n - 1, 0, -1):  # gain of keeping a block with the best of its subtree
        if i and gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and gain[i] > 0
    return keep


# fixed values: parts of a page by what they are called
APART_TAGS = frozenset("nav header footer aside form button select fieldset".split())
APART_ROOTS = tuple("menu breadcrumb sidebar widget related recommend advert banner sponsor promo cookie consent notice alert popup modal newsletter subscri share social copyright footer".split())
APART_WORDS = frozenset("nav ad ads search login".split())
COMMENT_ROOTS = tuple("comment respons repl discuss feedback disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CAPTIONS = frozenset("figure figcaption".split())
NEVER = -1e6


def _called(tokens: tuple[str, ...], roots: tuple[str, ...]) -> bool:
    return any(t.startswith(roots) for t in tokens[1:])


def without_comments(page: Page, odds: np.ndarray) -> np.ndarray:
    """No odds for blocks that are called comments and hold neither an article nor a first heading."""
    holds = [tag in ("article", "main", "h1") for tag in page.tag]
    for i in range(len(page.tag) - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    out = odds.astype(float).copy()
    for i, tokens in enumerate(page.tokens):
        if i and not holds[i] and _called(tokens, COMMENT_ROOTS):
            out[i] = NEVER
    return out


def with_headings(page: Page, keep: list[bool]) -> None:
    """A heading stays with what it stands over, the next block beside it that is no heading, and a figure's caption with what the figure is in."""
    children: dict[int, list[int]] = {}
    for i in range(1, len(page.tag)):
        children.setdefault(page.parent[i], []).append(i)
    added = []
    for parent, blocks in children.items():
        if not keep[parent]:
            continue
        below = False  # whether what follows is kept
        for i in reversed(blocks):
            if page.tag[i] in CAPTIONS and not keep[i]:
                added.append(i)
            elif page.tag[i] not in HEADINGS:
                below = keep[i]
            elif below and not keep[i]:
                added.append(i)
    for i in added:
        keep[i] = True
        for k in range(i + 1, len(page.tag)):  # its own blocks, which follow it
            if page.parent[k] < i:
                break
            keep[k] = True


def plain_texts(page: Page) -> list[bool]:
    """Texts outside everything that is called boilerplate, and not mostly links: all there is of a page whose article the trees do not see."""
    apart = [False] * len(page.tag)
    links, chars = [0] * len(page.tag), [len(t) for t in page.text]
    for i in range(len(page.tag) - 1, 0, -1):
        links[i] += min(page.linked[i], len(page.text[i]))
        links[page.parent[i]] += links[i]
        chars[page.parent[i]] += chars[i]
    for i in range(1, len(page.tag)):
        called = _called(page.tokens[i], APART_ROOTS) or _called(page.tokens[i], COMMENT_ROOTS) or bool(APART_WORDS & set(page.tokens[i][1:]))
        apart[i] = apart[page.parent[i]] or page.tag[i] in APART_TAGS or called or (page.tag[i] in ("ul", "ol", "table") and 2 * links[i] > chars[i])
    return [not a and 2 * n <= max(c, 1) for a, n, c in zip(apart, links, chars)]


def main_text(page: Page, odds: np.ndarray) -> str:
    keep = decode(page, without_comments(page, odds))
    with_headings(page, keep)
    if not any(k and t for k, t in zip(keep, page.text)):
        keep = plain_texts(page)
    return " ".join(t for t, k, tag in zip(page.text, keep, page.tag) if k and t and tag == "#text")


# ---- training pages


def parts(source: str) -> tuple[list[str], list[str]] | None:
    """(article blocks, other blocks) of a page with an <article> or <main>, as texts."""
    page = Page(source)
    inside = [False] * len(page.tag)
    apart = ("nav", "aside", "footer", "form", "header")
    for i in range(1, len(page.tag)):
        up = page.parent[i]
        inside[i] = (inside[up] or page.tag[i] in ("article", "main")) and page.tag[i] not in apart
    good = [t for t, k in zip(page.text, inside) if k and t]
    rest = [t for t, k in zip(page.text, inside) if not k and t]
    return (good, rest) if good else None


_NEUTRAL = ("row", "col", "wrap", "container", "inner", "block", "box", "grid", "panel", "module", "region", "layout", "unit", "c1", "x")
_BOILER = (  # tag, attribute, kind of inside
    ("nav", "", "list"), ("div", 'class="nav"', "list"), ("ul", 'class="menu"', "items"), ("div", 'id="menu"', "list"), ("nav", 'class="breadcrumb"', "list"),
    ("header", "", "mixed"), ("div", 'class="header"', "mixed"), ("div", 'id="masthead"', "mixed"), ("footer", "", "line"), ("div", 'class="footer"', "line"),
    ("div", 'id="footer"', "list"), ("aside", "", "mixed"), ("div", 'class="sidebar"', "mixed"), ("div", 'id="sidebar"', "list"), ("div", 'class="related"', "list"),
    ("section", 'class="related-posts"', "list"), ("div", 'class="ad"', "line"), ("div", 'class="ads banner"', "line"), ("div", 'class="sponsored"', "text"),
    ("div", 'class="promo"', "text"), ("div", 'class="cookie-notice"', "text"), ("div", 'id="cookie-banner" role="dialog"', "text"), ("div", 'class="notice"', "text"),
    ("div", 'class="alert"', "line"), ("section", 'id="comments"', "comments"), ("div", 'class="comments"', "comments"), ("div", 'class="comment-list"', "comments"),
    ("ol", 'class="commentlist"', "comments"), ("form", "", "form"), ("form", 'class="search"', "form"), ("div", 'class="newsletter subscribe"', "form"),
    ("div", 'class="share social"', "list"), ("div", 'class="widget"', "list"), ("div", 'class="copyright"', "line"), ("div", 'role="navigation"', "list"),
    ("div", 'role="complementary"', "mixed"), ("div", 'role="contentinfo"', "line"), ("div", 'class="popup modal"', "text"), ("table", 'class="links"', "cells"),
)
_MAIN = (
    ("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="post-content entry-content"'), ("section", 'class="article-body"'),
    ("div", 'class="story"'), ("div", 'itemprop="articleBody"'), ("div", 'role="main"'), ("div", 'id="main"'), ("div", None), ("section", None), ("article", 'class="post"'),
    ("div", 'class="text"'), ("td", 'class="body"'),
)


class Layout:
    """Renders a training page; texts of the article carry a mark, from which block labels follow."""

    MARK = "⁣"

    def __init__(self, rng: random.Random, good: list[str], rest: list[str]):
        self.rng, self.good, self.rest = rng, good, rest or ["Home", "About us", "Contact"]

    def page(self) -> str:
        rng = self.rng
        before = [self.boiler() for _ in range(rng.randint(0, 3))]
        after = [self.boiler() for _ in range(rng.randint(0, 4))]
        body = self.body()
        if rng.random() < 0.3:
            body = self.wrap(body + self.boiler(["aside", "sidebar", "related"]) if rng.random() < 0.5 else body)
        if rng.random() < 0.3:
            body = self.wrap("".join(before) + body + "".join(after))
            before = after = []
        return f"<html><head><title>{self.short()}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"

    def body(self) -> str:
        rng = self.rng
        tag, attribute = rng.choice(_MAIN)
        attribute = f'class="{rng.choice(_NEUTRAL)}"' if attribute is None else attribute
        out = []
        inserts = rng.choice([0.0, 0.0, 0.05])
        for i, text in enumerate(self.pieces()):
            marked = self.marked(text)
            inside = self.inline(marked) if rng.random() < 0.3 else marked
            block = "h1" if i == 0 and rng.random() < 0.7 else rng.choice(["p"] * 16 + ["h2", "blockquote", "pre", "div", "li", ""])
            if block == "li":
                out.append(f"<ul><li>{inside}</li></ul>")
            elif not block:
                out.append(inside)
            else:
                out.append(f"<{block}>{inside}" + ("" if block == "p" and rng.random() < 0.1 else f"</{block}>"))
            if rng.random() < inserts:
                out.append(self.boiler())
        if rng.random() < 0.15:
            out.insert(0, f"<header>{out.pop(0)}</header>")
        if rng.random() < 0.05:
            out = ["<br>".join(self.marked(t) for t in self.good)]
        inner = "".join(out)
        if tag == "td":
            return f"<table><tr><td><ul>{self.links()}</ul></td><td {attribute}>{inner}</td></tr></table>"
        return f"<{tag} {attribute}>{inner}</{tag}>"

    def pieces(self) -> list[str]:
        """The article's words, cut anew: article paragraphs may be of any length."""
        rng = self.rng
        words = " ".join(self.good).split()[: rng.choice([8, 30, 120, 400, 800])]
        low, high = rng.choice([(1, 12), (4, 30), (15, 80), (1, 80)])
        out, at = [], 0
        while at < len(words):
            n = rng.randint(low, high)
            out.append(" ".join(words[at : at + n]))
            at += n
        return out

    def marked(self, text: str) -> str:
        return self.MARK + html.escape(text)

    def inline(self, text: str) -> str:
        tag = self.rng.choice(["b", "em", "a", "span"])
        words = text.split(" ")
        at = self.rng.randrange(len(words))
        words[at] = f'<{tag} href="/x">{words[at]}</{tag}>' if tag == "a" else f"<{tag}>{words[at]}</{tag}>"
        return " ".join(words)

    def wrap(self, inner: str) -> str:
        return f'<div class="{self.rng.choice(_NEUTRAL)}">{inner}</div>'

    def short(self) -> str:
        words = self.rng.choice(self.rest).split()
        at = self.rng.randrange(len(words)) if words else 0
        return html.escape(" ".join(words[at : at + self.rng.randint(1, 4)]))

    def long(self) -> str:
        source = self.rng.choice(self.rest if self.rng.random() < 0.5 else self.good)
        words = source.split()
        at = self.rng.randrange(len(words)) if words else 0
        return html.escape(" ".join(words[at : at + self.rng.choice([3, 8, 20, 45, 90])]))

    def links(self, n: int | None = None) -> str:
        return "".join(f'<li><a href="/{k}">{self.short()}</a></li>' for k in range(n or self.rng.randint(2, 9)))

    def boiler(self, like: list[str] | None = None) -> str:
        rng = self.rng
        fitting = [b for b in _BOILER if not like or any(w in b[0] + b[1] for w in like)]
        tag, attribute, kind = rng.choice(fitting)
        if kind == "list":
            inner = f"<ul>{self.links()}</ul>"
        elif kind == "items":
            inner = self.links()
        elif kind == "mixed":
            inner = f"<h2>{self.short()}</h2><p>{self.long()}</p><ul>{self.links()}</ul>" if rng.random() < 0.6 else f"<p>{self.long()}</p>"
        elif kind == "line":
            inner = f"&copy; {self.short()} &middot; {self.long()}" if rng.random() < 0.6 else self.long()
        elif kind == "comments":
            one = lambda: f'<div class="comment"><b>{self.short()}</b><p>{self.long()}</p></div>'
            inner = "".join(f"<li>{one()}</li>" if tag == "ol" else one() for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inner = f'<label>{self.short()}</label><input name="q"><p>{self.long()}</p><button>{self.short()}</button>'
        elif kind == "cells":
            inner = "".join(f"<tr><td><a href='/'>{self.short()}</a></td></tr>" for _ in range(rng.randint(2, 6)))
        else:
            inner = f"<p>{self.long()}</p>" if rng.random() < 0.6 else self.long()
        return f"<{tag} {attribute}>{inner}</{tag}>"


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """The page as the reader sees it, and which blocks hold marked text."""
    page = Page(source)
    marked = np.array([Layout.MARK in t for t in page.text])
    page.text = [t.replace(Layout.MARK, "") for t in page.text]
    for i in range(len(page.tag) - 1, 0, -1):
        marked[page.parent[i]] |= marked[i]
    return page, marked


def train(sources: list[str], layouts: int = LAYOUTS, seed: int = 5) -> Boosted:
    rng = random.Random(seed)
    x, y, w = [], [], []

    def learn(source: str) -> None:
        page, marked = labelled(source)
        if marked.any():
            x.append(features(page)[1:])
            y.append(marked[1:])
            w.append(1.0 + np.log1p([len(t) for t in page.text])[1:])

    found = [p for p in map(parts, sources) if p] or [(["This is the text of an article. It has sentences."] * 3, ["Home", "About us", "Contact"])]
    for good, rest in found:
        for _ in range(layouts):
            learn(Layout(rng, good[: rng.randint(1, len(good))], rest).page())
    return Boosted().fit(np.concatenate(x), np.concatenate(y).astype(float), np.concatenate(w))


def fit(pages: DataFrame, source: str = "html", train_pages: int = TRAIN_PAGES) -> Boosted:
    """Train on about ``train_pages`` pages of at most 100,000 characters, picked by a hash of their source."""
    rows = pages.select(F.col(source).alias("html")).filter(F.length("html").between(1, 100_000))
    n = rows.count()
    place = F.pmod(F.xxhash64("html"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(place < min(1.0, train_pages / max(n, 1))).dropDuplicates()
    return train(sorted(r["html"] for r in picked.collect()))


def extract(model: Boosted, sources: list[bytes | None]) -> list[str]:
    pages = [Page((s or b"").decode("utf-8", "replace")) for s in sources]
    rows = [features(p) for p in pages]
    odds = model.logits(np.concatenate(rows)) if rows else np.empty(0)
    ends = np.cumsum([len(r) for r in rows])
    return [main_text(p, odds[e - len(r) : e]) for p, r, e in zip(pages, rows, ends)]


def with_main_text(pages: DataFrame, model: Boosted, source: str = "html") -> DataFrame:
    """``pages`` with main_text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(sources: list[bytes | None]) -> dict:
        texts = extract(shared.value, sources)
        return {"main_text": texts, "n_chars": [len(t) for t in texts]}

    return with_columns_from(pages, source, _WORDS, run)


def report(pages: DataFrame) -> DataFrame:
    model = fit(pages)
    found = with_main_text(pages.select("page_id", "url", "html"), model)
    return found.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


