"""Main text of HTML pages: a linear-chain CRF over DOM leaf blocks, decoded by Viterbi.

The labelled pages are a bounded sample of the corpus (``sample`` pages, a parameter): where a page marks its article with an
``article`` element, that is its label. Each is also shown in other layouts, its paragraphs and its surroundings put into
the wrappers that sites use, most of them without a telling name, and once with the element under another name, so that the
model learns neither one template nor one tag. Features are the tags of a block's ancestors, words of their class, id and
role, shapes of the text of a block and its neighbours, and how much of the page's text stands in the same element; no
feature is a word of the text.

Scale: the sample comes to the driver, the weights (``FEATURES x 2``) go out as a broadcast variable, and every page is then
worked on alone: one map over whole pages, nothing shuffled, in time and memory linear in the page.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrec.llm import crf
from docrec.llm.common import slices, table
from docrec.llm.html_blocks import Block, Path, blocks

FEATURES = 1 << 12
SAMPLE, LONGEST = 200, 1 << 17
MARK = ""


@lru_cache(maxsize=1 << 16)
def named(feature: str) -> int:
    return crc32(feature.encode()) % FEATURES


ENDS = re.compile(r"[.!?…。\"'”’)]\s*\Z")


def own_features(b: Block) -> list[int]:
    """Features of a block but for those of its path."""
    n, words = len(b.text), b.text.count(" ") + 1
    own = ["bias", f"leaf:{b.leaf}", f"len:{min(n, 4095).bit_length()}", f"link:{4 * b.link // n}", f"commas:{min(3, b.text.count(','))}", f"stop:{bool(ENDS.search(b.text))}"]
    own += [f"words:{min(words, 511).bit_length()}", f"upper:{b.text.isupper()}", f"digit:{4 * sum(map(b.text.count, '0123456789')) // n}"]
    if b.text[0] in "©|›»•":
        own.append("sign")
    return [named(f) for f in own]


def block_features(b: Block) -> list[int]:
    return [named(f) for f in sorted(b.path.all())] + own_features(b)


def shape(b: Block | None) -> str:
    """The kind of a neighbour: its leaf, length and share of links."""
    return "none" if b is None else f"{b.leaf}:{min(len(b.text), 1023).bit_length() // 2}:{2 * b.link // len(b.text)}"


def context_features(page: list[Block]) -> list[list[int]]:
    """Of each block, what its page says of it: its neighbours, its length beside the longest, and the share of the page's unlinked text that the element around it has."""
    around = [id(b.path.up or b.path) for b in page]
    free = [len(b.text) - b.link for b in page]
    held: Counter[int] = Counter()
    for up, n in zip(around, free):
        held[up] += n
    total, longest = max(1, sum(free)), max((len(b.text) for b in page), default=1)
    shapes = [shape(None), *map(shape, page), shape(None)]
    before, after = [named(f"before:{x}") for x in shapes[:-2]], [named(f"after:{x}") for x in shapes[2:]]
    same = [False, *(x == y for x, y in zip(around, around[1:])), False]
    with_, mass, beside = ([named(f"{kind}:{k}") for k in range(4)] for kind in ("with", "mass", "beside"))
    return [
        [x, y, mass[min(3, 4 * held[up] // total)], beside[min(3, 4 * len(b.text) // longest)], with_[same[k]], with_[2 + same[k + 1]]]
        for k, (b, up, x, y) in enumerate(zip(page, around, before, after))
    ]


def page_features(page: list[Block]) -> list[list[int]]:
    return [block_features(b) + more for b, more in zip(page, context_features(page))]


def path_scores(paths: list[Path], emit: np.ndarray) -> np.ndarray:
    """The summed weights of each path's features; a path adds its own to what is known of the path around it."""
    known: dict[Path, tuple[float, float]] = {}
    out = np.zeros((len(paths), 2))
    for k, path in enumerate(paths):
        ahead, at = [], path
        while at is not None and at not in known:
            ahead.append(at)
            at = at.up
        score = known[at] if at is not None else (0.0, 0.0)
        for at in reversed(ahead):
            if at.own:
                more = emit[[named(f) for f in at.own]].sum(axis=0)
                score = (score[0] + more[0], score[1] + more[1])
            known[at] = score
        out[k] = score
    return out


# The wrappers of common sites, as (opening, closing) pairs, for the layouts in which labelled pages are shown.
def wraps(*openings: str) -> list[tuple[str, str]]:
    return [(o, "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", o)))) for o in openings]


CONTENT = wraps("<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div id="main-content">', '<div class="post"><div class="entry-content">', '<section class="article-body">', '<div class="story">', '<div role="main">', '<article class="post"><div class="body">', '<div class="page"><div class="text">', '<table><tr><td class="main">', '<div id="main"><div class="article">')
#: Wrappers that say nothing of what is in them; ``{}`` stands for any word.
PLAIN = wraps("<div>", "<section>", '<div class="{}">', '<div id="{}">', '<div class="container"><div class="row"><div class="col">', "<div><div>", '<section class="{}">', "<table><tr><td>", '<div class="wrapper"><div class="{}">', "<center>", "<span>", '<div class="{} {}"><section>') + [("", "")]
HEADER = wraps("<header>", '<div id="header">', '<div class="site-header">', '<div class="masthead">', '<div role="banner">', '<div class="top">', '<header class="header">')
MENU = wraps("<nav><ul>", '<ul class="menu">', '<div class="navbar"><ul>', '<div id="nav">', '<div class="breadcrumb">', '<nav class="breadcrumbs">', '<div class="navigation">', '<div role="navigation"><ul>', '<menu>')
SIDE = wraps("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<section class="widget">', '<div class="side">', '<aside class="recommended">', '<div class="more">', '<td class="sidebar">', '<div class="popular">', '<div class="tags">', '<div class="author-bio">')
NOTICE = wraps("<noscript>", '<div class="cookie-notice">', '<div class="notice">', '<div id="cookies">', '<div role="alert">', '<div class="consent">', '<div class="banner">', '<div class="popup">', '<div class="modal">', '<div role="dialog">', '<div class="gdpr">', '<div class="alert">', '<div class="paywall">', '<div class="disclaimer">')
ADVERT = wraps('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<aside class="ad">', '<div id="ad-top">', '<div class="banner-ad">', '<ins class="adsbygoogle">', '<div class="promotion">')
FORM = wraps("<form>", '<form class="search">', '<div class="newsletter"><form>', '<div class="subscribe">', '<div class="login"><form>', '<form id="contact">', '<div class="signup">')
SHARE = wraps('<div class="share">', '<div class="social">', '<ul class="share-buttons">', '<div class="toolbar">', '<div class="meta">')
COMMENTS = wraps('<div id="comments"><div class="comment">', '<section class="comments"><article class="comment">', '<ol class="commentlist"><li class="comment">', '<div class="comments-area"><div class="comment-body">', '<div class="replies"><div class="reply">', '<div id="disqus-thread"><div>', '<section class="discussion"><div class="user-comment">', '<div class="responses"><div>')
FOOTER = wraps("<footer>", '<div id="footer">', '<div class="footer">', '<div role="contentinfo">', '<div class="site-footer">', '<div class="copyright">', '<div class="bottom">')


def layout(rng: random.Random, article: list[Block], around: list[str], others: list[str]) -> str:
    """One labelled page: the article's blocks, each marked, among surroundings made of the page's own and other pages' text."""

    def some(least: int, most: int, pool: list[str]) -> list[str]:
        return [rng.choice(pool) for _ in range(rng.randint(least, most))] if pool else []

    def inside(pairs: list[tuple[str, str]], parts: list[str]) -> str:
        a, b = rng.choice(pairs)
        return a + "".join(parts) + b

    def short(n: int) -> list[str]:
        return [" ".join(t.split()[: rng.randint(1, 5)]) for t in some(n, n + 5, around + others)]

    def items(n: int, tag: str = "li") -> list[str]:
        return [f'<{tag}><a href="#">{t}</a></{tag}>' for t in short(n)]

    def text(least: int, most: int) -> list[str]:
        tag = rng.choice(("p", "p", "div", "span", "li"))
        return [f"<{tag}>{t}</{tag}>" for t in some(least, most, others + around)]

    def maybe(p: float, part) -> str:
        return part() if rng.random() < p else ""

    menu = lambda: inside(MENU, items(2, rng.choice(("li", "span", "div"))))
    advert = lambda: inside(ADVERT, text(1, 2))
    side = lambda: inside(SIDE, [f"<h3>{' '.join(short(1))}</h3>", *rng.choice((items(2), text(1, 3)))])
    notice = lambda: inside(NOTICE, text(1, 2) + [rng.choice(("", "<button>OK</button>"))])
    form = lambda: inside(FORM, [f"<label>{t}</label><input>" for t in short(1)] + text(0, 1) + ["<button>Go</button>"])
    share = lambda: inside(SHARE, [f'<a href="#">{t}</a> ' for t in short(2)])
    comments = lambda: "".join(inside(COMMENTS, [f"<b>{short(1)[0]}</b>", *[f"<p>{t}</p>" for t in some(1, 3, others)]]) for _ in range(rng.randint(1, 4)))
    def any_word() -> str:
        return "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    body = []
    for k, b in enumerate(article):
        tag = b.leaf if b.leaf in ("h1", "h2", "h3", "li", "blockquote", "pre") else rng.choice(("p", "p", "p", "p", "div", "h2", "blockquote", "li") if k else ("h1", "p"))
        own = MARK + b.text.replace("&", "&amp;").replace("<", "&lt;")
        body.append(f"<ul><{tag}>{own}</{tag}></ul>" if tag == "li" else f"<{tag}>{own}</{tag}>")
        body.append(maybe(0.04, advert) + maybe(0.03, side) + maybe(0.02, form) + maybe(0.03, share) + maybe(0.02, notice))
    parts = [maybe(0.4, notice), inside(HEADER, [f"<div>{' '.join(short(1))}</div>", *rng.choice(([], items(1, "div")))]) if rng.random() < 0.7 else "", maybe(0.8, menu), maybe(0.4, advert), maybe(0.2, side)]
    told, untold = rng.choice(CONTENT), rng.choice(PLAIN)
    opening, closing = told if rng.random() < 0.3 else (re.sub(r"\{\}", lambda _: any_word(), untold[0]), untold[1])
    parts += [opening + "".join([*body, maybe(0.3, share)]) + closing, maybe(0.3, advert), maybe(0.4, side), maybe(0.5, comments), maybe(0.3, form), maybe(0.2, notice), inside(FOOTER, text(1, 2) + rng.choice(([], items(1)))) if rng.random() < 0.9 else ""]
    return f"<html><body>{''.join(parts)}</body></html>"


#: What inside an article is none of it, by element and by the words of class, id or role.
INNER = frozenset(f"t:{t}" for t in "nav header footer aside form menu".split())
INNER |= frozenset(f"n:{n}" for n in "ad ads advert advertisement adsbygoogle sponsored promo promotion cookie cookies consent gdpr notice alert paywall newsletter subscribe signup share social related recommended sidebar comment comments reply replies".split())


#: What no main text is in, where no page says what is.
OUTER = INNER | frozenset(f"n:{n}" for n in "nav navbar menu navigation breadcrumb breadcrumbs header masthead footer bottom copyright banner".split())


def marked(b: Block) -> bool:
    """Whether the page itself says that a block is of its article."""
    path = b.path.all()
    return "t:article" in path and not INNER & path


def likely(b: Block) -> bool:
    """The same where pages do not say: headings and sentences without many links, outside what has the name of something else."""
    return not OUTER & b.path.all() and 2 * b.link < len(b.text) and (b.leaf in ("h1", "h2", "h3") or len(b.text) >= 40)


ARTICLE = re.compile(r"(</?)article(?=[\s>])", re.I)


def labelled(pages: list[str], layouts: int = 5, seed: int = 7) -> list[tuple[list[list[int]], list[int]]]:
    """Features and labels of the sample's pages, each as it is, with its article under another name, and in ``layouts`` other layouts. Where no page marks its article, the likely blocks are the labels."""
    parsed = [blocks(p) for p in pages]
    gold = [[int(marked(b)) for b in own] for own in parsed]
    if not any(map(any, gold)):
        gold = [[int(likely(b)) for b in own] for own in parsed]
    long = [b.text for own, ys in zip(parsed, gold) for b, y in zip(own, ys) if y]
    out = []
    for k, (own, ys) in enumerate(zip(parsed, gold)):
        rng = random.Random(seed * 1_000_003 + k)
        out.append((page_features(own), ys))
        name = rng.choice(("div", "div", "section", "main", "center"))
        renamed = blocks(ARTICLE.sub(rf"\g<1>{name}", pages[k]))
        if [b.text for b in renamed] == [b.text for b in own]:
            out.append((page_features(renamed), ys))
        article, around = [b for b, y in zip(own, ys) if y], [b.text for b, y in zip(own, ys) if not y]
        for _ in range(layouts if article else 0):
            shown = blocks(layout(rng, article, around, rng.sample(long, min(len(long), 12))))
            y = [int(MARK in b.text) for b in shown]
            for b in shown:
                b.text = b.text.replace(MARK, "") or " "
            out.append((page_features(shown), y))
    return out


def trained(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, layouts: int = 5, longest: int = LONGEST) -> crf.Weights:
    """Fit on the ``sample`` pages of at most ``longest`` characters with an ``article`` element whose ids come first in a hash order, or on any such pages, labelled by a rule (`likely`), where none has one; ``sample * longest`` bounds what comes to the driver."""
    short = pages.where(F.length(html_col) <= longest).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(html_col).alias("html"))
    for some in (short.where(F.contains(F.col("html"), F.lit("<article"))), short):
        last = some.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # keys first, so that no task sends a sample of its own
        rows = some.where(F.col("h") <= F.lit(last)).orderBy("h", "html").limit(sample).collect()
        if rows:
            return crf.trained(labelled([r["html"] for r in rows], layouts), FEATURES)
    return crf.Weights(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))


def main_texts(pages: list[str | None], w: crf.Weights) -> list[str]:
    parsed = [blocks(p) if p else [] for p in pages]
    lengths = np.array([len(own) for own in parsed], np.int64)
    every = [b for own in parsed for b in own]
    scores = path_scores([b.path for b in every], w.emit) + crf.emissions(w.emit, [own_features(b) + more for own in parsed for b, more in zip(own, context_features(own))])
    y = crf.viterbi(w, scores, lengths)
    out, at = [], 0
    for own in parsed:
        out.append("\n\n".join(b.text for b, keep in zip(own, y[at : at + len(own)]) if keep))
        at += len(own)
    return out


def extracted(pages: DataFrame, weights: crf.Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars``, one row per page.

    Blocks labelled as content are joined by an empty line in page order; white space within a block is one space.

    * a null or empty page, or one without content, has an empty text; ties between labels fall to what is no content
    * the weights of a table in which no page marks its article come from labels by rule, so its texts are not empty
    * markup that is cut off or does not nest is read as far as it goes; repeated rows, null ids and urls stay as they are
    * an empty table gives an empty result; columns other than these three are not read
    """
    sent = pages.sparkSession.sparkContext.broadcast(weights)  # FEATURES x 2 numbers
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            texts = main_texts(batch.column("html").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return read.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, trained(pages))
