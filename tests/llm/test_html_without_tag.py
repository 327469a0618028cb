"""Extraction where no tag tells the article: renamed elements, plain wrappers, and tables without any labelled page."""

import re
from collections import Counter

import pytest

from docrec.llm import html_extraction as hx
from docrec.llm.html_blocks import blocks

TEXT = "<h1>Title of the page</h1><p>This is the first paragraph of the text, with a comma and an end.</p><p>The second one goes on about the same thing for a while.</p><p>And a third, shorter.</p>"
WANT = "\n\n".join(re.findall(r">([^<]+)</", TEXT))
MENU = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul></nav>"
FOOT = "<footer>&copy; 2020 example.com</footer>"


@pytest.fixture(scope="module")
def pages(spark, small):
    return [r["html"] for r in spark.read.parquet(f"{small.replace('0.001', '0.01')}/pages.parquet").select("html").collect()]


@pytest.fixture(scope="module")
def weights(pages):
    from docrec.llm import crf

    return crf.trained(hx.labelled(pages[:120]), hx.FEATURES)


def article_blocks(page):
    return Counter(b.text for b in blocks(page) if hx.marked(b))


@pytest.mark.parametrize("tag", ["article", "main", "div", "section", "center"])
def test_renamed_articles_keep_their_blocks(pages, weights, tag):
    held = pages[120:]
    got = hx.main_texts([re.sub(r"(</?)article(?=[\s>])", rf"\g<1>{tag}", p) for p in held], weights)
    want = [article_blocks(p) for p in held]
    lost = sum(sum((w - Counter(g.split("\n\n"))).values()) for w, g in zip(want, got))
    extra = sum(sum((Counter(g.split("\n\n") if g else []) - w).values()) for w, g in zip(want, got))
    assert lost < 0.01 * sum(sum(w.values()) for w in want) and extra < 0.01 * sum(sum(w.values()) for w in want)


@pytest.mark.parametrize("opening", ["<div>", '<div class="x1">', '<div class="post">', "<section>", '<div class="container"><div class="row"><div class="col">', "", "<table><tr><td>"])
def test_pages_in_plain_wrappers(weights, opening):
    closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
    notice = '<div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>OK</button></div>'
    comment = '<div id="comments"><div class="comment"><p>Nice text, thank you very much for it.</p></div></div>'
    shown = [f"<html><body>{MENU}{opening}{TEXT}{closing}{FOOT}</body></html>", f"<body>{notice}{opening}{TEXT}{closing}{comment}</body>"]
    assert hx.main_texts(shown, weights) == [WANT, WANT]


def test_a_table_without_any_labelled_page(spark, pages):
    bare = [re.sub(r"(</?)article(?=[\s>])", r"\g<1>div", p) for p in pages]
    df = spark.createDataFrame([(k, "u", p) for k, p in enumerate(bare)] + [(-1, "u", None), (-2, "u", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in hx.extracted(df, hx.trained(df)).collect()}
    assert got[-1] == got[-2] == ""
    long = [(k, t) for k, p in enumerate(pages) for t in article_blocks(p) if len(t) >= 40]
    assert sum(t in got[k].split("\n\n") for k, t in long) > 0.99 * len(long)
    assert not any("©" in t for t in got.values())
    assert not hx.trained(df.limit(0)).emit.any()
