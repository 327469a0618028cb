"""What is shuffled stays small: words and lines stay with their page, the lines of a bill are dealt once."""

import re

from docrec.operators import blocks as bk
from docrec.operators import carrier as ca
from docrec.plans import queries as qu
from docrec.plans import rule_queries as rq

from .test_carrier import BILL, HEADERS, WORDS, page, spread
from .test_page_local import words_move


def run_records(spark, words, headers):
    return ca.records(spark.createDataFrame(words, WORDS), spark.createDataFrame(headers, HEADERS))


def test_blocks_are_dispatched_without_a_shuffle_of_words(spark, small):
    w = qu.manifest_words(spark, small)
    lines = qu.ge.group_lines(w)
    strategies = w.select("doc_id").distinct().selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'page' END AS strategy")
    made = bk.blocks_dispatch(w, lines, qu.BL, strategies=strategies)
    assert made.count() > 0 and not words_move(made)


def test_dispatch_with_repeated_strategies_and_missing_keys(spark):
    row = lambda doc, page, no, text, top: (doc, page, no, text, 0.0, float(top), 9.0, top + 9.0, no)
    words = spark.createDataFrame(
        [row(1, 1, 0, "AB1", 0), row(1, 1, 1, "x", 50), row(2, None, 0, "x", 0), row(2, 1, 0, "AB2", 0), row(3, 1, 0, "x", 0), row(3, 1, 1, "x", 20), row(3, 1, 2, "x", 90), row(None, 1, 0, "AB9", 0)],
        "doc_id long, page_no int, word_no int, text string, x0 double, top double, x1 double, bottom double, line_no int",
    )
    strategies = spark.createDataFrame([(1, "marker"), (1, "PAGE"), (2, "page"), (2, "page"), (3, "")], "doc_id long, strategy string")
    got = sorted(tuple(r)[:4] for r in bk.blocks_dispatch(words.drop("line_no"), words, "AB[0-9]", strategies=strategies).fillna({"page_no": 0}).collect())
    assert got == [(1, 1, 0, ""), (1, 1, 0, "AB1"), (2, 0, 0, ""), (2, 1, 0, ""), (3, 1, 0, "")]


def test_lines_of_a_bill_are_dealt_once(spark):
    """Lines are shuffled by page and by the place where their bill opens, and no more: not for splits, their order or the headers of their pages."""
    made = run_records(spark, page(1, 1, BILL, spread("SPLIT: 1", 250)), [])
    text = made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 1 and not re.search(r"Exchange hashpartitioning\([^)]*(nth#|bill#|_w\d#|_opened#)", text)
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, _page#\d+, _line#\d+, ", text)) == 2  # the lines and the bills


def test_records_of_pages_with_repeated_headers(spark):
    words = page(1, 1, BILL, spread("SPLIT: 1", 250)) + page(1, 2, spread("SPLIT: 2", 250)) + page(2, 1, BILL, spread("SPLIT: 1", 250))
    headers = [(1, 1, "DAWN", "1", None, "Oslo", "Bonn", "", None)] * 2 + [(None, 1, "NONE", "9", None, "Rome", None, None, None)]
    got = run_records(spark, words, headers).collect()
    assert sorted((r["doc_id"], r["page"], r["vessel"] or "", r["port_of_loading"] or "") for r in got) == [(1, 1, "DAWN", "Oslo")] * 4 + [(1, 2, "DAWN", "Oslo")] * 2 + [(2, 1, "", "")]


def test_words_around_a_value_stay_with_their_page(spark, small):
    text = rq.dif2_compute_diffs(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*word_no#", text)
