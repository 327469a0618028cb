"""Words stay with their page: no operator shuffles them, and texts are cut into words by batch."""

import random
import re

import pyarrow as pa
import pytest

from docrec.operators import anchors as an
from docrec.operators import blocks as bk
from docrec.operators import geometry as ge
from docrec.plans import queries as qu
from docrec.plans import rule_queries as rq
from docrec.sources.spelled import spelled


def plain(text):
    lines = re.split("\r\n|[\n\v\f\r\x85  ]", text or "")
    return [{"text": m.group(), "at": m.start(), "n": len(m.group()), "line_no": no} for no, line in enumerate(lines) for m in re.finditer(r"[^ \t\n\v\f\r]+", line)]


def test_words_of_a_batch_equal_those_of_each_text():
    rng = random.Random(1)
    for _ in range(500):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab é  \x85€\xa0\r\n\t\v\f 😀") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        assert spelled(pa.array(texts, pa.string()).slice(1)).to_pylist() == [plain(t) for t in texts[1:]]


def words_move(df) -> bool:
    """Whether the plan shuffles rows that have a word's text. Rows that were grouped or joined by page are few; words have all coordinates."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return bool(re.search(r"Exchange hashpartitioning\((?!doc_id#\d+L, page_no#\d+, \d+\))[^\n]*\n[^\n]*(?:Project|Filter)[^\n]*text#", plan))


@pytest.mark.parametrize("name", ["find_label_fuzzy", "value_below", "group_lines", "block_words"])
def test_words_are_not_shuffled(spark, small, name):
    w = qu.manifest_words(spark, small)
    made = {
        "find_label_fuzzy": lambda: an.find_label_fuzzy(w, "Consigner", 80), "value_below": lambda: an.value_below(w, an.find_label(w, "shipper")),
        "group_lines": lambda: ge.group_lines(w), "block_words": lambda: bk.block_words(w, bk.blocks_by_marker(w, "MAEU[0-9]+")),
    }[name]()
    assert made.count() > 0 and not words_move(made)


@pytest.mark.parametrize("query", [rq.map4_auto_map, rq.anc8_apply_rule_config, rq.anc9_apply_rule_template])
def test_texts_are_not_brought_together_from_all_pages(spark, small, query):
    """Frequent words would meet in one task; they are compared where their page is."""
    plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((upper\()?_?t#|Exchange hashpartitioning\(tokens#", plan)
