"""Queries over whole tables: equal to their twins, and every row of the table is there."""

import pytest

from tests.oracle import check, duck

#: The rows that must be covered, counted from the tables alone.
DOCS = "SELECT count(DISTINCT l_orderkey // 50) FROM lineitem"
BOXES = "SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"
WHOLE = {
    "set1_append_queue": ("count(*) / 2", BOXES), "evl1_template_coverage": ("sum(n_rows)", BOXES), "tpl13_apply_template_all_pages": ("count(DISTINCT doc_id)", DOCS),
    "snk5_select_layout_compatible": ("sum(n)", BOXES), "dif2_compute_diffs": ("count(DISTINCT row_no)", "SELECT count(DISTINCT l_orderkey) FROM lineitem"), "src8_load_parser_config": ("count(DISTINCT name)", "SELECT count(*) FROM part"),
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table(spark, small, name):
    from docrec.plans.registry import ORACLES, QUERIES  # needs a session

    sql, (covered, wanted) = ORACLES[name], WHOLE[name]
    check(QUERIES[name](spark, small), sql, small)
    count = lambda q: duck(q, small).iloc[0, 0]
    assert count(f"SELECT {covered} FROM ({sql})") == count(wanted)
