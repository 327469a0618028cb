"""Pages and documents are dealt to tasks by the line items, not by the bytes of their texts."""

import pytest

from docrec.plans import queries as qu
from docrec.sources import fixtures as fx


def placed(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("table", [fx.manifest_text, qu.doc_texts, qu.lines])
def test_tasks_follow_the_line_items(spark, small, monkeypatch, table):
    items = spark.read.parquet(f"{small}/lineitem.parquet").count()
    before = table(spark, small)
    monkeypatch.setattr(fx, "ITEMS_A_TASK", 500)
    after = table(spark, small)
    assert placed(after) == -(-items // 500) > placed(before)
    assert sorted(map(str, after.collect())) == sorted(map(str, before.collect()))


def test_carrier_words_are_made_where_their_page_is(spark, small):
    """Nothing but what a page is made of is shuffled: grouping words by page needs no exchange of words."""
    words = fx.carrier_words(spark, small)
    plan = words.groupBy("doc_id", "page_no").count()._jdf.queryExecution().executedPlan().toString()
    made = plan.index("posexplode")
    assert "Exchange" not in plan[:made] and "Exchange" in plan[made:]
