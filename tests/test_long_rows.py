"""Rows of responses are found in one walk over the text, however long a row is."""

import json
import time

import pyarrow as pa

from docrec.operators import jsonrows as js
from docrec.sources import pages as pg
from docrec.sources import spelled as sp


def test_a_row_with_many_items_takes_linear_time(spark):
    row = json.dumps({"rows": [{"bl_number": "B1", "list": list(range(200_000))}, {"bl_number": "B2"}]})
    df = spark.createDataFrame([(1, 0, row), (1, 1, row[:-2])], "doc_id int, chunk_no int, raw string")
    began = time.time()
    got = js.flatten_rows(df).select("chunk_no", "bl_number", js.F.length(js.F.col("fields")["list"]).alias("n")).collect()
    assert time.time() - began < 40
    assert {(r["chunk_no"], r["bl_number"]) for r in got} == {(0, "B1"), (0, "B2"), (1, "B1"), (1, "B2")} and max(r["n"] or 0 for r in got) > 1_000_000


def test_texts_are_walked_a_few_at_a_time():
    texts = ["{}", None, "", "{" * 50, '1, {"a": "}"}, {"b": 1}] {}']
    for most in (1, 10, 1000):
        assert [t for some in sp.few(pa.array(["x", *texts]).slice(1), most) for t in some.to_pylist()] == texts
    assert js.objects_of_texts(pa.array(["x", *texts]).slice(1)).to_pylist() == [[{"index": 0, "object": "{}"}], None, [], [], [{"index": 1, "object": '{"a": "}"}'}, {"index": 2, "object": '{"b": 1}'}]]
    assert js.objects_of_texts(pa.array([], pa.string())).to_pylist() == []


def test_words_leave_python_a_few_texts_at_a_time(spark, monkeypatch):
    texts = ["a bc\n  d", None, "", "é " * 9, " x", "y\x85z"]
    pages = spark.createDataFrame([(k, 7, t) for k, t in enumerate(texts)], "doc_id long, page_no int, text string")
    together = [tuple(r) for r in pg.words_from_text(pages, lambda p: p.repartition(1, "doc_id")).orderBy("doc_id", "word_no").collect()]
    assert [tuple(r) for r in pg.words_from_text(pages).orderBy("doc_id", "word_no").collect()] == together and len(together) == 15
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(sp.few, "__defaults__", (8,))
    parts = list(sp.spelled_rows(iter([batch])))
    assert [(r["doc_id"], r["word_no"], r["text"]) for p in parts for r in p.to_pylist()] == [(r[0], r[2], r[3]) for r in together] and len(parts) == 3
    assert pg.spelled_words(pa.array(texts)).to_pylist() == sp.spelled(pa.array(texts)).to_pylist()
