"""Hand-written cases for semantics that are easily lost."""

from pyspark.sql import functions as F

from docrec.functions import scalar as sc
from docrec.operators import blocks, geometry, jsonrows, lookups, registry
from docrec.operators import detection as de
from docrec.sources import pages


def one(spark, expr, *values):
    cols = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{c} string" for c in cols)).select(expr(*map(F.col, cols)).alias("r")).first()["r"]


def test_numbers(spark):
    got = [one(spark, sc.coerce_numeric, v) for v in ("22,754", "22,754.000 KGS", "1.234,5", "KGS", "-3,5", "1,2345")]
    assert got == [22.754, 22754.0, 1.2345, None, -3.5, 12345.0]
    assert one(spark, lambda c: sc.coerce_numeric(c, thousands="comma"), "22,754") == 22754.0


def test_lines_hold_to_their_first_top(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0, 9.0],)], "tops array<double>")
    assert df.select(geometry.line_starts(F.col("tops"), 4.0).alias("s")).first()["s"] == [1.0, 9.0]


def test_upper_median_gap(spark):
    tops = [0.0, 1.0, 3.0, 6.0, 16.0]  # gaps 1, 2, 3, 10: the upper median is 3, so 10 opens a block
    rows = [(1, 1, i, i, f"w{i}", 0.0, t, 1.0, t + 0.5) for i, t in enumerate(tops)]
    w = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, word_no int, text string, x0 double, top double, x1 double, bottom double")
    assert [tuple(r) for r in blocks.blocks_by_gap(w).orderBy("block_no").select("y_start", "y_end").collect()] == [(0.0, 6.5), (16.0, 16.5)]


def test_dates(spark):
    parts = lambda c: F.array(*sc.split_date(c, lookups.MONTHS))
    assert one(spark, parts, "1-2-26") == ["2026", "Février", "1"]
    assert one(spark, parts, "7.13.2020") == ["2020", "13", "7"]
    assert one(spark, parts, "16-JAN-26") == ["", "", ""]


def test_similarity(spark):
    assert round(one(spark, sc.fuzz_ratio, "LOADING", "L0ADING"), 3) == 85.714
    assert one(spark, sc.fuzz_ratio, "", "x") == 0.0


def test_carrier_by_three_letters_and_raw_fallback(spark):
    dim = lookups.dimensions(spark)["carrier"]
    b = spark.createDataFrame([("ZIMA1", ""), ("QQQQ1", "Own Line"), ("", "helios")], "bl string, fallback string")
    got = {r["bl"]: (r["code"], r["name"]) for r in lookups.carrier(b, dim).collect()}
    assert got["QQQQ1"] == ("", "Own Line") and got[""] == ("HLCX", "HELIOS")
    zim = spark.createDataFrame([("zima", "X", "Y", 0)], "prefix string, code string, name string, ord int")
    assert lookups.carrier(spark.createDataFrame([("ZIMU1", "")], "bl string, fallback string"), zim).first()["code"] == "X"


def test_truncated_json_inside_a_string(spark):
    raw = '{"vessel":"A","rows":[{"bl_number":"a}b{","page":2},{"bl_number":"{cut'
    df = spark.createDataFrame([(1, 0, raw), (2, 0, '```json\n{"vessel":"B","rows":[]}\n```'), (3, 0, None)], "doc_id int, chunk_no int, raw string")
    got = jsonrows.flatten_rows(df).collect()
    assert [(r["doc_id"], r["bl_number"], r["page"], r["vessel"], r["split_number"]) for r in got] == [(1, "a}b{", 2, "A", 1)]


def test_pages_without_marker_and_blank_pages(spark):
    docs = spark.createDataFrame([(1, "one\n"), (2, "=== PAGE 1 ===\na\n=== PAGE 2 ===\n \n=== PAGE 3 ===\nb"), (3, None)], "doc_id int, text string")
    got = [(r["doc_id"], r["page_no"], r["text"].strip()) for r in pages.split_pages(docs).orderBy("doc_id", "page_no").collect()]
    assert got == [(1, 1, "one"), (2, 1, "a"), (2, 3, "b")] or got == [(1, 1, "one"), (2, 1, "a"), (2, 2, "b")]


def test_number_formats(spark):
    df = spark.createDataFrame([(10.0,), (2.5,), (0.0,)], "x double").select(sc.trim_number(F.col("x"), 2).alias("t"))
    assert [r["t"] for r in df.collect()] == ["10", "2.5", ""]


def test_oversize_pages_are_split(spark):
    pages = [(1, 1, "abc"), (1, 2, "aaaa\nbbbb\n\ncc\n" + "d" * 23), (1, 3, "x"), (1, 4, "y" * 5), (2, 1, None), (2, 2, "z" * 10), (3, 1, "eeee\r\nfff\rgggg")]
    got = de.pack_chunks(spark.createDataFrame(pages, "doc_id int, page_no int, text string"), 10).orderBy("doc_id", "chunk_no", "page_no", "start").collect()
    texts, chunks = {(d, p): t or "" for d, p, t in pages}, {}
    for r in got:
        chunks.setdefault((r["doc_id"], r["chunk_no"]), []).append(texts[r["doc_id"], r["page_no"]][r["start"] - 1 : r["start"] - 1 + r["length"]])
    assert [chunks[k] for k in sorted(chunks)] == [["abc"], ["aaaa\nbbbb\n"], ["\ncc\n"], ["d" * 10], ["d" * 10], ["ddd"], ["x", "y" * 5], [""], ["z" * 10], ["eeee\r\nfff\r"], ["gggg"]]
    assert all(sum(map(len, c)) <= 10 for c in chunks.values())


def test_simple_signature_words_are_whole(spark):
    docs = spark.createDataFrame([(1, "EMSC sailing"), (2, "by msc,\nline"), (3, "the big  Ship co."), (4, "MSC_1")], "doc_id int, text string")
    formats = spark.createDataFrame([("a", ["msc", " "]), ("b", ["big\nship C"])], "name string, signature array<string>")
    assert {r["doc_id"]: r["name"] for r in de.detect_signature(docs, formats).collect()} == {2: "a", 3: "b"}


def test_never_filled_fields(spark):
    rows = spark.createDataFrame([(1, "s", None, "1", ""), (1, None, None, "", ""), (2, "", "c", "2", "p")], "doc_id int, shipper string, consignee string, weight string, port_of_loading string")
    assert {r["doc_id"]: r["missing"] for r in registry.never_filled(rows).collect()} == {1: ["consignee", "port_of_loading", "port_of_discharge"], 2: ["shipper", "port_of_discharge"]}


def test_whole_operators_equal_their_twins(spark, small):
    from docrec.plans.registry import ORACLES, QUERIES  # needs a session
    from tests.oracle import check

    for name in ("det2_detect_signature", "det12_pack_chunks_split", "evl1_never_filled"):
        check(QUERIES[name](spark, small), ORACLES[name], small)
