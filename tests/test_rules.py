"""Hand-written cases of text similarity, rules, label mapping, templates and segments."""

import random

from pyspark.sql import functions as F

from docrec.functions import scalar as sc
from docrec.operators import auto_map as am
from docrec.operators import box_templates as bt
from docrec.operators import differences as di
from docrec.operators import geometry as ge
from docrec.operators import rules as ru
from docrec.operators import segments as sg

WORDS = "doc_id long, page_no int, word_no int, text string, x0 double, top double, x1 double, bottom double"
TOKENS = "doc_id long, page_no int, token_no int, line_id int, text string, x int, y int, w int, h int, conf double"


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for ch in a:
        row = next_row(row, ch, b)
    return row[-1]


def next_row(row, ch, b):
    out = [0]
    for j, c in enumerate(b):
        out.append(max(out[-1], row[j + 1], row[j] + 1 if c == ch else 0))
    return out


def words_of(spark, *lines):
    rows, n = [], 0
    for at, line in enumerate(lines):
        x = 0.0
        for w in line.split():
            rows.append((1, 1, n, w, x, at * 12.0, x + len(w) * 6.0, at * 12.0 + 11))
            x, n = x + len(w) * 6.0 + 6, n + 1
    return ge.group_lines(spark.createDataFrame(rows, WORDS))


def test_similarity_equals_the_table_of_lengths_at_any_length(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé") for _ in range(n)) for n in (0, 1, 2, 7, 30, 61, 62, 63, 64, 90, 130)]
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sc.fuzz_ratio(F.col("a"), F.col("b")).alias("r"), sc.ratio_bound(F.col("a"), F.col("b")).alias("most")).collect()
    for r in got:
        want = 100.0 if not r.a and not r.b else 200.0 * lcs(r.a, r.b) / (len(r.a) + len(r.b))
        assert abs(r.r - want) < 1e-9 and r.most >= r.r - 1e-9


def test_numbers_and_dates_in_values(spark):
    rows = [("number", "; 12 345,6 kg", "12 345,6"), ("date", "on 3 March 2024 |", "3 March 2024"), ("date", "2024-05-06", "2024-05-06"), ("string", "-x-", "x"), ("number", None, None)]
    got = spark.createDataFrame(rows, "k string, v string, want string").select("want", sc.post_process(F.col("k"), F.col("v")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_rule_dispatch_takes_the_anchor_cascade_and_cuts(spark):
    lines = words_of(spark, "Port of Loading RIGA NOTIFY LATVIA behind me", "Consignee", "ACME & SONS STOP here", "CONSIGNEEX")
    found = lambda df: {r.field: r.value for r in df.collect()}
    template = [
        {"field_name": "pol", "anchor_text": ["port", "of", "loading"], "stop_at": ["BEHIND"]},
        {"field_name": "consignee", "anchor_text": ["CONSIGNEE"], "direction": "below", "max_distance": 25, "x_tolerance": 200, "stop_at": ["zzz", "Stop"]},
        {"field_name": "longest", "anchor_text": ["of", "Consignes"], "direction": "below", "max_distance": 25, "x_tolerance": 40, "max_words": 1},
        {"field_name": "sideways", "anchor_text": ["CONSIGNEE"], "direction": "diagonal"},
    ]
    assert found(ru.apply_template_rules(lines, template)) == {"pol": "RIGA LATVIA", "consignee": "ACME & SONS", "longest": "ACME"}
    assert found(ru.apply_config_rules(lines, {"a": {"regex": "acme (.*?) STOP"}, "b": {"fuzzy_label": "consigneeq"}, "c": {"bbox": [0, 20, 1, 30]}})) == {"a": "& SONS", "b": "ACME & SONS STOP"}
    assert found(ru.apply_template_rules(lines, [])) == found(ru.apply_config_rules(lines, {})) == found(ru.apply_template_rules(lines.limit(0), template)) == {}


def test_rules_that_are_no_json_or_lack_parts(spark):
    raw = spark.createDataFrame([(1, "not json"), (2, None), (3, "{}"), (4, '{"format_name": "a", "field_rules": [{"field_name": "f"}]}')], "doc_id long, json string")
    (r,) = ru.load_rules(raw).collect()
    assert (r.doc_id, r.anchor_text, r.direction, r.max_distance, r.stop_at, r.scope) == (4, [], "right", 250.0, [], "page")
    assert {t.doc_id: t.weight_scope for t in ru.load_templates(raw).collect()} == dict.fromkeys((1, 2, 3, 4), "per_bl")


def test_label_mapping_prefers_the_first_of_equals_and_looks_below(spark):
    rows = [(1, 1, 0, 0, "Gross", 0, 0, 30, 10, 90.0), (1, 1, 1, 0, "weight:", 40, 0, 40, 10, 90.0), (1, 1, 2, 1, "12", 40, 15, 12, 10, 90.0), (1, 1, 3, 1, "KGS", 60, 15, 18, 10, 90.0), (1, 1, 4, 2, "weight", 0, 60, 40, 10, 90.0), (1, 1, 5, 3, "99", 0, 75, 12, 10, 90.0)]
    t = spark.createDataFrame(rows, TOKENS)
    fields = [("weight", "number", ["weight"]), ("gross", "string", ["gross weight"]), ("none", "string", [""])]
    got = {r.field: (r.value, r.x, r.y, r.w, r.h) for r in am.auto_map(t, fields).collect()}
    assert got == {"weight": ("12", 40, 15, 38, 10), "gross": ("12 KGS", 40, 15, 38, 10)}
    assert am.auto_map(t.limit(0), fields).count() == am.auto_map(t, [("none", "string", [])]).count() == 0


def test_templates_on_pages_without_tokens_or_anchors(spark):
    t = spark.createDataFrame([(1, 1, 0, 0, "12", 0, 0, 12, 10, 90.0)], TOKENS)
    boxes = spark.createDataFrame([(1, 1, "f", 5, 5, 10, 10)], "doc_id long, page_no int, field string, x int, y int, w int, h int")
    size = spark.createDataFrame([(1, 1, 100, 100)], "doc_id long, page_no int, width int, height int")
    (made,) = bt.build_template(boxes, t, size).collect()
    assert (made.boxes[0].anchor_text, made.boxes[0].dx, made.anchors) == ("", 0.0, None)
    assert bt.nearest_anchors(boxes, t.limit(0)).count() == bt.locate_anchors(boxes.withColumn("anchor_text", F.lit("")), t).count() == 0
    assert bt.single_cells(t.limit(0), boxes).collect()[0].text == ""


def test_marks_read_wrongly_and_cargo_in_other_spellings(spark):
    text = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t"))).first()[0]
    assert text(sg.normalize_ocr, "eaifIO5Z xEAIFSOLDX LÆANÚe ¶") == "EAIF1052 xEAIFSOLDX L'ANEe O"
    assert text(sg.normalize_ocr, None) is None
    assert text(sg.clean_port, " RIGA,  LATVIA,/  Service x") == "RIGA,  LATVIA" and text(sg.clean_port, " one") == "one"
    assert text(sg.infer_description, "nothing") == ""
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "EAIF123")], "doc_id long, text string")
    assert [(r.ref, r.description, r.weight) for r in sg.segment_fields(empty).collect()] == [("EAIF123", None, None)]
    assert sg.by_description(empty).count() == 0 and sg.header_fields(empty.withColumn("page_no", F.lit(1))).count() == 3


def test_differences_pass_over_values_that_are_not_found(spark):
    lines = words_of(spark, "WEIGHT 1,250 KGS net 9")
    rows = spark.createDataFrame([(1, None, 0, "125", "0", ""), (1, 9, 1, "net", None, "WEIGHT")], "doc_id long, page_no int, row_no int, weight string, volume string, shipper string")
    got = {(r.row_no, r.field): (r.candidate, r.candidate_anchor) for r in di.compute_diffs(rows, lines).collect()}
    assert got == {(0, "weight"): ("1,250", "WEIGHT"), (1, "weight"): ("1,250", "WEIGHT"), (1, "shipper"): (None, None)}
