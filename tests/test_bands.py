"""Ranges and words of a page by bands against all pairs."""

import random

from docrec.operators import geometry as ge


def test_words_in_boxes_equal_all_pairs(spark):
    rng = random.Random(8)
    words = [(1, 1 + k % 2, k, f"w{k}", x := rng.uniform(0, 600), y := rng.uniform(-20, 900), x + 30, y + 10) for k in range(400)]
    boxes = [(1, 1 + k % 3, k, x := rng.uniform(-50, 600), y := rng.uniform(-60, 900), x + rng.uniform(0, 300), y + rng.choice([0, 5, 60, 400])) for k in range(60)] + [(1, 1, 100, 0.0, -1e12, 700.0, 1e12), (1, 2, 101, 0.0, 500.0, 700.0, 100.0), (1, 1, 102, 0.0, None, 9.0, 1.0)]
    got = ge.words_in_box(spark.createDataFrame(words, "doc_id int, page_no int, word_no int, text string, x0 double, top double, x1 double, bottom double"), spark.createDataFrame(boxes, "doc_id int, page_no int, box int, bx0 double, btop double, bx1 double, bbottom double"))
    want = {}
    for _, p, b, x0, y0, x1, y1 in boxes:
        inside = [w for w in words if w[1] == p and y0 is not None and x0 <= (w[4] + w[6]) / 2 <= x1 and y0 <= (w[5] + w[7]) / 2 <= y1]
        if inside:
            want[b] = len(inside)
    assert {r["box"]: r["n_words"] for r in got.collect()} == want and 100 in want


def test_a_page_of_many_words_and_boxes(spark):
    words = spark.range(200_000).selectExpr("1 AS doc_id", "1 AS page_no", "cast(id AS int) AS word_no", "'w' AS text", "id % 100 * 6.0 AS x0", "floor(id / 100) * 10.0 AS top", "id % 100 * 6.0 + 5 AS x1", "floor(id / 100) * 10.0 + 8 AS bottom")
    boxes = spark.range(10_000).selectExpr("1 AS doc_id", "1 AS page_no", "cast(id AS int) AS box", "0.0 AS bx0", "id * 2.0 AS btop", "11.0 AS bx1", "id * 2.0 + 9 AS bbottom")
    met = ge.meet(ge.derive_geometry(words), boxes, ge.F.col("cy"), ge.F.col("btop"), ge.F.col("bbottom"))
    assert met.where("cx BETWEEN bx0 AND bx1").groupBy("box").count().count() > 8000
