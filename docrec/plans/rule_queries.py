"""Registered queries of rules, their dispatchers, label mapping, box templates and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrec.functions import scalar as sc
from docrec.operators import auto_map as am
from docrec.operators import box_templates as bt
from docrec.operators import differences as di
from docrec.operators import rules as ru
from docrec.plans.fixture_sql import BILL, LINES, TEXT, WORDS
from docrec.plans.queries import LCS, lines, manifest_words, query
from docrec.plans.more_queries import tokens
from docrec.sources import fixtures as fx

PAGE_OF = "k // 50 AS doc_id, (k % 50 // 10 + 1)::INT AS page_no"
#: The first bill of each page, with its number of boxes.
FIRST = f", first_bill AS (SELECT {PAGE_OF}, *, (SELECT count(*) FROM box b WHERE b.k = bill.k) AS boxes FROM bill QUALIFY row_number() OVER (PARTITION BY k // 50, k % 50 // 10 ORDER BY k) = 1)"


@query("""SELECT p_partkey AS doc_id, 'F' || p_partkey AS format_name, 0 AS rule_no, 'f' AS field_name, CASE p_partkey % 4 WHEN 0 THEN 'Port|of' WHEN 1 THEN 'Gross|weight' WHEN 2 THEN 'POL' ELSE '' END AS label,
CASE WHEN p_partkey % 2 = 0 THEN 'below' ELSE 'right' END AS direction, CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 250 END::DOUBLE AS max_distance, 8 AS max_words, CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END AS stops, 80 AS fuzzy_threshold, 'page' AS scope FROM part""")
def src7_load_rules(spark, d):
    (part,) = fx.tables(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    rule = F.when(k % 4 == 0, F.concat(F.lit('"anchor_text": ["Port", "of"], "direction": "Below", "max_distance": '), size)).when(k % 4 == 1, '"anchor": " Gross weight ", "anchor_text": []').when(k % 4 == 2, '"label": "POL", "direction": "below", "stop_at": ["X"]').otherwise('"direction": ""')
    names = F.when(k % 2 == 0, '"name": "F').otherwise('"format_name": "F')
    json = F.concat(F.lit("{"), names, k.cast("string"), F.when(k % 3 == 0, '", "spatial_rules": [{').otherwise('", "field_rules": [{'), F.lit('"field_name": "f", '), rule, F.lit("}]}"))
    r = ru.load_rules(part.select(k.alias("doc_id"), json.alias("json")))
    return r.select("doc_id", "format_name", "rule_no", "field_name", F.array_join("anchor_text", "|").alias("label"), "direction", "max_distance", "max_words", F.size("stop_at").alias("stops"), "fuzzy_threshold", "scope")


@query(f"""WITH {BILL}{FIRST}, v AS (SELECT doc_id, page_no, unnest(['shipper', 'weight', 'carrier', 'number', 'consignee']) AS field, unnest([shipper, weight::VARCHAR, bl[:4], 'B/L NO. ' || bl, consignee]) AS value FROM first_bill)
SELECT doc_id, page_no, field, value FROM v""")
def anc8_apply_rule_config(spark, d):
    rules = {
        "shipper": {"label_anchor": "Shipper", "direction": "right", "max_distance": 250},
        "weight": {"fuzzy_label": "weights", "direction": "right", "max_distance": 100, "max_words": 2, "stop_at": "kgs", "regex_clean": "([0-9]+)"},
        "carrier": {"regex": "b/l no[.] ([a-z]+)"},
        "number": {"bbox": [0, 0, 1000, 12]},
        "consignee": {"label_anchor": "SHIPPER", "x_tolerance": 200},
        "absent": {"label_anchor": "Nowhere"},
        "broken": {"regex": "("},
    }
    return ru.apply_config_rules(lines(spark, d), rules).drop("rule_no")


@query(f"WITH {BILL}{FIRST} SELECT doc_id, page_no, unnest(['port_of_loading', 'port_of_discharge', 'shipper_above']) AS field, unnest([pol, pod, shipper]) AS value FROM first_bill")
def anc9_apply_rule_template(spark, d):
    rules = [
        {"field_name": "port_of_loading", "anchor_text": ["Port", "of", "loading"]},
        {"field_name": "port_of_discharge", "anchor_text": ["Port", "of", "dischargee"]},
        {"field_name": "shipper_above", "anchor_text": ["CONSIGNEE"], "direction": "above", "max_distance": 25, "x_tolerance": 200, "regex_clean": "SHIPPER (.*)"},
        {"field_name": "none", "anchor_text": []},
    ]
    return ru.apply_template_rules(lines(spark, d), rules).drop("rule_no")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 300 + 0.0 AS lx0, l_partkey % 90 + 0.0 AS ly0, l_partkey % 300 + 42.0 AS lx1, l_partkey % 90 + 11.0 AS ly1, l_quantity * 7 AS vx0, l_quantity * 2.5 AS vy0, l_quantity * 7 + 50 AS vx1, l_quantity * 2.5 + 11 AS vy1 FROM lineitem),
c AS (SELECT *, CASE WHEN abs((vy0 + vy1) / 2 - (ly0 + ly1) / 2) < 11 AND vx0 >= lx0 THEN 'right' WHEN vy0 > ly1 THEN 'below' ELSE 'above' END AS direction FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, direction, (CASE direction WHEN 'right' THEN trunc((vx1 - lx1) * 1.5) + 80 WHEN 'below' THEN trunc((vy0 - ly1) * 1.8) + 20 ELSE trunc((ly0 - vy1) * 1.8) + 20 END)::INT AS max_distance,
CASE WHEN direction <> 'right' THEN trunc(abs((vx0 + vx1) / 2 - (lx0 + lx1) / 2))::INT + 40 END AS x_tolerance, CASE WHEN direction = 'right' THEN 6 END AS y_tolerance, 4 AS max_words FROM c""")
def anc12_infer_rule(spark, d):
    (line,) = fx.tables(spark, d, "lineitem")
    at = lambda x, y, w: F.struct(x.alias("x0"), y.alias("top"), (x + w).alias("x1"), (y + 11).alias("bottom"))
    p, q = F.col("l_partkey"), F.col("l_quantity")
    own = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", at((p % 300).cast("double"), (p % 90).cast("double"), 42.0).alias("a"), at(q * 7, q * 2.5, 50.0).alias("b"))
    return own.withColumn("r", ru.infer_rule("a", "b")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.*")


@query("""WITH f AS (SELECT 'f' || p_partkey AS format_name, p_partkey AS k FROM part), n AS (SELECT unnest(['port_of_loading', 'port_of_discharge', 'shipper', 'consignee', 'weight']) AS field_name, unnest(['right', 'right', 'below', 'below', 'below']) AS direction, unnest([250.0, 250.0, 80.0, 80.0, 80.0]) AS far, unnest([0, 0, 3, 3, 0]) AS stops, unnest(['page', 'page', 'bl_block', 'bl_block', 'bl_block']) AS scope)
SELECT format_name, field_name, CASE WHEN own THEN 'above' ELSE direction END AS direction, (CASE WHEN own THEN 9.0 ELSE far END)::DOUBLE AS max_distance, (CASE WHEN own THEN 1 ELSE stops END)::INT AS stops, CASE WHEN own THEN 'page' ELSE scope END AS scope, CASE WHEN k % 4 = 0 THEN 'per_container' ELSE 'per_bl' END AS weight_scope
FROM (SELECT *, (field_name = 'shipper' AND k % 2 = 0) OR (field_name = 'weight' AND k % 3 = 0) AS own FROM f, n)""")
def evl2_fallback_rules(spark, d):
    (part,) = fx.tables(spark, d, "part")
    k, name = F.col("p_partkey"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("format_name")
    rule = lambda field, m: part.where(k % m == 0).select(name, F.lit(field).alias("field_name"), F.array(F.lit("x")).alias("anchor_text"), F.lit("above").alias("direction"), F.lit(9.0).alias("max_distance"), F.lit(1.0).alias("x_tolerance"), F.lit(1.0).alias("y_tolerance"), F.lit(1).alias("max_words"), F.array(F.lit("x")).alias("stop_at"), F.lit("page").alias("scope"))
    rules, formats = ru.fallback_rules(rule("shipper", 2).unionByName(rule("weight", 3)), part.select(name, F.lit("per_bl").alias("weight_scope")), part.where(k % 4 == 0).select(name, F.lit("per_container").alias("weight_scope")))
    return rules.join(formats, "format_name").select("format_name", "field_name", "direction", "max_distance", F.size("stop_at").alias("stops"), "scope", "weight_scope")


def lined(spark, d):
    return tokens(spark, d).withColumn("line_id", F.floor(F.col("y") / 12).cast("int"))


FIELDS = [("number", "string", ["B/L NO"]), ("shipper", "string", ["exporter", "shippr"]), ("weight", "number", ["gross weight", "WEIGHTS"]), ("none", "string", ["qqqqqq"])]


@query(f"WITH {BILL}{FIRST} SELECT doc_id, page_no, unnest(['number', 'shipper', 'weight']) AS field, unnest([1, 3, 15 + 5 * boxes])::INT AS token_no, unnest([0.923077, 0.923077, 0.923077])::DOUBLE AS score FROM first_bill")
def map1_fuzzy_label_ngrams(spark, d):
    return am.fuzzy_labels(lined(spark, d), FIELDS).withColumn("score", F.round("score", 6))


@query(f"""WITH {WORDS}, l AS (SELECT doc_id, page_no, x0 + (x1 - x0) / 2 AS lcx, x1 - x0 AS lw, top AS ly FROM word WHERE text = 'PKGS' QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY word_no) = 1),
h AS (SELECT doc_id, page_no, word_no AS token_no, text, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY top, x0, word_no)::INT AS place FROM word JOIN l USING (doc_id, page_no) WHERE top > ly + 11 AND top < ly + 44 AND abs(x0 + (x1 - x0) / 2 - lcx) < lw * 4) SELECT doc_id, page_no, 'unit' AS field, 1 AS how, place, token_no, text FROM h WHERE place <= 8""")
def map2_label_value_tokens(spark, d):
    t = lined(spark, d)
    return am.label_values(t, am.fuzzy_labels(t, [("unit", "string", ["pkgs"])])).select("doc_id", "page_no", "field", "how", "place", "token_no", "text")


@query(f"""WITH {BILL}{FIRST} SELECT doc_id, page_no, unnest(['number', 'shipper', 'weight']) AS field, unnest([bl, shipper, weight::VARCHAR]) AS value, unnest([48, 48, 42])::INT AS x, unnest([0, 12, 12 * (5 + boxes)])::INT AS y,
unnest([length(bl) * 6, length(shipper) * 6, (length(weight::VARCHAR) + 4) * 6])::INT AS w, 11 AS h FROM first_bill""")
def map4_auto_map(spark, d):
    return am.auto_map(lined(spark, d), FIELDS).drop("confidence")


SIZES = ", dims AS (SELECT DISTINCT doc_id, page_no, 600 AS width, 800 AS height FROM word)"


def dims(t):
    return t.select("doc_id", "page_no").distinct().select("*", F.lit(600).alias("width"), F.lit(800).alias("height"))


NEAR = """, spot AS (SELECT doc_id, page_no, 'a' AS field, 100 AS x, 50 AS y FROM dims UNION ALL SELECT doc_id, page_no, 'b', 300, 5 FROM dims),
near AS (SELECT doc_id, page_no, field, arg_min({{text: w.text, cx: tcx, cy: tcy}}, (sqrt((s.x - tcx) * (s.x - tcx) + (s.y - tcy) * (s.y - tcy)) - CASE WHEN s.y > tcy THEN 80 ELSE 0 END - CASE WHEN s.x > tcx THEN 30 ELSE 0 END - length(w.text) * 2, word_no)) AS t
  FROM spot s JOIN (SELECT *, x0 + (x1 - x0) / 2 AS tcx, top + 5.5 AS tcy FROM word WHERE length(text) >= 3 AND regexp_matches(text, '[A-Za-z]') AND 30 + word_no % 70 >= 60 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) >= 0.5) w USING (doc_id, page_no) GROUP BY ALL)""".replace("{{", "{").replace("}}", "}")


def spots(t):
    box = lambda f, x, y: F.struct(F.lit(f).alias("field"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(60).alias("w"), F.lit(12).alias("h"))
    return t.select("doc_id", "page_no").distinct().select("*", F.inline(F.array(box("a", 100, 50), box("b", 300, 5))))


@query(f"WITH {WORDS}{SIZES}{NEAR} SELECT doc_id, page_no, field, t.text AS anchor_text, t.cx AS acx, t.cy AS acy FROM near")
def tpl2_nearest_anchor_for_box(spark, d):
    t = tokens(spark, d)
    return bt.nearest_anchors(spots(t), t)


@query(f"WITH {WORDS} SELECT doc_id, page_no, 'f' AS field, x0 + (x1 - x0) / 2 AS acx, top + 5.5 AS acy FROM word WHERE text = 'SHIPPER' QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY word_no) = 1")
def tpl3_locate_anchor(spark, d):
    t = tokens(spark, d)
    return bt.locate_anchors(t.select("doc_id", "page_no", F.lit("f").alias("field"), F.lit("Shippre").alias("anchor_text")).distinct(), t)


STORED = [("one", 1, "SHIPPER", 0.035, 0.022), ("one", 2, "Consigne", 0.04, 0.04), ("two", 1, "CONSIGNEE", 0.5, 0.2), ("two", 2, "nowhere%", 0.1, 0.1), ("three", 1, "Weight", 0.03, 0.2)]
LIKE = ", like_ AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {r} AS rank, {x} AS ax, {y} AS ay, t, ({LCS.format(label=w.lower())}) / 100 AS sim FROM (SELECT DISTINCT lower(text) AS t FROM word)" for n, r, w, x, y in STORED) + ")"
SCORED = f"""{LIKE}, best AS (SELECT doc_id, page_no, name, rank, max(sim * greatest(0.0, 1 - 2.5 * sqrt(pow((x0 + (x1 - x0) / 2) / 600 - ax, 2) + pow((top + 5.5) / 800 - ay, 2)))) AS best FROM word JOIN like_ ON lower(text) = t WHERE sim >= 0.6 GROUP BY ALL),
score AS (SELECT doc_id, page_no, name, sum(best) / max(CASE WHEN name = 'three' THEN 1 ELSE 2 END) AS score FROM best GROUP BY ALL)"""


def template_scores(spark, d):
    t = tokens(spark, d)
    return bt.score_templates(t, dims(t), spark.createDataFrame(STORED, "name string, rank int, text string, x double, y double"))


@query(f"WITH {WORDS}{SCORED} SELECT doc_id, page_no, name, round(score, 6) AS score FROM score")
def tpl4_score_template(spark, d):
    return template_scores(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {WORDS}{SCORED} SELECT doc_id, page_no, name FROM score QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round(score, 9) DESC, name) = 1 AND score >= 0.55")
def tpl5_match_template(spark, d):
    return bt.match_templates(template_scores(spark, d).withColumn("score", F.round("score", 9))).drop("score")


@query(f"WITH {WORDS}, c AS (SELECT doc_id, page_no, CASE WHEN x0 + (x1 - x0) / 2 <= 60 THEN 'a' ELSE 'b' END AS field, line_no::INT AS row, string_agg(text, ' ' ORDER BY word_no) AS text FROM (SELECT *, top // 12 AS line_no FROM word) WHERE line_no < 3 AND x0 + (x1 - x0) / 2 BETWEEN 0 AND 300 GROUP BY ALL) SELECT * FROM c")
def tpl8_table_cells(spark, d):
    t = lined(spark, d)
    pages = t.select("doc_id", "page_no").distinct()
    box = lambda f, x, w: F.struct(F.lit(f).alias("field"), F.lit(x).alias("x"), F.lit(0).alias("y"), F.lit(w).alias("w"), F.lit(11).alias("h"))
    rows = pages.select("*", F.posexplode(F.array(F.lit(5), F.lit(17), F.lit(29))).alias("row", "cy"))
    return bt.table_cells(t, pages.select("*", F.inline(F.array(box("a", 0, 60), box("b", 60, 240)))), rows).where("text <> ''")


@query(f"WITH {BILL}{FIRST} SELECT doc_id, page_no, unnest(['head', 'empty']) AS field, unnest(['B/L NO. ' || bl || chr(10) || 'SHIPPER ' || shipper, '']) AS text FROM first_bill")
def tpl9_single_cells(spark, d):
    t = lined(spark, d)
    box = lambda f, y: F.struct(F.lit(f).alias("field"), F.lit(0).alias("x"), F.lit(y).alias("y"), F.lit(500).alias("w"), F.lit(20).alias("h"))
    return bt.single_cells(t, t.select("doc_id", "page_no").distinct().select("*", F.inline(F.array(box("head", 0), box("empty", 500000)))))


@query(f"WITH {WORDS}{SIZES}{NEAR} SELECT doc_id, page_no, field, round(s.x / 600, 6) AS bx, round(s.y / 800, 6) AS by_, 0.1::DOUBLE AS bw, 0.015::DOUBLE AS bh, coalesce(t.text, '') AS anchor_text, round(coalesce((s.x - t.cx) / 600, 0), 6) AS dx, round(coalesce((s.y - t.cy) / 800, 0), 6) AS dy FROM spot s LEFT JOIN near USING (doc_id, page_no, field)")
def tpl12_build_box_template(spark, d):
    t = tokens(spark, d)
    b = bt.build_template(spots(t), t, dims(t)).select("doc_id", "page_no", F.inline("boxes")).withColumnRenamed("by", "by_")
    return b.withColumns({c: F.round(c, 6) for c in ("bx", "by_", "bw", "bh", "dx", "dy")})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN '1,234.5' WHEN l_quantity >= 12 THEN l_quantity::BIGINT::VARCHAR ELSE '12' END AS candidate,
CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN 'of' WHEN l_quantity >= 12 THEN 'net' ELSE 'of' END AS anchor FROM lineitem WHERE l_quantity <> 12""")
def sc7_largest_number_nearby(spark, d):
    (line,) = fx.tables(spark, d, "lineitem")
    word = lambda c: F.struct(c.alias("text"))
    texts = [F.lit("1.2.345.678"), F.lit("net"), F.col("l_quantity").cast("long").cast("string"), F.lit("12x"), F.lit("of"), F.when(F.col("l_partkey") % 4 == 1, "1,234.5kg").otherwise("12")]
    picked = sc.largest_number(F.when(F.col("l_partkey") % 4 == 0, "shipper").otherwise("weight"), F.array(*map(word, texts)))
    return line.where("l_quantity <> 12").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", picked.alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p.value").alias("candidate"), F.col("p.anchor").alias("anchor"))


NUMBER = "[0-9]{1,3}(?:[ ,.][0-9]{3})*(?:[.,][0-9]{1,3})?"


@query(f"""WITH {LINES}, r AS (SELECT {PAGE_OF}, k AS row_no, unnest(['weight', 'shipper']) AS field, unnest([weight::VARCHAR, shipper]) AS value FROM bill),
f AS (SELECT r.*, (SELECT min(word_no) FROM line l WHERE l.doc_id = r.doc_id AND l.page_no = r.page_no AND lower(replace(l.text, ',', '')) = lower(r.value)) AS word_no FROM r),
a AS (SELECT DISTINCT doc_id, page_no, word_no AS anchor, (x0 + x1) / 2 AS ax, (top + bottom) / 2 AS ay FROM line),
n AS (SELECT doc_id, page_no, anchor, text, row_number() OVER (PARTITION BY doc_id, page_no, anchor ORDER BY top, x0, word_no) AS place FROM line JOIN a USING (doc_id, page_no) WHERE (doc_id, page_no, anchor) IN (SELECT doc_id, page_no, word_no FROM f) AND abs((x0 + x1) / 2 - ax) <= 200 AND abs((top + bottom) / 2 - ay) <= 60 QUALIFY place <= 24),
w AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY doc_id, page_no, anchor ORDER BY place), '') AS before, regexp_extract(text, '^(?:{NUMBER})$|{NUMBER}') AS raw FROM n),
c AS (SELECT doc_id, page_no, anchor, count(*)::INT AS n_nearby, max({{n: TRY_CAST(regexp_replace(replace(replace(raw, ' ', ''), ',', ''), '\\.+$', '') AS DOUBLE), v: raw, b: before}}) FILTER (raw <> '' AND TRY_CAST(regexp_replace(replace(replace(raw, ' ', ''), ',', ''), '\\.+$', '') AS DOUBLE) IS NOT NULL) AS best FROM w GROUP BY ALL)
SELECT f.doc_id, f.page_no, row_no, field, value, word_no, n_nearby, CASE WHEN field = 'weight' THEN best.v END AS candidate, CASE WHEN field = 'weight' THEN best.b END AS candidate_anchor FROM f JOIN c ON f.doc_id = c.doc_id AND f.page_no = c.page_no AND f.word_no = c.anchor""")
def dif2_compute_diffs(spark, d):
    b = fx.bills(spark, d)
    rows = b.select(F.floor(F.col("k") / 50).alias("doc_id"), (F.floor(F.col("k") % 50 / 10) + 1).cast("int").alias("page_no"), F.col("k").alias("row_no"), F.col("weight").cast("string").alias("weight"), "shipper", F.lit("0").alias("volume"), F.lit("").alias("notify"), F.lit("not on any page").alias("seal1"))
    return di.compute_diffs(rows, lines(spark, d)).select("doc_id", "page_no", "row_no", "field", "value", "word_no", F.size("nearby").alias("n_nearby"), "candidate", "candidate_anchor")
