"""Registered queries of the state machine, segments, box templates, registry and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrec.functions import scalar as sc
from docrec.operators import box_templates as bt

from docrec.operators import lookups as lk
from docrec.operators import manifest_sm as sm
from docrec.operators import registry as rg
from docrec.operators import segments as sg
from docrec.plans.fixture_sql import BILL, RECORD, WORDS
from docrec.plans.queries import manifest_words, query
from docrec.sources import fixtures as fx
from docrec.sources import sinks

@query(f"WITH {BILL} SELECT k // 50 AS doc_id, (k % 50)::INT AS page_no, last_value(CASE WHEN k % 3 = 0 THEN date END IGNORE NULLS) OVER (PARTITION BY k // 50 ORDER BY k) AS date FROM bill")
def sm2_page_header_forward_fill(spark, d):
    b = fx.bills(spark, d).select(F.floor(F.col("k") / 50).alias("doc_id"), (F.col("k") % 50).cast("int").alias("page_no"), F.when(F.col("k") % 3 == 0, F.col("date")).otherwise("").alias("date"))
    return sm.forward_fill(b, "date")


# questionnaire segments


def seg_docs(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    ref = F.concat(F.lit("EAIF"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    part = F.concat(F.lit("goods "), F.col("o_custkey").cast("string"), F.lit(" "), ref, F.lit(" weight "), F.col("o_orderkey").cast("string"), F.lit("\n"))
    return orders.groupBy(F.floor(F.col("o_orderkey") / 20).alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p"))))["p"], "").alias("text"))


@query("""WITH o AS (SELECT o_orderkey // 20 AS doc_id, o_orderkey AS k, 'EAIF' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS ref, 'goods ' || o_custkey || ' ' AS b, ' weight ' || o_orderkey || chr(10) AS a FROM orders),
u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, ref ORDER BY k) = 1)
SELECT doc_id, ref, coalesce(lag(a) OVER w, '') || b AS "between", a || coalesce(lead(b) OVER w, '') AS after FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY k)""")
def seg5_between_marker_segments(spark, d):
    return sg.between_markers(seg_docs(spark, d))


@query("SELECT o_orderkey, 'x EAIF' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' SOLD' AS text FROM orders")
def seg1_normalize_ocr(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    digits = F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
    return orders.select("o_orderkey", sg.normalize_ocr(F.concat(F.lit("x EAIF"), F.translate(digits, "10528", "IOSZB"), F.lit(" SOLD"))).alias("text"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'questionnaire' WHEN 1 THEN 'cargo_table' WHEN 2 THEN 'recap' WHEN 3 THEN 'customs' WHEN 4 THEN 'unknown' WHEN 5 THEN 'questionnaire' WHEN 6 THEN 'recap' ELSE 'questionnaire' END AS kind FROM orders""")
def seg2_classify_page(spark, d):
    """The fixed words in order texts: alone, against each other, and with the first kind's words too few to count."""
    texts = ["QUESTIONNAIRE du capitaine", "Capitaine, pavillon: Shipper {} consignee", "Recapitulation {}", "Ministere: vrac solide, shipper", "{} pavillon et equipage", "pavillon equipage capitaine {}", "total feuillet; destinataire", "Quel est le {}; shipper, destinataire, expediteur? equipage, capitaine"]
    (orders,) = fx.tables(spark, d, "orders")
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return orders.select("o_orderkey", sg.classify_page(F.replace(text, F.lit("{}"), F.col("o_orderpriority"))).alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'key ' || o_custkey ELSE o_orderpriority END AS value FROM orders")
def seg7_keyword_field(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("a first: key \n "), F.col("o_custkey").cast("string"), F.lit(";"))).otherwise(F.concat(F.lit("second="), "o_orderpriority", F.lit(";")))
    return orders.select("o_orderkey", sg.keyword_field(text, [r"first:\s*([^;]+)", r"second=([^;]+)"]).alias("value"))


# box templates and mapping


def tokens(spark, d):
    w = manifest_words(spark, d)
    i = lambda c: c.cast("int")
    return w.select("doc_id", "page_no", F.col("word_no").alias("token_no"), "text", i(F.col("x0")).alias("x"), i(F.col("top")).alias("y"), i(F.col("x1") - F.col("x0")).alias("w"), F.lit(11).alias("h"), (30 + F.col("word_no") % 70).cast("double").alias("conf"))


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, page_no, top + 5.5 AS cy, x0 + (x1 - x0) / 2 AS cx FROM word WHERE x0 + (x1 - x0) / 2 BETWEEN 0 AND 400 AND top + 5.5 BETWEEN 0 AND 200 AND top + 5.5 >= 20 - 5),
c AS (SELECT doc_id, page_no, cy, count(*) AS n, max(cx) - min(cx) AS span FROM p GROUP BY ALL) SELECT doc_id, page_no, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY cy) - 1)::INT AS row, floor(cy)::INT AS cy FROM c WHERE span >= 60 OR n >= 3""")
def tpl7_detect_table_rows(spark, d):
    return bt.table_rows(tokens(spark, d), (0, 0, 400, 200), 20, 10)


@query(f"""WITH {WORDS}, t AS (SELECT *, 30 + word_no % 70 AS conf FROM word WHERE length(text) >= 4 AND regexp_matches(text, '[A-Za-z]')), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY conf DESC, length(text) DESC, top, word_no) AS place FROM t),
o AS (SELECT * FROM f WHERE place <= 24 QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, lower(text) ORDER BY place) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY place)::INT AS rank FROM o) SELECT doc_id, page_no, rank, text, (x0 + (x1 - x0) / 2) / 600 AS x, (top + 5.5) / 800 AS y FROM k WHERE rank <= 8""")
def tpl1_build_anchors(spark, d):
    t = tokens(spark, d)
    dims = t.select("doc_id", "page_no").distinct().select("*", F.lit(600).alias("width"), F.lit(800).alias("height"))
    return bt.build_anchors(t, dims)


@query(f"""WITH {BILL}, n AS (SELECT k, least(50, count(*)) AS m FROM box GROUP BY k), r AS (SELECT k, unnest(range(1, m + 1))::INT AS row, m FROM n), b AS (SELECT k, container, row_number() OVER (PARTITION BY k ORDER BY n)::INT AS row FROM box)
SELECT k AS doc_id, 1 AS page_no, row, 'container' AS field, container AS value FROM r JOIN b USING (k, row) UNION ALL SELECT k, 1, row, 'bl', bl FROM r JOIN bill USING (k)""")
def tpl10_cells_to_rows(spark, d):
    listed = fx.boxes(spark, d).groupBy(F.col("k").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "container")))["container"], "\n").alias("text"))
    cells = listed.select("doc_id", F.lit(1).alias("page_no"), F.lit("container").alias("field"), "text").unionByName(fx.bills(spark, d).select(F.col("k").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("bl").alias("field"), F.concat(F.lit(" "), "bl").alias("text")))
    return bt.cells_to_rows(cells)


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey || '.5' WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'text ' || o_custkey END AS value FROM orders")
def map3_postprocess_value(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    kind = F.when(k == 0, "number").when(k == 1, "date").otherwise("string")
    raw = F.when(k == 0, F.concat(F.lit(": n "), c, F.lit(".5 kg|"))).when(k == 1, F.concat(F.lit("on "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" -"))).otherwise(F.concat(F.lit(" ;text "), c, F.lit(" :")))
    return orders.select("o_orderkey", sc.post_process(kind, raw).alias("value"))


@query(f"WITH {RECORD} SELECT doc_id, row_no, coalesce(vessel, 'AUTO') AS vessel FROM record")
def map5_merge_no_overwrite(spark, d):
    return fx.records(spark, d).select("doc_id", "row_no", bt.merge_no_overwrite(F.col("vessel"), F.lit("AUTO")).alias("vessel"))


# registry and evaluation


def formats(spark, d, shift):
    (part,) = fx.tables(spark, d, "part")
    k = F.col("p_partkey")
    mine = part.where((k + shift) % 3 != 0)
    return mine.select(F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k % 7 == 0, "handcrafted").otherwise(F.lit(f"m{shift}")).alias("model"), F.lit("").alias("carrier"), F.lit(f"t{shift}").alias("template"), ((k * (shift + 3)) % 11).cast("int").alias("row_count"), (k % (4 + shift) != 0).alias("usable"), F.lit(2).alias("samples"))


@query("""WITH o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'handcrafted' ELSE 'm0' END AS model, p_partkey * 3 % 11 AS n, p_partkey % 4 <> 0 AS u FROM part WHERE p_partkey % 3 <> 0), i AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'handcrafted' ELSE 'm1' END AS model, p_partkey * 4 % 11 AS n, p_partkey % 5 <> 0 AS u FROM part WHERE (p_partkey + 1) % 3 <> 0),
j AS (SELECT coalesce(o.k, i.k) AS k, o.model AS om, i.model AS im, o.n AS n0, i.n AS n1, o.u AS u0, i.u AS u1, i.k IS NOT NULL AND coalesce(i.u, false) AND coalesce(o.model, '') <> 'handcrafted' AND NOT (coalesce(o.n, 0) > coalesce(i.n, 0) AND coalesce(o.u, false)) AS take, o.k AS ok, i.k AS ik FROM o FULL JOIN i ON o.k = i.k)
SELECT 'f' || k AS name, coalesce(im, om) AS model, CASE WHEN ok IS NOT NULL THEN '' END AS carrier, CASE WHEN take THEN 't1' WHEN ok IS NOT NULL THEN 't0' END AS template, (CASE WHEN take THEN n1 ELSE n0 END)::INT AS row_count, CASE WHEN take THEN u1 ELSE u0 END AS usable, (CASE WHEN ok IS NULL THEN 0 ELSE 2 END + CASE WHEN ik IS NULL THEN 0 ELSE 1 END)::INT AS samples FROM j""")
def reg1_registry_upsert(spark, d):
    return rg.upsert(formats(spark, d, 0), formats(spark, d, 1))


@query("WITH e AS (SELECT 'u' || user_id % 20 AS name, substr(props, 1, 12) || event_id % 40 AS comment, ts, event_id AS seq FROM events), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY name, substr(comment, 1, 80) ORDER BY ts DESC, seq DESC) = 1) SELECT name, comment, seq, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC)::INT AS place FROM o QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) <= 10")
def reg2_feedback_append(spark, d):
    (events,) = fx.tables(spark, d, "events")
    e = events.select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("name"), F.concat(F.substring("props", 1, 12), (F.col("event_id") % 40).cast("string")).alias("comment"), "ts", F.col("event_id").alias("seq"))
    return rg.feedback_append(e).drop("ts")


@query("SELECT l_orderkey AS doc_id, 'p' || l_linenumber AS provider, l_tax > 0.03 AS ok, l_quantity AS n_rows, l_partkey AS bonus FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax > 0.03 DESC, l_quantity DESC, l_partkey DESC, 'p' || l_linenumber) = 1")
def evl3_rank_candidates(spark, d):
    (line,) = fx.tables(spark, d, "lineitem")
    return rg.rank_candidates(line.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("provider"), (F.col("l_tax") > 0.03).alias("ok"), F.col("l_quantity").alias("n_rows"), F.col("l_partkey").alias("bonus")))


@query("SELECT o_orderkey AS doc_id, o_orderkey % 5 < o_custkey % 5 AND o_orderkey % 100 >= 0.95 * (o_custkey % 100) AS accepted FROM orders")
def evl4_accept_refinement(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    part = lambda c: orders.select(F.col("o_orderkey").alias("doc_id"), (F.col(c) % 100).alias("n_rows"), (F.col(c) % 5).alias("gaps"))
    return rg.accept_refinement(part("o_custkey"), part("o_orderkey"))


# sinks


@query(f"WITH {RECORD} SELECT container_number, weight, '' AS bl_number FROM (SELECT container_number, coalesce(weight, '') AS weight FROM record WHERE doc_id % 2 = 0) UNION ALL SELECT container_number, '', coalesce(bl_number, '') FROM record WHERE doc_id % 2 = 1")
def snk1_export_union(spark, d):
    r = fx.records(spark, d).withColumn("_internal", F.lit(1))
    a, b = r.where("doc_id % 2 = 0").select("container_number", "weight", "_internal"), r.where("doc_id % 2 = 1").select("container_number", "bl_number")
    return sinks.drop_internal(sinks.union_all(a, b))


@query(f"WITH {RECORD} SELECT doc_id, row_no, greatest(1, least(9, round_even((row_no + 1) / 400 * 9, 0)))::INT AS page FROM record")
def sc9_page_estimate(spark, d):
    return fx.records(spark, d).select("doc_id", "row_no", sc.page_estimate(F.col("row_no"), F.lit(400), F.lit(9)).alias("page"))


@query("SELECT p_partkey, (CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey * 1000.5 END)::DOUBLE AS n FROM part")
def sc3_lenient_float(spark, d):
    (part,) = fx.tables(spark, d, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.format_number(F.col("p_partkey") * 1000.5, 2))
    return part.select("p_partkey", sc.lenient_float(text).alias("n"))


