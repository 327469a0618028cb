"""Registered queries of detection routes, registry look-ups, located values and fixed exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrec.functions import scalar as sc
from docrec.operators import box_templates as bt
from docrec.operators import detection as de
from docrec.operators import differences as di
from docrec.operators import jsonrows as js
from docrec.operators import lookups as lk
from docrec.operators import manifest_sm as sm
from docrec.operators import registry as rg
from docrec.plans.fixture_sql import BILL, LINES, RECORD, TEXT
from docrec.plans.queries import DOCTEXT, LAYOUT43, doc_texts, lines, query, responses
from docrec.sources import fixtures as fx
from docrec.sources import sinks


@query(f"WITH {TEXT}, p AS (SELECT doc_id, upper(array_to_string(string_split_regex(text, '\\s+')[1:60], ' ')) AS t FROM page WHERE page_no = 1) SELECT doc_id, CASE WHEN contains(t, 'NATION_7') THEN 'b_first' WHEN contains(t, 'MAEU00000010') THEN 'c_second' WHEN contains(t, 'ZIMU') AND contains(t, '40HC') THEN 'zim' END AS format FROM p")
def det1_detect_builtin(spark, d):
    page = fx.manifest_text(spark, d).where("page_no = 1")
    return page.select("doc_id", de.detect_builtin(F.col("text"), {"c_second": "maeu00000010", "b_first": "nation_7"}, [("zim", [("ZIMU", "40HC"), ("NEVER",)])], 60).alias("format"))


@query(f"WITH {DOCTEXT}, a AS (SELECT doc_id, text, coalesce(nullif(strpos(text, nullif(regexp_extract(text, 'MEDU[0-9]+[13579]1'), '')), 0), 0) AS p FROM doc) SELECT doc_id, CASE WHEN p > 300 THEN text[:300] || chr(10) || '...' || chr(10) || substr(text, greatest(301, p - 50), 600) ELSE text[:900] END AS sample FROM a")
def det10_representative_sample(spark, d):
    return doc_texts(spark, d).select("doc_id", de.representative_sample(F.col("text"), "MEDU[0-9]+[13579]1", 300, 50, 900).alias("sample"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'learned' WHEN p_partkey % 5 = 0 THEN 'builtin' WHEN p_partkey % 2 = 0 THEN 'learned_without_parser' WHEN p_partkey % 7 = 0 THEN 'scanned' ELSE 'unknown' END AS route FROM part")
def det13_route_documents(spark, d):
    (part,) = fx.tables(spark, d, "part")
    k, named = F.col("p_partkey"), lambda c: F.when(c, F.lit("f"))
    return part.select("p_partkey", de.route(named(k % 2 == 0), k % 3 == 0, named(k % 5 == 0), k % 7 == 0).alias("route"))


@query(f"WITH {TEXT}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM page) SELECT doc_id, count(*) FILTER (regexp_matches(text, '^WEIGHT [0-9]*5') OR text LIKE '(CN)%40HC%') AS hits FROM l GROUP BY doc_id")
def evl5_row_pattern_hits(spark, d):
    own = fx.manifest_text(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return rg.row_pattern_hits(own, ["^WEIGHT [0-9]*5", r"^\(CN\).*40HC"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'discover' WHEN p_partkey % 3 = 0 THEN 'patch' WHEN p_partkey % 5 = 0 THEN 'upgrade' ELSE 'discover' END AS label FROM part")
def evl6_learning_triage(spark, d):
    (part,) = fx.tables(spark, d, "part")
    k, none = F.col("p_partkey"), F.expr("cast(array() as array<string>)")
    diffs = F.when(k % 3 == 0, F.array(none, F.array(F.lit("x")))).when(k % 3 == 1, F.array(none))
    return part.select("p_partkey", rg.learning_triage(k % 2 != 0, k % 5 != 0, diffs).alias("label"))


def named_parts(spark, d):
    (part,) = fx.tables(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    return part.select("p_partkey", F.concat(F.lit("Part "), k, F.lit(" / x")).alias("name"), "p_brand", F.lit("old").alias("updated_at"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Part ' || p_partkey || ' / x' ELSE 'Part_' || p_partkey || '_x' END AS wanted, 'Part ' || p_partkey || ' / x' AS name FROM part WHERE p_partkey % 3 = 0")
def reg3_registry_lookup(spark, d):
    r = named_parts(spark, d)
    k = F.col("p_partkey")
    wanted = r.where(k % 3 == 0).select(F.when(k % 2 == 0, F.col("name")).otherwise(sc.slug(F.col("name"))).alias("wanted"))
    return rg.lookup(r, wanted.unionByName(wanted.limit(1).select(F.lit("absent").alias("wanted"))))


@query("SELECT p_partkey, 'Part ' || p_partkey || ' / x' AS name, CASE WHEN p_partkey % 4 = 1 THEN 'NEW' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 2 = 1 THEN 'now' ELSE 'old' END AS updated_at FROM part WHERE p_partkey % 5 <> 0")
def reg4_registry_patch_delete(spark, d):
    r, k = named_parts(spark, d), F.col("p_partkey")
    patches = r.where(k % 2 == 1).select("name", F.when(k % 4 == 1, "NEW").alias("p_brand"))
    return rg.delete(rg.patch(r, patches, ["p_brand"], F.lit("now")), r.where(k % 5 == 0).select(sc.slug(F.col("name")).alias("wanted")))


@query(LAYOUT43.format(base=RECORD, source="record", hand="''").replace("SELECT doc_id, row_no, '' AS \"Num", "SELECT '' AS \"Num"))
def snk2_export_layout43(spark, d):
    return lk.to_layout(fx.records(spark, d), lk.dimensions(spark)).select([f"`{c}`" for c in lk.LAYOUT])


@query(f"WITH {RECORD} SELECT doc_id || '.pdf' AS \"Source\", '' AS \"Template\", '1' AS \"Page\", coalesce(bl_number, '') AS \"BL_Number\", container_number AS \"Container_Number\", coalesce(weight, '') AS \"Gross_Weight\", " + ", ".join(f"'' AS \"{c}\"" for c in sinks.STANDARD if c not in ("BL_Number", "Container_Number", "Gross_Weight")) + " FROM record")
def snk3_export_standard_fields(spark, d):
    r = fx.records(spark, d)
    return sinks.standard_fields(r.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("Source"), F.lit(1).alias("Page"), F.col("bl_number").alias("BL_Number"), F.col("container_number").alias("Container_Number"), F.col("weight").alias("Gross_Weight")))


@query("SELECT p_partkey, p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS usable FROM part")
def src10_template_usable(spark, d):
    (part,) = fx.tables(spark, d, "part")
    k, none = F.col("p_partkey"), F.expr("cast(array() as array<string>)")
    some = F.array(F.lit("x"))
    return part.select("p_partkey", rg.template_usable(F.when(k % 2 == 0, some).otherwise(none), F.when(k % 3 == 0, some), F.when(k % 5 == 0, "m").otherwise(" ")).alias("usable"))


@query(f"WITH {RECORD}, r AS (SELECT doc_id, (row_no // 80)::INT AS chunk_no, count(*) AS n FROM record GROUP BY ALL) SELECT doc_id, chunk_no, n - CASE WHEN (doc_id + chunk_no) % 3 = 0 THEN 1 ELSE 0 END AS n_rows, 'V1' AS voyage FROM r")
def jsn1_parse_response_and_jsn2_salvage(spark, d):
    parsed = responses(spark, d).withColumn("r", js.parse_response(F.col("raw")))
    return parsed.select("doc_id", "chunk_no", F.size("r.rows").cast("long").alias("n_rows"), F.col("r.header.voyage").alias("voyage"))


@query(f"""WITH {LINES}, v AS (SELECT DISTINCT doc_id, page_no, value FROM (SELECT k // 50 AS doc_id, (k % 50 // 10 + 1)::INT AS page_no, unnest([shipper, 'WEIGHT ' || weight, 'of loading ' || pol, substr(bl, 5, 8)]) AS value FROM bill)), t AS (SELECT *, lower(regexp_replace(value, '[\\s,]+', '', 'g')) AS target FROM v),
w AS (SELECT doc_id, page_no, line_no, x0, word_no, lower(replace(text, ',', '')) AS l FROM line), s AS (SELECT *, l || lead(l) OVER o AS l2, l || lead(l) OVER o || lead(l, 2) OVER o AS l3 FROM w WINDOW o AS (PARTITION BY doc_id, page_no, line_no ORDER BY x0, word_no)),
e AS (SELECT doc_id, page_no, l AS target, word_no, 0 AS how, 0 AS line, word_no::DOUBLE AS pos FROM s UNION ALL SELECT doc_id, page_no, l2, word_no, 1, line_no, x0 FROM s UNION ALL SELECT doc_id, page_no, l3, word_no, 1, line_no, x0 FROM s),
f AS (SELECT doc_id, page_no, value, how, word_no FROM t JOIN e USING (doc_id, page_no, target) QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, value ORDER BY how, line, pos, word_no) = 1),
r AS (SELECT t.doc_id, t.page_no, value, 2 AS how, word_no FROM t JOIN w ON t.doc_id = w.doc_id AND t.page_no = w.page_no AND contains(l, target) WHERE (t.doc_id, t.page_no, value) NOT IN (SELECT doc_id, page_no, value FROM f) QUALIFY row_number() OVER (PARTITION BY t.doc_id, t.page_no, value ORDER BY word_no) = 1)
SELECT * FROM f UNION ALL SELECT * FROM r""")
def dif1_locate_value(spark, d):
    b = fx.bills(spark, d)
    values = F.array("shipper", F.concat(F.lit("WEIGHT "), F.col("weight").cast("string")), F.concat(F.lit("of loading "), "pol"), F.substring("bl", 5, 8))
    return di.locate_values(lines(spark, d), b.select(F.floor(F.col("k") / 50).alias("doc_id"), (F.floor(F.col("k") % 50 / 10) + 1).cast("int").alias("page_no"), F.explode(values).alias("value")))


@query("SELECT o_orderkey AS doc_id, 1 AS page_no, 'f' AS field, CASE WHEN o_orderkey % 2 = 0 THEN greatest(0, least(floor(o_custkey % 900 - 100.0), 599)) ELSE floor(0.25 * 600) END::INT AS x, CASE WHEN o_orderkey % 2 = 0 THEN greatest(0, least(floor(o_custkey % 70 + 400.0), 799)) ELSE floor(0.5 * 800) END::INT AS y, 75 AS w, 100 AS h FROM orders")
def tpl6_resolve_boxes(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    key = [F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("f").alias("field")]
    boxes = orders.select(*key, F.lit(600).alias("width"), F.lit(800).alias("height"), F.lit(0.25).alias("bx"), F.lit(0.5).alias("by"), F.lit(0.125).alias("bw"), F.lit(0.125).alias("bh"), F.lit(-0.25).alias("dx"), F.lit(0.5).alias("dy"))
    anchors = orders.where("o_orderkey % 2 = 0").select(*key, (F.col("o_custkey") % 900 + 50.0).alias("acx"), (F.col("o_custkey") % 70 + 0.0).alias("acy"))
    return bt.resolve_boxes(boxes, anchors)


@query(f"WITH {BILL} SELECT bl, CASE WHEN k % 2 = 0 THEN shipper ELSE 'OWNER' END AS shipowner FROM bill")
def sm9_default_shipowner(spark, d):
    b = fx.bills(spark, d)
    return sm.default_shipowner(b.select("bl", F.when(F.col("k") % 2 == 0, F.col("shipper")).when(F.col("k") % 3 == 0, " ").alias("shipowner")), "OWNER")


@query("SELECT event_id, coalesce(trim(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_id::VARCHAR ELSE '  ' || event_type || ' ' END), '') AS text FROM events")
def sc8_to_string(spark, d):
    (events,) = fx.tables(spark, d, "events")
    k = F.col("event_id")
    return events.select("event_id", sc.to_string(F.when(k % 3 == 1, k.cast("string")).when(k % 3 == 2, F.concat(F.lit("  "), "event_type", F.lit(" ")))).alias("text"))


def sampled(spark, d):
    parts = fx.manifest_text(spark, d).select("doc_id", "page_no", F.posexplode(F.split("text", "B/L NO[.] ")).alias("block_no", "part")).where("block_no > 0")
    text = F.regexp_replace(F.concat(F.lit("B/L NO. "), "part"), "\n$", "")
    return de.sample_blocks(parts.select("doc_id", "page_no", "block_no", F.lit(False).alias("carry_over"), text.alias("text")), most=150, least=60)


SAMPLE = TEXT + """, blk AS (SELECT k // 50 AS doc_id, k, 'B/L NO. ' || bl || chr(10) || 'SHIPPER ' || shipper || chr(10) || 'CONSIGNEE ' || consignee || chr(10) || 'PORT OF LOADING ' || pol || chr(10) || 'PORT OF DISCHARGE ' || pod || chr(10) || lines || chr(10) || 'WEIGHT ' || weight || ' KGS' AS t FROM bill JOIN boxlines USING (k)),
cutat AS (SELECT *, CASE WHEN strpos(reverse(t[:150]), chr(10)) > 0 THEN 150 - strpos(reverse(t[:150]), chr(10)) ELSE -1 END AS c FROM blk),
sample AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k)::INT AS place, CASE WHEN length(t) <= 150 THEN t WHEN c > 60 THEN t[:c] ELSE t[:150] END AS sample FROM cutat QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 3)"""


@query(f"WITH {SAMPLE} SELECT doc_id, place, sample FROM sample")
def det8_sample_blocks(spark, d):
    return sampled(spark, d)


@query(f"WITH {SAMPLE}, doc AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM page GROUP BY doc_id), n AS (SELECT k // 50 AS doc_id, count(*)::INT AS containers FROM box GROUP BY 1) SELECT doc_id, CASE WHEN contains(upper(text[:2000]), 'MEDU') THEN 'm' ELSE '' END AS hint, CASE WHEN containers >= 3 THEN '(CN)' ELSE '' END AS marker, containers FROM doc JOIN n USING (doc_id)")
def det9_fingerprint(spark, d):
    return de.fingerprint(doc_texts(spark, d, apart=True), sampled(spark, d), [("m", ["MEDU"])]).select("doc_id", "hint", "marker", "containers")
