"""Queries of whole operators, over whole tables, where another registered query has a part of the operator or of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrec.operators import box_templates as bt
from docrec.operators import detection as de
from docrec.operators import lookups as lk
from docrec.operators import registry as rg
from docrec.operators import rules as ru
from docrec.plans.fixture_sql import BILL, RECORD, TEXT
from docrec.plans.queries import DOCTEXT, doc_texts, query
from docrec.plans.rule_queries import FIRST, dims, lined
from docrec.sources import fixtures as fx
from docrec.sources import sinks


@query(f"WITH {RECORD} SELECT doc_id, row_no, container_number FROM record UNION ALL SELECT doc_id, row_no, container_number FROM record")
def set1_append_queue(spark, d):
    r = fx.records(spark, d).select("doc_id", "row_no", "container_number")
    return r.unionByName(r.select("container_number", "row_no", "doc_id"))


@query(f"WITH {RECORD}, g AS (SELECT doc_id, count(*) AS n_rows, count(DISTINCT container_number) * (1 + doc_id % 3) AS bills FROM record GROUP BY doc_id) SELECT doc_id, n_rows, n_rows >= greatest(1, floor(bills * 0.5)) AS ok FROM g")
def evl1_template_coverage(spark, d):
    r = fx.records(spark, d)
    expected = r.groupBy("doc_id").agg(F.count_distinct("container_number").alias("n")).select("doc_id", (F.col("n") * (1 + F.col("doc_id") % 3)).alias("bills"))
    return rg.template_coverage(r, expected)


@query(f"WITH {BILL}{FIRST} SELECT doc_id, page_no, 1 AS row, unnest(['shipper', 'number']) AS field, unnest([shipper, bl]) AS value FROM first_bill WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, page_no, 1, 'odd_number', bl FROM first_bill WHERE doc_id % 2 = 1")
def tpl13_apply_template_all_pages(spark, d):
    t = lined(spark, d)
    stored = [("even", "shipper", 0.9, 0.9, 0.5, 0.02, "Shippre", 0.03, -0.01), ("even", "number", 0.08, 0.0, 0.5, 0.014, "", 0.0, 0.0), ("odd", "odd_number", 0.08, 0.0, 0.5, 0.014, "", 0.0, 0.0)]
    templates = spark.createDataFrame(stored, "name string, field string, bx double, by double, bw double, bh double, anchor_text string, dx double, dy double")
    pages = t.select("doc_id", "page_no", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("name")).distinct()
    return bt.apply_templates(t, dims(t), templates, pages)


@query(f"WITH {RECORD} SELECT doc_id, count(*) AS n FROM record GROUP BY doc_id")
def snk5_select_layout_compatible(spark, d):
    r = fx.records(spark, d)
    kept = sinks.layout_compatible(r, r.drop("bl_number", "vessel"))
    return sinks.union_all(*(lk.to_layout(p, lk.dimensions(spark)) for p in kept)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))


@query("SELECT 'P' || p_partkey AS name, 'vessel' AS key, CASE WHEN p_partkey % 2 = 0 THEN 'SHIP ' || p_partkey ELSE 'VESSEL:' END AS value FROM part UNION ALL SELECT 'P' || p_partkey, 'voyage', 'VOYAGE:' FROM part UNION ALL SELECT 'P' || p_partkey, 'own', 'x' FROM part WHERE p_partkey % 3 = 0")
def src8_load_parser_config(spark, d):
    (part,) = fx.tables(spark, d, "part")
    k, name = F.col("p_partkey"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name")
    ships = part.where(k % 2 == 0).select(name, F.lit("vessel").alias("key"), F.concat(F.lit("SHIP "), k.cast("string")).alias("value"))
    over = ships.unionByName(part.where(k % 3 == 0).select(name, F.lit("own").alias("key"), F.lit("x").alias("value")))
    return ru.load_config(part.select(name), over, {"vessel": "VESSEL:", "voyage": "VOYAGE:"})


@query(f"""WITH {DOCTEXT}, f(name, sig) AS (VALUES ('alpha', ['weight', 'nation_24', 'nation_23', 'nation_9']), ('beta', ['zimu', 'nation_', 'nation_3']), ('delta', ['b/l  no. ', 'ation_3', 'nation_1', 'kgs'])), t AS (SELECT name, len(sig) AS n, trim(upper(regexp_replace(unnest(sig), '\\s+', ' ', 'g'))) AS token FROM f),
s AS (SELECT doc_id, name, n, count(*) AS found FROM doc JOIN t ON CASE WHEN regexp_full_match(token, '[A-Z0-9_]+') THEN regexp_matches(upper(text), '(^|[^A-Z0-9_])' || token || '($|[^A-Z0-9_])') ELSE contains(regexp_replace(upper(text), '\\s+', ' ', 'g'), token) END GROUP BY ALL)
SELECT doc_id, name, found FROM s WHERE (n > 1 AND found / n >= 0.6 AND found >= 2) OR (n = 1 AND found = 1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY found / n DESC, found DESC, name) = 1""")
def det2_detect_signature(spark, d):
    formats = [("alpha", ["weight", "nation_24", "nation_23", "nation_9"]), ("beta", ["zimu", "nation_", "nation_3"]), ("delta", ["b/l  no. ", "ation_3", "nation_1", "kgs"])]
    return de.detect_signature(doc_texts(spark, d), spark.createDataFrame(formats, "name string, signature array<string>"))


@query(f"""WITH {TEXT}, l AS (SELECT doc_id, page_no, length(text) AS size, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+$')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+$'), 1) AS i FROM page),
p AS (SELECT doc_id, page_no, size, list(length(line) ORDER BY i) AS ns FROM l GROUP BY ALL),
r AS (SELECT doc_id, page_no, size, CASE WHEN size <= 900 THEN [size] ELSE list_reduce(ns, lambda a, n: CASE WHEN a[-1] > 0 AND a[-1] + n > 900 THEN list_append(a, n) ELSE list_append(a[:-2], a[-1] + n) END, [0]) END AS parts FROM p)
SELECT doc_id, page_no, (sum(1) OVER (PARTITION BY doc_id ORDER BY page_no, i) - 1)::INT AS chunk_no, (1 + coalesce(list_sum(parts[:i - 1]), 0))::INT AS start, parts[i]::INT AS length FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM r)""")
def det12_pack_chunks_split(spark, d):
    return de.pack_chunks(fx.manifest_text(spark, d), 900)


@query(f"WITH {RECORD}, r AS (SELECT doc_id, count(shipper) FILTER (row_no % 9 = 1) AS s, count(port_of_discharge) FILTER (row_no % 9 = 1) AS p FROM record GROUP BY doc_id) SELECT doc_id, array_to_string(list_filter([CASE WHEN s = 0 THEN 'shipper' END, 'weight', CASE WHEN p = 0 THEN 'port_of_discharge' END], lambda x: x IS NOT NULL), '|') AS missing FROM r")
def evl1_never_filled(spark, d):
    part = lambda c: F.when(F.col("row_no") % 9 == 1, F.col(c)).otherwise("")
    r = fx.records(spark, d).select("doc_id", part("shipper").alias("shipper"), "consignee", "port_of_loading", part("port_of_discharge").alias("port_of_discharge"))
    return rg.never_filled(r).select("doc_id", F.array_join("missing", "|").alias("missing"))
