"""Registered queries of questionnaire-style manifests: headers, ports, cargo by reference and by description."""

from __future__ import annotations

from pyspark.sql import functions as F

from docrec.operators import segments as sg
from docrec.plans.queries import query
from docrec.sources import fixtures as fx


def text_of(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def order_key():
    """The key as a column; made on call, since a column needs a session."""
    return F.col("o_orderkey")


@query("""WITH h AS (SELECT o_orderkey // 10 AS doc_id, o_orderkey % 10 AS page_no, o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS m FROM orders)
SELECT doc_id, arg_min(CASE m WHEN 0 THEN 'SHIP ' || c WHEN 1 THEN 'STAR ' || c END, page_no) FILTER (m < 2) AS vessel, arg_min('V' || c, page_no) FILTER (m = 1) AS voyage, arg_min('PANAMA', page_no) FILTER (m = 0) AS flag, NULL::VARCHAR AS master, arg_min('CORP ' || c, page_no) FILTER (m = 0) AS acconier,
NULL::VARCHAR AS shipowner_company, arg_min(CASE m WHEN 2 THEN '3/4/20' || (10 + k % 80) WHEN 1 THEN '01-02-2024' END, page_no) FILTER (m IN (1, 2)) AS date_of_arrival FROM h GROUP BY doc_id""")
def seg3_qa_recap_header(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    c, m = F.col("o_custkey").cast("string"), order_key() % 4
    qa = text_of("Nom du navire :\n SHIP ", c, " QUEL EST pavillon ? PANAMA\nQUEL EST acconier: CORP ", c, " QUEL")
    recap = text_of("m/v: STAR ", c, "\nVge : V", c, " ETA: 01-02-2024 capitaine: ABC RECAPITULATION")
    dated = text_of("Abidjan, le 3 / 4/20", (order_key() % 80 + 10).cast("string"), " M/V: AB Vge")
    pages = orders.select(F.floor(order_key() / 10).alias("doc_id"), (order_key() % 10).alias("page_no"), F.when(m == 0, qa).when(m == 1, recap).when(m == 2, dated).alias("text"))
    return sg.header_fields(pages.withColumn("text", F.regexp_replace("text", " Vge$", "")))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PORT ' || o_custkey || ', FRANCE' WHEN 1 THEN 'RIGA' WHEN 2 THEN 'ST. PETERSBURG, RUSSIA' END AS port_of_loading, CASE o_orderkey % 4 WHEN 0 THEN 'ABIDJAN' WHEN 1 THEN 'SAN PEDRO ' || o_custkey WHEN 2 THEN 'LOME, TOGO' END AS port_of_discharge FROM orders""")
def seg4_refine_ports(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    c, m = F.col("o_custkey").cast("string"), order_key() % 4
    asked = text_of("Ou a-t-il pris sa cargaison ?\n PORT ", c, ", FRANCE, \n service regulier QUEL EST le port final: ABIDJAN one way QUEL")
    recap = text_of("0 RIGA / ABIDJAN 1. Le port qu'il touchera : SAN PEDRO ", c, " total QUEL")
    table = F.lit("7 de (from): ST. PETERSBURG, RUSSIA A (TO): LOME, TOGO  EXPEDITEUR x")
    ports = sg.refine_ports(F.when(m == 0, asked).when(m == 1, recap).when(m == 2, table))
    return orders.select("o_orderkey", *(p.alias(n) for n, p in ports.items()))


#: Parts of a document: what stands before a reference and what stands behind it.
BEFORE = "CASE k % 5 WHEN 0 THEN 'PRILLED URE in bulk ' WHEN 1 THEN 'Muriate of  Potash in Bulk ' WHEN 2 THEN 'DI AMMONIUM 12, PHOSPHATE IN BULK ' WHEN 3 THEN 'pink granular goods ' ELSE 'goods ' END || CASE WHEN k % 3 = 0 THEN 'sobimap ' ELSE '' END || CASE WHEN k % 4 = 0 THEN 'Acron XY' || k || ' ' ELSE '' END"
BEHIND = "CASE WHEN k % 6 <> 0 THEN ' weight ' || (100000 + k) ELSE ' none' END || CASE WHEN k % 7 = 0 THEN ' en transit to Burkina  Faso' ELSE '' END || chr(10)"
REFS = f"""o AS (SELECT o_orderkey // 20 AS doc_id, o_orderkey AS k, 'EAIF' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS ref, {BEFORE.replace('k %', 'o_orderkey %').replace('|| k ||', '|| o_orderkey ||')} AS b, {BEHIND.replace('k %', 'o_orderkey %').replace('+ k', '+ o_orderkey')} AS a FROM orders),
doc AS (SELECT doc_id, string_agg(b || ref || a, '' ORDER BY k) AS text FROM o GROUP BY doc_id),
s AS (SELECT o.*, lower(text) AS t, coalesce(lag(a) OVER w, '') || b AS between_, a || coalesce(lead(b) OVER w, '') AS behind, substr(text, strpos(text, ref) + length(ref), 400) AS ahead FROM o JOIN doc USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""


def ref_docs(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    own = orders.select(order_key().alias("k"), F.concat(F.lit("EAIF"), F.lpad((order_key() % 10000).cast("string"), 4, "0")).alias("ref"))
    part = F.concat(F.expr(BEFORE), F.col("ref"), F.expr(BEHIND.replace("100000 + k", "cast(100000 + k as string)").replace("(cast", "cast").replace("string))", "string)")))
    return own.groupBy(F.floor(F.col("k") / 20).alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", part.alias("p"))))["p"], "").alias("text"))


def known(text: str, patterns: list[str]) -> str:
    """SQL of the first known pattern's text, white space collapsed."""
    cases = " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN regexp_extract({text}, '(?i){p}', 1)" for p in patterns)
    return f"trim(regexp_replace(CASE {cases} ELSE '' END, '\\s+', ' ', 'g'))"


def normal(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({text}, '\\bURE\\b', 'UREA', 'g'), '[0-9]+\\s*', '', 'g'), '\\s+', ' ', 'g'))"


def inferred(text: str) -> str:
    has = lambda w: f"contains(upper({text}), '{w}')"
    return f"CASE WHEN {has('PINK')} AND ({has('GRANNULAR')} OR {has('GRANULAR')}) THEN 'PINK GRANNULAR MURIATE OF POTASH IN BULK' WHEN {has('MURIATE')} AND {has('POTASH')} THEN 'MURIATE OF POTASH IN BULK' WHEN ({has('AMMONIUM')} OR {has('PHOSPHATE')}) AND ({has('DI ')} OR {has('DIAMMONIUM')}) THEN 'DI AMMONIUM PHOSPHATE IN BULK' WHEN {has('UREA')} OR {has('URE ')} THEN CASE WHEN {has('PRILLED')} THEN 'PRILLED ' ELSE '' END || 'UREA IN BULK' ELSE '' END"


def weight(text: str) -> str:
    return f"regexp_extract({text}, '(?:^|[^0-9])([0-9]{{5,9}})(?:[^0-9]|$)', 1)"


END = "CASE " + " ".join(f"WHEN regexp_matches(ahead, '(?i){p}') THEN length(regexp_extract(ahead, '(?is)^.*?{p}'))" for p in sg.CARGO) + " END"
DESCRIBED = f"{REFS}, e AS (SELECT *, {END} AS stop FROM s), described AS (SELECT doc_id, ref, {normal('regexp_replace(' + known('ahead', sg.CARGO) + ', ' + chr(39) + '[0-9]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS description, {weight('substr(ahead, 1, stop + 50)')} AS weight FROM e WHERE stop IS NOT NULL)"


@query(f"WITH {DESCRIBED} SELECT * FROM described")
def seg6_ref_to_desc_weight(spark, d):
    return sg.described_refs(ref_docs(spark, d))


@query(f"WITH {REFS} SELECT k, {inferred('b')} AS inferred, {normal('b')} AS normalized FROM s")
def seg8_infer_description(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    own = orders.select(order_key().alias("k")).withColumn("b", F.expr(BEFORE))
    return own.select("k", sg.infer_description(F.col("b")).alias("inferred"), sg.normalize_description(F.col("b")).alias("normalized"))


def some(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in cols) + ")"


def first(n: int) -> str:
    return f"substr(behind, 1, {n})"


PLACE = sg.TRANSIT.replace(" ", "\\s+")
FIELDS = f"""{DESCRIBED}, fields AS (SELECT doc_id, ref, {some("CASE WHEN d.weight <> '' THEN d.description END", inferred('between_'), normal(known('between_', sg.CARGO)), inferred(first(400)), normal(known(first(300), sg.CARGO)))} AS description,
{some('d.weight', weight(first(200)))} AS weight, {some(known('between_', sg.SHIPPERS), known(first(400), sg.SHIPPERS))} AS shipper, {some(known('between_', sg.CONSIGNEES), known(first(400), sg.CONSIGNEES))} AS consignee,
CASE WHEN regexp_matches(between_ || behind, '(?i)EN\\s+TRANSIT.{{0,150}}{PLACE}|{PLACE}.{{0,150}}EN\\s+TRANSIT') THEN '{sg.TRANSIT}' END AS transit_to FROM s LEFT JOIN described d USING (doc_id, ref))"""


@query(f"WITH {FIELDS} SELECT * FROM fields")
def seg9_segment_fields(spark, d):
    return sg.segment_fields(ref_docs(spark, d))


@query("""WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS m, o_custkey FROM orders), r AS (
SELECT doc_id, 'PRILLED UREA IN BULK' AS description, 100000 + o_custkey || '' AS weight, 'ACRON XY' AS shipper, 'SOBIMAP' AS consignee, NULL AS transit_to FROM o WHERE m < 2
UNION ALL SELECT doc_id, 'Prilled urea in Bulk', '77777', NULL, NULL, 'BURKINA FASO' FROM o WHERE m = 1 UNION ALL SELECT doc_id, 'DI AMMONIUM PHOSPHATE IN BULK', NULL, NULL, NULL, NULL FROM o WHERE m = 2) SELECT * FROM r""")
def seg10_fallback_by_description(spark, d):
    (orders,) = fx.tables(spark, d, "orders")
    m, far = order_key() % 4, "z" * 320
    urea = text_of("ACRON XY sells PRILLED  UREA IN BULK ", (F.col("o_custkey") + 100000).cast("string"), " to SOBIMAP ")
    two = text_of(urea, far, " Prilled urea in Bulk 77777 for Burkina\nFaso ", far, " PRILLED UREA IN BULK 99999")
    text = F.when(m == 0, urea).when(m == 1, two).when(m == 2, "DI AMMONIUM 5 PHOSPHATE IN BULK").otherwise("EAIF1234 PRILLED UREA IN BULK")
    return sg.by_description(orders.select(order_key().alias("doc_id"), text.alias("text"))).drop("pattern_no", "start")


@query(f"""WITH {FIELDS}, h AS (SELECT DISTINCT doc_id, 'V' || doc_id AS vessel FROM o)
SELECT h.doc_id, vessel, ref AS bl_number, CASE WHEN transit_to IS NOT NULL THEN 'LCL' ELSE 'FCL/FCL' END AS movement, coalesce(transit_to, 'ABIDJAN') AS place_of_delivery, 'RIGA' AS place_of_acceptance, description, weight, shipper, consignee, 'VRAC' AS container_type FROM h LEFT JOIN (SELECT * FROM fields WHERE doc_id % 3 <> 0) f USING (doc_id)""")
def seg11_assemble_bulk_rows(spark, d):
    docs = ref_docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 3 == 0, "nothing").otherwise(F.col("text")))
    none = F.lit(None).cast("string")
    headers = docs.select("doc_id", F.concat(F.lit("V"), F.col("doc_id").cast("string")).alias("vessel"), none.alias("voyage"), none.alias("date_of_arrival"), F.lit("RIGA").alias("port_of_loading"), F.lit("ABIDJAN").alias("port_of_discharge"), none.alias("acconier"), none.alias("shipowner_company"))
    return sg.assemble_rows(docs, headers).select("doc_id", "vessel", "bl_number", "movement", "place_of_delivery", "place_of_acceptance", "description", "weight", "shipper", "consignee", "container_type")
