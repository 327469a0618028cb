"""Registered queries of loaders and streams: look-up files, pages that arrive, the log of corrections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docrec.operators import detection as de
from docrec.operators import lookups as lk
from docrec.plans.fixture_sql import TEXT
from docrec.plans.queries import LOG, change_log, query
from docrec.session import new_folder
from docrec.sources import fixtures as fx
from docrec.streaming import ingest


@query("""WITH f AS (SELECT DISTINCT p_type FROM part), o AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS ord FROM f)
SELECT 'container' AS map, lower(p_type) AS key, CASE WHEN ord = 0 THEN 'LAST' ELSE upper(p_type) END AS code, CASE WHEN ord = 0 THEN 9 ELSE ord % 3 END::INT AS teu, ord::INT AS ord, (SELECT count(*) FROM part p WHERE p.p_type = o.p_type) AS uses FROM o
UNION ALL SELECT 'port', lower(n_name), n_name, NULL, (row_number() OVER (ORDER BY n_nationkey) - 1)::INT, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation""")
def src9_load_lookups(spark, d):
    """A look-ups file in file order, with a key that is repeated and maps that are missing; written from the types of parts and the nations."""
    part, nation, customer = fx.tables(spark, d, "part", "nation", "customer")
    place = F.row_number().over(Window.orderBy("p_type")) - 1
    entries = part.select("p_type").distinct().withColumn("n", place).select("n", F.concat(F.lit('"'), F.upper("p_type"), F.lit(' ":{"condit":"'), F.upper("p_type"), F.lit('","teu":'), (F.col("n") % 3).cast("string"), F.lit("}")).alias("e"))
    joined = lambda df: df.agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "e")))["e"], ",").alias("x"), F.min_by("e", "n").alias("first"))
    ports = nation.select(F.col("n_nationkey").alias("n"), F.concat(F.lit('"'), F.lower("n_name"), F.lit('":{"code":"'), F.col("n_name"), F.lit('"}')).alias("e"))
    again = F.concat(F.regexp_extract("first", '^("[^"]*":)', 1), F.lit('{"condit":"LAST","teu":"9"}'))
    boxes = joined(entries).select(F.concat("x", F.lit(","), again).alias("boxes"))
    file = boxes.crossJoin(joined(ports).select(F.col("x").alias("ports"))).select(F.concat(F.lit('{"container":{'), "boxes", F.lit('},"movement":null,"port":{'), "ports", F.lit("}}")))  # one row each
    path = new_folder(spark, "lookups")
    file.coalesce(1).write.text(path)
    dims = lk.load_lookups(spark, path)
    uses = part.groupBy(F.lower("p_type").alias("type")).agg(F.count("*").alias("uses"))
    box = dims["container"].join(uses, "type").select(F.lit("container").alias("map"), F.col("type").alias("key"), F.col("condit").alias("code"), "teu", "ord", "uses")
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.lower("n_name").alias("key")).agg(F.count("*").alias("uses"))
    port = dims["port"].join(people, "key", "left").select(F.lit("port").alias("map"), "key", "code", F.lit(None).cast("int").alias("teu"), "ord", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"))
    return box.unionByName(port)


#: The weights of an order's block, one a container or one for all, in the units and spellings that count: kind, text of one, whether it stands once a container.
UNITS = (("1 234,5 kgs", True), ("20 Tonnes", False), ("3.250 mt", True), ("12 kgss", True), ("7 TON", True), ("1,234.5\tKg.", True))


@query("""WITH c AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), v AS (SELECT k // 50 AS doc_id, n, k % 6 AS m FROM c WHERE n > 1)
SELECT b.doc_id, CASE WHEN count(*) FILTER (m IN (0, 2, 4, 5)) > count(*) FILTER (m IN (1, 3)) THEN 'per_container' ELSE 'per_bl' END AS scope FROM (SELECT DISTINCT k // 50 AS doc_id FROM c) b LEFT JOIN v USING (doc_id) GROUP BY b.doc_id""")
def det6_weight_scope_vote(spark, d):
    """The vote over all spellings of weights: any case, tonnes, blanks between thousands; a longer word is no unit."""
    (lineitem,) = fx.tables(spark, d, "lineitem")
    k = F.col("l_orderkey")
    unit = F.element_at(F.array(*(F.lit(u) for u, _ in UNITS)), (k % len(UNITS) + 1).cast("int"))
    each = F.element_at(F.array(*(F.lit(e) for _, e in UNITS)), (k % len(UNITS) + 1).cast("int"))
    boxes = lineitem.select("l_orderkey", "l_linenumber").distinct()
    line = F.concat(F.lit("ABCU"), F.lpad(((k * 8 + F.col("l_linenumber")) % 10**7).cast("string"), 7, "0"), F.when(each, F.concat(F.lit(" "), unit)).otherwise(""))
    blocks = boxes.groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("lines")).select(F.floor(k / 50).alias("doc_id"), F.concat("lines", F.when(each, "").otherwise(F.concat(F.lit("\ntotal "), unit))).alias("text"))
    return de.weight_scope(blocks)


@query(f"WITH {TEXT} SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM page GROUP BY doc_id")
def str1_incremental_ingest(spark, d):
    """All pages arrive as files, a few a batch; every document is extracted once, when its pages are there."""
    pages = fx.manifest_text(spark, d).select("doc_id", F.col("page_no").cast("int").alias("page_no"), "text")
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    base = new_folder(spark, "ingest")
    schema = "doc_id long, page_no int, page_count int, text string"
    pages.join(counts, "doc_id").select(F.col("doc_id").cast("long"), "page_no", "page_count", "text").repartition(8, "page_no", "doc_id").write.parquet(f"{base}/pages")
    extract = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    ingest.incremental_ingest(spark, f"{base}/pages", schema, extract, f"{base}/out", f"{base}/state", files_per_batch=3).awaitTermination()
    return spark.read.schema("doc_id long, n long, chars long").parquet(f"{base}/out/batch=*")


@query(f"WITH {LOG} SELECT doc_id, page_no, field_key, seq::VARCHAR AS value, box FROM state")
def str2_corrections_stream(spark, d):
    """The events as a log that arrives in files, out of order, a few a batch; the state after the last batch."""
    base = new_folder(spark, "corrections")
    log = change_log(spark, d)
    schema = ", ".join(f"{c} {t}" for c, t in log.dtypes)
    log.repartition(8, "seq").write.parquet(f"{base}/log")
    stream = ingest.corrections_stream(spark, f"{base}/log", schema, f"{base}/state", files_per_batch=3)
    stream.awaitTermination()
    return ingest.current_state(spark, f"{base}/state", stream.lastProgress["batchId"], schema).withColumn("box", F.array_join("box", ","))
