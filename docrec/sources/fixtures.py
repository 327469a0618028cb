"""Shipping manifests rendered from the star schema: documents whose contents are known, for round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIXES = ("MAEU", "MEDU", "HLCU", "ZIMU")
#: Line items of which the pages or documents go to one task. A page's words take several times the room of its text, so tasks are cut by what they will hold, not by what they read.
ITEMS_A_TASK = 100_000


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def dealt(df: DataFrame, sf_dir: str, *keys: str, share: int = 1) -> DataFrame:
    """Rows dealt by keys (a page's, a document's) to as many tasks as the line items ask for. A task takes the ``share``-th part of ``ITEMS_A_TASK``. Spark does not join these tasks together again, as it does by the bytes of a shuffle."""
    (line,) = tables(df.sparkSession, sf_dir, "lineitem")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-line.count() * share // ITEMS_A_TASK)), *keys)


def boxes(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """Containers: ``k`` (order), ``n`` (line), container, ctype, packs, supp.

    A number of more than seven digits is cut to its first seven, which several boxes of a bill may share; with ``apart`` to its last seven, which tell the boxes of a document apart.
    """
    (line,) = tables(spark, sf_dir, "lineitem")
    out = line.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.sum("l_quantity").cast("long").alias("packs"), F.min("l_suppkey").alias("supp"))
    box = F.col("k") * 8 + F.col("n")
    number = F.concat(F.lit("ABCU"), F.lpad((box % 10**7 if apart else box).cast("string"), 7, "0"))
    return out.select("k", "n", number.alias("container"), F.when(F.col("n") % 2 == 0, "20GP").otherwise("40HC").alias("ctype"), "packs", "supp")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills of lading: ``k``, bl, shipper, consignee, pol, pod, weight, date."""
    orders, customer, supplier, nation = tables(spark, sf_dir, "orders", "customer", "supplier", "nation")
    held = boxes(spark, sf_dir).groupBy("k").agg((F.sum("packs") * 100).alias("weight"), F.min("supp").alias("supp"))
    number = F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("k") % 4 + 1).cast("int")), F.lpad(F.col("k").cast("string"), 9, "0"))
    pol = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("pol"))
    pod = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("pod"))
    joined = held.join(orders, held["k"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("supp") == F.col("s_suppkey")).join(pol, "s_nationkey").join(pod, "c_nationkey")
    return joined.select("k", number.alias("bl"), F.col("s_name").alias("shipper"), F.col("c_name").alias("consignee"), "pol", "pod", "weight", F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"))


def manifest_text(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """``doc_id, page_no, text``: 50 orders a document, 10 a page, in the order of their keys. ``apart``: as in ``boxes``."""
    line = F.concat_ws(" ", F.lit("(CN)"), "container", "ctype", F.col("packs").cast("string"), F.lit("PKGS"))
    lines = boxes(spark, sf_dir, apart).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    b = bills(spark, sf_dir).join(lines, "k")
    head = [F.concat(F.lit(label), F.col(c)) for label, c in (("B/L NO. ", "bl"), ("SHIPPER ", "shipper"), ("CONSIGNEE ", "consignee"), ("PORT OF LOADING ", "pol"), ("PORT OF DISCHARGE ", "pod"))]
    block = F.concat_ws("\n", *head, F.array_join(F.col("lines.line"), "\n"), F.concat(F.lit("WEIGHT "), F.col("weight").cast("string"), F.lit(" KGS")))
    blocks = b.select(F.floor(F.col("k") / 50).alias("doc_id"), (F.floor(F.col("k") % 50 / 10) + 1).cast("int").alias("page_no"), "k", block.alias("block"))
    return dealt(blocks, sf_dir, "doc_id", "page_no").groupBy("doc_id", "page_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "block")))["block"], "\n").alias("text"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a container, with gaps and odd values that follow from its numbers, for the record operators."""
    r = boxes(spark, sf_dir).join(bills(spark, sf_dir), "k")
    gap = lambda c, m: F.when(F.col("k") % m == 0, F.lit(None)).otherwise(c)
    odd = F.when(F.col("k") % 13 == 0, F.lit("n/a")).otherwise(F.col("weight").cast("string"))
    return r.select(
        F.floor(F.col("k") / 50).alias("doc_id"), (F.col("k") % 50 * 8 + F.col("n")).cast("long").alias("row_no"), gap(F.col("bl"), 17).alias("bl_number"),
        gap(F.lit("MV DAWN"), 11).alias("vessel"), F.col("container").alias("container_number"), F.col("ctype").alias("container_type"), F.concat(F.lit("S"), F.col("n").cast("string")).alias("seal1"),
        F.col("packs").cast("string").alias("pack_qty"), odd.alias("weight"), F.format_string("%.3f", F.col("packs") / 4).alias("volume"), gap(F.col("shipper"), 7).alias("shipper"), F.col("consignee"),
        F.col("pol").alias("port_of_loading"), gap(F.col("pod"), 19).alias("port_of_discharge"), F.when(F.col("k") % 3 == 0, F.col("date")).when(F.col("k") % 3 == 1, F.lit("soon")).alias("date_of_arrival"),
        F.when(F.col("k") % 2 == 0, "CY/CY").otherwise("door").alias("movement"), F.lit("").alias("description"), (F.col("k") % 5 == 0).alias("user_edited"),
    )


def carrier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page_no, word_no, text, x0, top``: shipments as a carrier's manifest in columns, two pages a bill. Physical lines are mixed: a party's label stands beside a split, and header, total and what follows it are there to be left out."""
    k, n = F.col("k"), F.col("n").cast("string")
    at = lambda x, text: F.struct(F.lit(float(x)).alias("x0"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    line = lambda top, *words: F.struct((top if not isinstance(top, int) else F.lit(top)).cast("double").alias("top"), F.array(*words).alias("words"))
    y = F.col("n") * 100 + 200
    doubled = (F.col("packs") * 2).cast("string")
    party = [at(10, F.when(F.col("n") == 1, "CN:").otherwise("N:")), at(82, F.when(F.col("n") == 1, F.col("consignee")).otherwise(F.concat(F.lit("NOTIFY"), n)))]
    split = [at(250, "SPLIT:"), at(280, n), at(300, "PACK:"), at(330, F.col("packs").cast("string")), at(345, "CTN"), at(380, "WGT:"), at(400, doubled), at(430, "LBS")]
    held = F.array(
        line(y, *party, *split), line(y + 12, at(250, "CTR:"), at(280, F.col("container")), at(400, "SEAL1:"), at(430, F.concat(F.lit("S"), n)), at(460, "WGT:"), at(490, "9")),
        line(y + 24, at(250, "vol:"), at(280, "1.5"), at(300, "CBM"), at(400, "TARE:"), at(430, "2200"), at(450, "SZTP:"), at(480, F.col("ctype")), at(500, F.when(F.col("n") % 2 == 0, "SEAL2:").otherwise("FCL")), at(530, F.concat(F.lit("T"), n))),
        line(y + 36, at(102, F.concat(F.lit("SITE"), n))), line(y + 48, at(250, "cargo"), at(350, "of"), at(380, F.col("container"))),
    )
    head = F.array(
        line(50, at(70, "ABCD123456"), at(250, "SPLIT:"), at(280, "9")),
        line(110, at(70, F.col("bl")), at(110, "Board:"), at(140, F.col("date")), at(250, F.when(k % 3 == 0, "Waybill").otherwise("Bill")), at(300, F.when(k % 2 == 0, "MOVEMENT:").otherwise("-")), at(360, "CY/CY")),
        line(122, at(10, "SH:"), at(82, F.col("shipper")), at(250, "GOODS")), line(134, at(102, "AND"), at(130, "SONS")), line(146, at(10, "FE:"), at(82, "FWD"), at(210, "beyond")),
    )
    total = F.array(line(5000, at(250, "b/l total"), at(300, "1")), line(5012, at(102, "LOST")))
    again = F.array(line(110, at(70, F.col("bl")), at(250, "SPLIT:"), at(280, "8")))
    top = F.when(F.col("second"), F.concat(again, total)).when(F.col("late"), head).otherwise(F.concat(head, total))
    # what a page is made of is dealt by page, its lines and words are made there and need not move any more
    own = boxes(spark, sf_dir).groupBy("k").agg(F.collect_list(F.struct("n", "container", "ctype", "packs")).alias("held"))
    b = bills(spark, sf_dir).select("k", "bl", "shipper", "consignee", "date").join(own, "k").withColumn("late", F.exists("held", lambda x: x["n"] > 2))
    half = lambda second: F.struct(F.lit(second).alias("second"), F.filter("held", lambda x: (x["n"] > 2) == second).alias("own"))
    pages = b.select(F.floor(k / 50).alias("doc_id"), "k", "bl", "shipper", "consignee", "date", "late", F.inline(F.array(half(False), half(True)))).where("late OR NOT second")
    pages = dealt(pages.withColumn("page_no", (k % 50 * 2 + F.when(F.col("second"), 2).otherwise(1)).cast("int")), sf_dir, "doc_id", "page_no", share=5)  # an item has about 40 words
    parts = pages.select(*(c for c in pages.columns if c != "own"), F.explode(F.concat(F.array(F.lit(None)), "own")).alias("x")).select("*", F.col("x").isNull().alias("is_top"), "x.*")
    words = parts.select("doc_id", "page_no", F.inline(F.when(F.col("is_top"), top).otherwise(held))).select("doc_id", "page_no", "top", F.posexplode("words").alias("at", "w"))
    return words.select("doc_id", "page_no", (F.col("top") * 100 + F.col("at")).cast("int").alias("word_no"), "w.text", "w.x0", (F.col("top") + F.col("at") % 3).alias("top"))
