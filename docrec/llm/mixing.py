"""Mixing sources to target weights, in DataFrame functions only.

Sources get targets by weight, capped at a number of epochs of the source; the excess is reshared by weight. Documents
get a hash-random key. The key's first digits cut each source into ranges; prefix sums over the ranges' word counts
find the one range in which the source's budget runs out, and only that range's documents are sorted by key and summed
one by one. Full epochs are repeats of the whole source, so the cut is needed for the last epoch only.

Scale: texts are read once and reduced to (id, source, size, key). A source with a third of all rows is spread over all
ranges; no task sums or sorts more than a range. What meets in one task is one row a source (the mixture's own table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrec.llm.common import n_words, stored, table

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share_num: int = 3, share_den: int = 2, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size`` -> the same with ``target``, a double.

    The sources share ``share_num / share_den`` of all words by weight; a target stops at ``epochs`` times its source's
    size and what is cut off is shared again, until none is above. In the order of size / weight the sources that stop
    come first, so one pass of running sums finds the level that the others reach.
    """
    cap = F.col("source_size") * epochs
    every = Window.partitionBy(F.lit(1))
    place = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * share_num
    left = (total - share_den * F.coalesce(F.sum("cap").over(fill), F.lit(0))) / F.lit(share_den)
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0)))
    rows = rows.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    reached = F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull().alias("z"), "source", "level"))).over(every)["level"]
    free = F.col("w") * reached
    return rows.select("source", "source_size", F.when(reached.isNull() | (free >= F.col("cap")), F.col("cap").cast("double")).otherwise(free).alias("target"))


def random_key(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", digits: int = 3, **options) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per input row: ``id_col, size, source_size, target, taken``. ``taken`` counts repeats: whole epochs of
    the document, and in the last epoch all of it before the cut, none after, and a part of the one document on the cut,
    so each source's sum is its target without the fraction.

    * a null text has size 0 and is never taken; a null source is a source of its own, the last
    * rows that repeat an id stand beside each other in the random order; equal rows are interchangeable
    * a source without words has target 0; an empty table gives an empty result
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    key = random_key(F.col("id"), seed)
    rows = stored(sized.select("id", "source", "size", key.alias("key"), F.monotonically_increasing_id().alias("rid")), "mix-rows")
    rows = rows.withColumn("range", F.substring("key", 1, digits))  # 16 ** digits ranges a source
    in_range = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    plan = targets(in_range.groupBy("source").agg(F.sum("words").alias("source_size")), **options)
    plan = plan.select(
        F.col("source").alias("s"), "source_size", "target",
        F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).alias("epochs"),
    ).withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")
    ahead = in_range.withColumn("before", before)
    hit = ahead.join(plan, F.col("source").eqNullSafe(F.col("s"))).where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words")))
    cut = plan.join(hit.select(F.col("s").alias("s2"), F.col("range").alias("cut"), "before"), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
    cut = stored(cut, "mix-plan")

    dealt = rows.join(cut, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inside = F.col("range") == F.col("cut")
    running = F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before") - running))
    whole = F.when(F.col("range") < F.col("cut"), F.col("size")).otherwise(F.lit(0))
    once = dealt.where(~F.coalesce(inside, F.lit(False))).withColumn("last", whole).unionByName(dealt.where(inside).withColumn("last", partial))
    taken = F.col("epochs") * F.col("size") + F.col("last")
    return once.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as it is taken; the one document on each source's cut counts as whole if at least half of it is taken."""
    plan = mixed(docs, id_col, text_col, source_col, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    plan = plan.select(F.col(id_col).alias("_id"), "size", copies.alias("_copies")).where("_copies > 0")
    plan = plan.groupBy("_id", "size").agg(F.max("_copies").alias("_copies"))  # rows that repeat an id and a size are taken alike
    repeated = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    same = docs[id_col].eqNullSafe(plan["_id"]) & (n_words(docs[text_col]) == plan["size"])
    return docs.join(plan.hint("shuffle_hash"), same).select(*[docs[c] for c in docs.columns], repeated).drop("_copy")


def query(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || doc_id) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s
), r AS (
  SELECT *, cap / w AS ratio, 3 * (SELECT sum(source_size) FROM w) AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_caps,
    (SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w FROM w
), l AS (
  SELECT *, ((total - 2 * full_caps)::DOUBLE / 2.0) / open_w::DOUBLE AS level FROM r
), m AS (
  SELECT (SELECT level FROM l WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1) AS reached
), t AS (
  SELECT source, source_size, CASE WHEN reached IS NULL OR w * reached >= cap THEN cap::DOUBLE ELSE w * reached END AS target FROM l, m
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
), q AS (
  SELECT doc_id, size, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM q
"""
