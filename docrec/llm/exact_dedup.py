"""Exact deduplication by deterministic block naming, in DataFrame functions only.

Each normalised text is cut into blocks of a fixed number of bytes. Equal blocks are brought together, the distinct
blocks are sorted and numbered (their integer names), and neighbouring names are paired, sorted and numbered again
until one integer is left for each document. Two documents of the same depth have the same integer only if all their
blocks are equal: names are given to contents, never to digests, so there is nothing to collide.

Scale: block contents are shuffled once, after a map-side distinct, so a group of copies that holds a third of all rows
costs one row a map task. Everything after that moves numbers only. Where two different blocks share a 64-bit sort key,
those blocks alone are sorted by content in a second pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrec.llm.common import ascii_lower, stored, utf8

#: Buckets whose sizes give each bucket its first number; the table of sizes has this many rows at any scale.
BUCKETS = 4096


def ranked(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Number distinct rows 1, 2, 3 ... in the order of (bucket of ``by``, ``by``): column ``name``. No task sorts more than a bucket."""
    rows = distinct.withColumn("_b", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_b", before.alias("_start")))  # at most BUCKETS rows
    at = F.row_number().over(Window.partitionBy("_b").orderBy(*by))
    return rows.withColumn("_at", at).join(starts, "_b").select(*by, (F.col("_start") + F.col("_at")).alias("name"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, sort_key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z; the row with the largest id of each group stays.

    Returns one row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    * a null text counts as empty, and empty texts form a group like any other
    * a null id is smaller than any other; of rows that repeat text and id exactly one stays
    * an empty table gives an empty result; other columns, whatever their names, are not read
    """
    body = utf8(ascii_lower(F.col(text_col)))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    texts = docs.select(F.col(id_col).alias("id"), body.alias("body"))
    blocks = texts.select("id", F.sha2("body", 256).alias("sha"), cut.alias("blocks"))
    keyed = blocks.select("id", F.unhex("sha").alias("sha"), F.transform("blocks", lambda b: sort_key(b)).alias("path"))
    rows = stored(keyed.select(F.monotonically_increasing_id().alias("rid"), "*"), "dedup-rows")

    contents = blocks.select(F.explode("blocks").alias("block")).select(sort_key(F.col("block")).alias("h"), "block").distinct()
    keys = stored(contents.groupBy("h").agg(F.count("*").alias("n")), "dedup-keys")
    clash = keys.where("n > 1").select("h")
    at = rows.select("rid", "id", F.size("path").alias("n"), F.posexplode("path").alias("pos", "h"))
    if clash.isEmpty():  # every sort key stands for one content
        state = at.join(ranked(keys.select("h"), ["h"]), "h")
    else:  # contents that share a key are told apart by their place in the sorted order of contents
        order = Window.partitionBy("h").orderBy("block")
        sorted_ = contents.join(clash, "h", "left_semi").withColumn("r", F.row_number().over(order))
        where = blocks.select("id", F.unhex("sha").alias("sha"), F.posexplode("blocks").alias("pos", "block")).withColumn("h", sort_key(F.col("block")))
        told = where.join(sorted_, ["h", "block"]).select(F.col("id").alias("id2"), F.col("sha").alias("sha2"), "pos", "h", "r").distinct()
        both = at.join(rows.select("rid", "sha"), "rid")
        cond = both["id"].eqNullSafe(told["id2"]) & (both["sha"] == told["sha2"]) & (both["pos"] == told["pos"]) & (both["h"] == told["h"])
        at = both.join(told, cond, "left").select("rid", "id", "n", both["pos"], both["h"], F.coalesce("r", F.lit(1)).alias("r"))
        every = keys.where("n = 1").select("h", F.lit(1).alias("r")).unionByName(sorted_.select("h", "r"))
        state = at.join(ranked(every, ["h", "r"]), ["h", "r"])
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 1

    state, level, done = stored(state.select("rid", "id", "n", "pos", "name"), "dedup-level"), 0, []
    while True:
        done.append(state.where(F.col("n") <= 1 << level).select("rid", "id", F.lit(level).alias("level"), "name"))
        if deepest <= 1 << level:
            break
        even = F.col("pos") % 2 == 0
        pairs = (
            state.where(F.col("n") > 1 << level)
            .groupBy("rid", "id", "n", F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"))
        )
        names = ranked(stored(pairs.select("a", "b").distinct(), "dedup-pairs"), ["a", "b"])
        state, level = stored(pairs.join(names, ["a", "b"]).select("rid", "id", "n", "pos", "name"), "dedup-level"), level + 1

    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    groups = named.groupBy("level", "name").agg(F.max(F.struct("id", "rid")).alias("keep"), F.count("*").alias("group_size"))
    groups = stored(groups, "dedup-groups")  # both sides of the join are then shuffled for it, and a hot group can be split
    out = named.join(groups, ["level", "name"]).select("rid", "keep", "group_size")
    return out.join(rows.select("rid", F.col("id"), "sha"), "rid").select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = exact_groups(docs, id_col, text_col, **options)
    keep = stored(groups.where("kept").select(F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_sha")), "dedup-kept")
    sha = F.unhex(F.sha2(utf8(ascii_lower(F.col(text_col))), 256))
    left = docs.withColumn("_key", sha)
    same = left[id_col].eqNullSafe(keep["_id"]) & (left["_key"] == keep["_sha"])
    out = left.join(keep.hint("shuffle_hash"), same, "left_semi")
    if not docs.groupBy(id_col).count().where("count > 1").isEmpty():  # the same text under the same id
        out = out.dropDuplicates([id_col, "_key"])
    return out.drop("_key")


def query(spark, sf_dir):
    from docrec.llm.common import table

    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), g AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
