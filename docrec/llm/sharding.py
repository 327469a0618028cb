"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows with equal texts form a group. Groups are placed from the largest down, each in the shard for which the dot product of
its load and the shard's residual capacity is highest. Groups that are large on their own come first. All others are dealt
by a hash of their text into parts, as many as the groups need, and each part places its groups into what the large ones have
left of each shard, scaled to the part's own load: every part fills the shards evenly, and so do all together.

Scale: texts are read once and reduced to (id, size, tokens, hash). At most ``3 * shards * GRAIN`` groups are large however
many documents there are, so their loads fit the driver, and their places go back as a table of that size. A part holds
about ``PART`` groups, never fewer than ``GRAIN`` a shard, so that it can be balanced. Slots are counted inside buckets of about ``PART`` rows with offsets. A group larger than a whole
shard's share cannot stay together and is dealt out by parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrec.llm.common import n_words, stored, table, utf8

SHARDS, PART = 16, 1 << 14
#: A group is large if it holds more than 1 / GRAIN of a shard's share of bytes, tokens or rows.
GRAIN = 64
LOADS = ("size", "tokens", "rows")


def placed(loads: np.ndarray, left: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard for each load vector, and what is left of each shard: largest first, at the highest dot product with what each shard has left; where an item overflows every shard it goes where it overflows least.

    ``left`` is in shares of one shard's part of ``total``.
    """
    share = loads / np.where(total > 0, total, 1) * len(left)
    left, out = left.copy(), np.zeros(len(loads), np.int32)
    for i in np.lexsort((np.arange(len(loads)), -share.max(axis=1))):
        after = left - share[i]
        fits = (after >= -1e-9).all(axis=1)
        best = np.where(fits, left @ share[i], -np.inf).argmax() if fits.any() else after.min(axis=1).argmax()
        out[i], left[best] = best, after[best]
    return out, left


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, part: int = PART) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes, tokens and rows.

    Returns one row per input row: ``id_col, size, text_crc32, law, shard, slot, grown_shard``. Slots are gapless from 0 in
    each shard. Rows of equal texts are in one shard unless they are more than a shard's share.

    * a null text counts as empty (size 1, as every size is the text's bytes plus 1) and groups with empty texts
    * repeated rows and null ids are rows like any other; ties in the order of slots go by the rows' place in the input
    * an empty table gives an empty result; columns other than id and text are not read
    """
    spark: SparkSession = docs.sparkSession
    body = utf8(F.col(text_col))
    narrow = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), n_words(F.col(text_col)).alias("tokens"),
        F.crc32(body).alias("crc"), F.xxhash64(body).alias("text_key"), F.monotonically_increasing_id().alias("rid"),
    )
    rows = stored(narrow, "shard-rows").withColumn("rows", F.lit(1).cast("long"))
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LOADS)).first()
    buckets = max(1, -(-total["rows"] // part))
    sums = np.array([total[c] for c in LOADS], float)

    groups = rows.groupBy("text_key").agg(*(F.sum(c).alias(c) for c in LOADS))
    share = F.greatest(*(F.col(c) * shards / F.lit(max(total[c], 1)) for c in LOADS))  # of one shard
    groups = stored(groups.withColumn("share", share), "shard-groups")
    large = groups.where(F.col("share") > 1 / GRAIN)  # at most 3 * shards * GRAIN rows

    # Large groups. One of more than a shard's share is dealt out by parts, whose loads are summed by Spark.
    apart = stored(large.where("share > 1").select("text_key", F.ceil(F.col("share") * GRAIN).cast("int").alias("parts")), "shard-apart")
    piece = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int").alias("piece")
    held = large.where("share <= 1").select("text_key", F.lit(-1).alias("piece"), *LOADS).unionByName(rows.join(apart, "text_key").groupBy("text_key", piece).agg(*(F.sum(c).alias(c) for c in LOADS)))
    held = held.toPandas().sort_values(["text_key", "piece"], ignore_index=True)  # bounded, see above
    held["shard"], left = placed(held[list(LOADS)].to_numpy(float), np.ones((shards, len(LOADS))), sums)
    where = spark.createDataFrame(list(held[["text_key", "piece", "shard"]].itertuples(index=False, name=None)), "text_key long, piece int, shard int")

    free = np.maximum(left, 0)
    free = np.where(free.sum(axis=0) > 0, free / np.where(free.sum(axis=0) > 0, free.sum(axis=0), 1), 1 / shards) * shards

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("text_key")
        loads = np.stack([group.column(c).to_numpy().astype(float) for c in LOADS], axis=1)
        turn = group.column("part")[0].as_py() % shards  # ties go to another shard in each part, else they add up
        shard = placed(loads, np.roll(free, -turn, axis=0), loads.sum(axis=0))[0]
        return pa.table({"text_key": group.column("text_key"), "piece": pa.array(np.full(len(loads), -1, np.int32)), "shard": ((shard + turn) % shards).astype(np.int32)})

    light = groups.where(F.col("share") <= 1 / GRAIN)
    parts = max(1, light.count() // max(part, GRAIN * shards))
    light = light.withColumn("part", F.pmod("text_key", F.lit(parts))).groupBy("part").applyInArrow(place, "text_key long, piece int, shard int")
    places = stored(light.unionByName(where), "shard-places")
    own = rows.join(apart, "text_key", "left").withColumn("piece", F.coalesce(piece, F.lit(-1)))
    own = stored(own.join(places, ["text_key", "piece"]).select("id", "size", "crc", "rid", "shard", F.pmod(F.xxhash64("rid"), F.lit(buckets)).alias("bucket")), "shard-placed")

    counts = own.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "rid")) - 1
    return own.join(first, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark, sf_dir):
    return sharded(table(spark, sf_dir, "documents"))
