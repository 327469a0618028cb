"""Best-fit packing of token sequences, bulk-synchronous.

Documents become pieces of at most ``capacity`` tokens. Lengths are whole numbers up to the capacity, so pieces of one length
are told apart by rank alone, and so are gaps of one size: the rounds (``packing_rounds``) range-sort runs of ranks, sweep the
ranges for each piece's successor among the gaps, settle conflicts by rank, update the gaps and begin again.

Scale: texts are read once and reduced to one row a piece. Rounds work on at most ``capacity`` lengths and the runs they
leave, however many documents there are; each piece then finds its run by its rank. Ranks are counted inside
(length, bucket) cells with offsets, so a length that a third of all pieces share is split over all buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrec.llm.common import slices, stored, table
from docrec.llm.packing_rounds import Rounds
from docrec.llm.tokens import ids

CAPACITY, END = 1024, 2
BUCKETS = 256


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int | None = END, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text, with the end id, cut into pieces of ``capacity`` tokens of which the first may be shorter.

    Returns ``id_col, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian 32-bit).
    """
    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    kind = docs.schema[id_col].dataType
    cols = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids(tokenizer)
        for batch in slices(batches, "text"):
            row, piece, start, length, crc, body = [], [], [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                all_ids = encode(text or "") + tail
                n = len(all_ids) // 4
                at, k = 0, 0
                for stop in range((n - 1) % capacity + 1, n + 1, capacity) if n else ():
                    own = all_ids[4 * at : 4 * stop]
                    row.append(r), piece.append(k), start.append(at), length.append(stop - at), crc.append(zlib.crc32(own))
                    if with_ids:
                        body.append(own)
                    at, k = stop, k + 1
            out = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(body, pa.binary())] if with_ids else out, names=["id", *(c.split()[0] for c in cols.split(", "))])
        encode.forget()

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(cut, f"id {kind.simpleString()}, {cols}").withColumnRenamed("id", id_col)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for).
    Pieces that fill a sequence have negative sequence ids, others are numbered from 0.

    * a null or empty text is a piece of one token, the end id; without an end id it gives no piece
    * repeated rows and null ids are packed like any other; equal lengths are placed in the order of the rows
    * an empty table gives an empty result; columns other than id and text are not read
    """
    cut = pieces(docs, id_col, text_col, capacity, **options)
    rows = stored(cut.withColumn("_rid", F.monotonically_increasing_id()), "pack-pieces")
    short = rows.where(F.col("length") < capacity)
    counts = short.groupBy("length").count()  # capacity rows at most
    runs = np.array(Rounds(counts, capacity).run().collect(), np.int64).reshape(-1, 6)  # they follow the capacity, not the pieces

    cell = short.withColumn("_b", F.pmod(F.xxhash64("_rid"), F.lit(BUCKETS)).cast("int"))
    sizes = cell.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_b", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_b").orderBy("_rid"))
    ranked = cell.join(before, ["length", "_b"]).withColumn("_rank", F.col("_before") + within - 1).drop("_b", "_before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = (runs[:, 0] << 42) + runs[:, 1]
        order = np.argsort(starts)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            length_, first_rank, _, first, each, offset = runs[order[np.searchsorted(starts[order], (length << 42) + rank, "right") - 1]].T
            i = rank - first_rank
            keep = [c for c in batch.schema.names if c not in ("_rid", "_rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(first + i // each), pa.array(offset + i % each * length_)], names=[*keep, "sequence_id", "offset"])

    own = [c for c in rows.columns if c != "_rid"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
    placed = ranked.select(*own, "_rid", "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")
    whole = rows.where(F.col("length") == capacity).select(*own, (-1 - F.col("_rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)


def query(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
