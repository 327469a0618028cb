"""Media columns: documents as lossless FLAC streams, read back as PCM blocks with seekable sample offsets.

Encoding and decoding are map-only: a task works on a few hundred frames at once, whichever documents they belong to, so
memory is bounded by the window and a few copies of the longest document. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrec.llm import flac
from docrec.llm.common import slices, table, utf8

BATCH = 1 << 21
UNIT = 64
BLOCK_FIELDS = ("first_sample", "n_samples", "byte_offset")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, media``: each whole text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a FLAC stream of 8-bit samples.

    * a null text counts as empty: 64 zeros; nulls, repeated rows and empty tables are kept as they are
    * columns other than id and text are not read
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            texts = batch.column("text").to_pylist()
            media = flac.encode([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    read = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text"))
    return read.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col, first_sample, n_samples, byte_offset, pcm``: a row a frame; ``byte_offset`` counts from the first frame and is where a reader seeks for ``first_sample``.

    Header and frame checksums and the stream's MD5 are verified; a stream that fails ends the job with the reason. A null stream gives no rows.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", BATCH):
            samples, blocks = flac.decode(batch.column("media").to_pylist())
            row = [r for r, own in enumerate(blocks) for _ in own]
            flat = [b for own in blocks for b in own]
            pcm = [(samples[r][b[0] : b[0] + b[1]]).astype(np.int8).tobytes() for r, b in zip(row, flat)]
            cols = [pa.array([b[k] for b in flat], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), *cols, pa.array(pcm, pa.binary())], names=["id", "first_sample", "n_samples", "byte_offset", "pcm"])

    read = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return read.mapInArrow(run, f"id {kind}, first_sample long, n_samples long, byte_offset long, pcm binary").withColumnRenamed("id", id_col)


def excerpts(media: DataFrame, first: int, n: int, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col, pcm``: samples ``first`` to ``first + n`` of each stream, found by its seek table. Streams that end earlier give what they have."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", BATCH):
            pcm = [flac.excerpt(m, first, n).astype(np.int8).tobytes() for m in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pcm, pa.binary())], names=["id", "pcm"])

    read = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return read.mapInArrow(run, f"id {kind}, pcm binary").withColumnRenamed("id", id_col)


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of what is read back from stored streams (``id_col, n_bytes, media``).

    The feature is ``rms:peak:crossings:frames``: root mean square and peak of the samples, sign changes, FLAC frames. ``blocks`` lists
    the PCM blocks that were read: first sample, samples, and the byte offset from the first frame where a reader seeks for it.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", BATCH):
            streams = batch.column("media").to_pylist()
            rows = []
            for stream, x, own in zip(streams, *flac.decode(streams)):
                payload = (x + 128).astype(np.uint8).tobytes()
                below = x < 0
                feature = f"{np.sqrt(np.square(x, dtype=np.int32).mean()):.4f}:{np.abs(x).max()}:{int((below[1:] != below[:-1]).sum())}:{len(own)}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, [dict(zip(BLOCK_FIELDS, b)) for b in own]))
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([(f, pa.int64()) for f in BLOCK_FIELDS])))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "blocks"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", "n_bytes", *names])

    read = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks array<struct<first_sample:long,n_samples:long,byte_offset:long>>"
    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    return features(encoded(table(spark, sf_dir, "documents")))
