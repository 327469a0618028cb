"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrec.session import new_folder, stored  # noqa: F401  (the operators' way to write between steps)

#: A word: a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: CRC-32 of a short ASCII text as DuckDB SQL, which has no such function: the reflected polynomial bit by bit.
CRC32_SQL = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the fast built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def utf8(c: Column) -> Column:
    """The UTF-8 bytes; null counts as empty."""
    return F.coalesce(c, F.lit("")).cast("binary")


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (string or binary) holds about ``most`` bytes in each, one row at least."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if held and held + n > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start)
