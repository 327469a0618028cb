"""Page texts, words with coordinates, OCR tokens and documents as tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrec.sources.spelled import few, spelled, spelled_rows

CHAR_W, LINE_H = 6.0, 12.0
PAGE = ("doc_id", "page_no")
#: File types that are read as documents.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp")


def split_pages(docs: DataFrame, marker: str = r"=== PAGE \d+ ===\n?") -> DataFrame:
    """``doc_id, text`` -> ``doc_id, page_no, text``: cut at page markers; blank pages go; a text without markers is one page."""
    parts = docs.select("doc_id", F.posexplode(F.filter(F.split("text", marker), lambda p: F.trim(F.translate(p, "\n\r\t\f", "    ")) != "")).alias("pos", "text"))
    return parts.select("doc_id", (F.col("pos") + 1).alias("page_no"), "text")


def spelled_words(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([spelled(some) for some in few(texts)] or [spelled(texts)])


def words_from_text(pages: DataFrame, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Words with made-up coordinates: x is the character offset times 6, y the line number times 12, height 11.

    Words are found in a few texts together; no word is an object of its own. ``deal`` deals the pages with the arrays of their
    words to tasks (by page), so that what follows page by page needs no other shuffle and makes no word again; without it
    words leave Python as they are found, so that no task holds those of more than a few texts.
    """
    if deal:
        cut = F.arrow_udf(spelled_words, "array<struct<text string, at int, n int, line_no int>>")
        found = deal(pages.select(*PAGE, cut(F.col("text")).alias("words"))).select(*PAGE, F.posexplode("words").alias("word_no", "w")).select(*PAGE, "word_no", "w.*")
    else:
        keys = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in PAGE)
        found = pages.select(*PAGE, "text").mapInArrow(spelled_rows, f"{keys}, word_no int, text string, at int, n int, line_no int")
    at, top = F.col("at"), F.col("line_no") * LINE_H
    return found.select(
        *PAGE, "word_no", "text", (at * CHAR_W).alias("x0"), top.alias("top"), ((at + F.col("n")) * CHAR_W).alias("x1"), (top + LINE_H - 1).alias("bottom"),
    )


def ingest_tokens(raw: DataFrame, least: float = 30.0) -> DataFrame:
    """OCR token rows, all strings, to typed tokens: blank texts go, a confidence that is no number is -1, tokens below ``least`` go."""
    typed = raw.select(
        *PAGE, "token_no", F.trim("text").alias("text"), *(F.col(c).try_cast("int").alias(c) for c in ("x", "y", "w", "h")),
        F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)).alias("conf"), "line_id", "block_id",
    )
    return typed.where((F.col("text") != "") & (F.col("conf") >= least))


def identity(content: Column) -> Column:
    """12 hex digits of the MD5 of a content."""
    return F.substring(F.md5(content.cast("binary")), 1, 12)


def inventory(files: DataFrame) -> DataFrame:
    """``path, content`` -> one row per content: identity, first path and copies; only document types."""
    kind = F.lower(F.substring_index("path", ".", -1))
    known = files.where(kind.isin(*EXTENSIONS)).withColumn("ident", identity(F.col("content")))
    return known.groupBy("ident").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def inventory_files(spark: SparkSession, folder: str, seen: DataFrame | None = None) -> DataFrame:
    """The documents in a folder and those below it: ``ident, path, copies, bytes, modified`` (the latest of the copies).

    Contents are hashed where they are read and go no further; only files with a name of a document type are opened. ``seen``
    (``ident``) leaves out what an earlier inventory has; an empty file has no content and is left out.
    """
    glob = "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper(), e.capitalize())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    hashed = files.select("path", identity(F.col("content")).alias("ident"), "length", "modificationTime")
    out = hashed.groupBy("ident").agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.any_value("length").alias("bytes"), F.max("modificationTime").alias("modified"))
    return out if seen is None else out.join(seen.select("ident").distinct(), "ident", "left_anti")


def is_scanned(text: Column) -> Column:
    """Fewer than 200 characters of text."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < 200


def load_words(native: DataFrame, texts: DataFrame) -> DataFrame:
    """Native words where a document has any and is not flagged as scanned; else words made from its text (``doc_id, page_no, text, scanned``)."""
    scanned = texts.where("scanned").select("doc_id").distinct()
    kept = native.join(scanned, "doc_id", "left_anti")
    rest = texts.select(*PAGE, "text").join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(words_from_text(rest))
