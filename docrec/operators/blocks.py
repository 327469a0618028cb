"""Bill-of-lading blocks and the records in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrec.operators.geometry import derive_geometry, meet
from docrec.sources.pages import PAGE


def blocks_by_marker(words: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """Each word that matches opens a block to the next match's top (the last: to the page's bottom and 1). A page without a match carries on the last number of the pages before it."""
    pages = words.groupBy(*PAGE).agg(F.min("top").alias("page_top"), F.max("bottom").alias("page_bottom"))
    number = F.trim(F.regexp_extract("text", f"(?i){pattern}", group))
    marks = words.where(F.regexp_like("text", F.lit(f"(?i){pattern}"))).select(*PAGE, "top", "x0", "word_no", number.alias("bl_number")).where("bl_number <> ''")
    on_page = Window.partitionBy(*PAGE).orderBy("top", "x0", "word_no")
    cut = marks.withColumn("next", F.lead("top").over(on_page)).withColumn("block_no", F.row_number().over(on_page) - 1)
    ends = marks.groupBy(*PAGE).agg(F.max_by("bl_number", F.struct("top", "x0", "word_no")).alias("_end"))
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a page
    carried = pages.join(ends, list(PAGE), "left").withColumn("carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    out = carried.join(cut, list(PAGE), "left").where("bl_number IS NOT NULL OR carried IS NOT NULL")
    own = F.col("bl_number").isNotNull()
    return out.select(
        *PAGE, F.coalesce("block_no", F.lit(0)).alias("block_no"), F.coalesce("bl_number", "carried").alias("bl_number"),
        F.when(own, F.col("top")).otherwise(F.col("page_top")).alias("y_start"),
        F.when(own, F.coalesce(F.col("next"), F.col("page_bottom") + 1)).otherwise(F.col("page_bottom")).alias("y_end"), (~own).alias("carry_over"),
    )


def blocks_by_page(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE).agg(F.min("top").alias("y_start"), F.max("bottom").alias("y_end")).select(*PAGE, F.lit(0).alias("block_no"), F.lit("").alias("bl_number"), "y_start", "y_end", F.lit(False).alias("carry_over"))


def blocks_by_gap(lines: DataFrame, times: float = 2.5) -> DataFrame:
    """A new block where the gap between lines reaches ``times`` the page's upper median gap (a median of 0 counts as 1)."""
    own = lines.groupBy(*PAGE, "line_no").agg(F.min("top").alias("top"), F.min_by("bottom", F.struct("x0", "word_no")).alias("first_bottom"), F.max_by("bottom", F.struct("x0", "word_no")).alias("last_bottom"))
    on_page = Window.partitionBy(*PAGE).orderBy("line_no")
    own = own.withColumn("gap", F.col("top") - F.lag("top").over(on_page))
    gaps = F.array_sort(F.collect_list("gap").over(Window.partitionBy(*PAGE)))
    median = F.when(F.size(gaps) > 0, F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")))
    own = own.withColumn("median", F.when(median == 0, 1.0).otherwise(median))
    own = own.withColumn("block_no", F.sum(F.when(F.col("gap") >= F.col("median") * times, 1).otherwise(0)).over(on_page).cast("int"))
    last = F.max("line_no").over(Window.partitionBy(*PAGE))
    out = own.withColumn("final", last).groupBy(*PAGE, "block_no").agg(F.min("top").alias("y_start"), F.max_by(F.when(F.col("line_no") == F.col("final"), F.col("last_bottom")).otherwise(F.col("first_bottom")), "line_no").alias("y_end"))
    return out.select(*PAGE, "block_no", F.lit("").alias("bl_number"), "y_start", "y_end", F.lit(False).alias("carry_over"))


def blocks_dispatch(words: DataFrame, lines: DataFrame, pattern: str, group: int = 0, strategies: DataFrame | None = None) -> DataFrame:
    """Blocks by each document's strategy (``doc_id, strategy``; without one, or blank: ``marker``): by marker, or by gaps where no marker is found; by ``gap``; any other by page. Without a pattern, documents by marker are cut by page."""
    paged = blocks_by_page(words)
    chosen = paged.select("doc_id").distinct()
    named = F.lit("marker")
    if strategies is not None:
        chosen = chosen.join(strategies.select("doc_id", F.lower("strategy").alias("strategy")), "doc_id", "left")
        named = F.coalesce(F.nullif("strategy", F.lit("")), F.lit("marker"))
    chosen = chosen.select("doc_id", F.when(named == "marker", "marker" if pattern else "page").when(named == "gap", "gap").otherwise("page").alias("strategy"))
    # what is kept of a document is chosen from its blocks, and by a join that Spark does not move below them: words and lines stay with their page
    of = lambda blocks, *names: blocks.join(chosen.where(F.col("strategy").isin(*names)).select("doc_id").distinct(), "doc_id")
    out = of(paged, "page")
    gaps = blocks_by_gap(lines)
    if not pattern:
        return out.unionByName(of(gaps, "gap"))
    marked = of(blocks_by_marker(words, pattern, group), "marker")
    found = marked.select("doc_id").distinct().withColumn("_found", F.lit(True))
    rest = of(gaps, "gap", "marker").join(found, "doc_id", "left").where(F.col("_found").isNull()).drop("_found")
    return out.unionByName(marked).unionByName(rest)


def block_words(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Words whose centre lies within a block, 1 above and below included."""
    return meet(derive_geometry(words), blocks, F.col("cy"), F.col("y_start") - 1, F.col("y_end") + 1)


def containers_in_text(text: Column, pattern: str = r"\b[A-Z]{4}[0-9]{7}\b", repeated: bool = False) -> Column:
    """All matches, upper-case, in the order they are first seen; distinct, or with ``repeated`` as often as they stand there."""
    every = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), 0), lambda m: F.upper(F.trim(m)))
    return every if repeated else F.array_distinct(every)


def emit_rows(blocks: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """``..., page_no, bl_number, containers, weight``: a row a container with the block's fields; one row without a container if a field is there. A weight is repeated, never divided.

    ``header`` (``doc_id`` and fields of the document) gives what a block does not have or has blank; ``page`` is the block's page.
    """
    rows = blocks.select("*", F.explode_outer("containers").alias("container_number")).drop("containers")
    rows = rows.where(F.col("container_number").isNotNull() | F.col("bl_number").isNotNull() | F.col("weight").isNotNull())
    if header is not None:
        own = [c for c in header.columns if c != "doc_id"]
        joined = rows.join(header.select("doc_id", *(F.col(c).alias(f"_h_{c}") for c in own)), "doc_id", "left")
        given = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)) if c in rows.columns else F.lit(None)
        rows = joined.withColumns({c: F.coalesce(given(c), F.col(f"_h_{c}")) for c in own}).drop(*(f"_h_{c}" for c in own))
    return rows.withColumn("page", F.col("page_no"))


def row_patterns(lines: DataFrame, patterns: list[tuple[str, list[str]]]) -> DataFrame:
    """``doc_id, page_no, line_no, text`` and (pattern, group names) -> one row per line that some pattern matches; the first in the list wins."""
    names = list(dict.fromkeys(n for _, groups in patterns for n in groups))
    which = F.coalesce(*(F.when(F.regexp_like("text", F.lit(p)), k) for k, (p, _) in enumerate(patterns)))
    hit = lines.withColumn("pattern_no", which).where("pattern_no IS NOT NULL")
    value = lambda n: F.coalesce(*(F.when(F.col("pattern_no") == k, F.nullif(F.trim(F.regexp_extract("text", p, groups.index(n) + 1)), F.lit(""))) for k, (p, groups) in enumerate(patterns) if n in groups))
    return hit.select(*PAGE, "line_no", "pattern_no", *(value(n).alias(n) for n in names))
