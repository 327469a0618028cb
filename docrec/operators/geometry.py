"""Word geometry: lines, reading order, boxes and neighbours. Every join carries the page key, every window starts with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrec.sources.pages import PAGE


def derive_geometry(words: DataFrame) -> DataFrame:
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return words.withColumns({"cx": x, "cy": y, "width": F.col("x1") - F.col("x0"), "height": F.col("bottom") - F.col("top")})


def line_starts(tops: Column, tolerance: float) -> Column:
    """The tops at which lines start: a top within ``tolerance`` of the line's first top joins it (a fixed anchor, not chained gaps)."""
    step = lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(F.when(F.size(acc) == 0, F.array(t)).otherwise(acc), -1) > tolerance), F.array_append(acc, t)).otherwise(acc)
    return F.aggregate(tops, F.expr("cast(array() as array<double>)"), step)


def line_numbers(tops: Column, tolerance: float) -> Column:
    """The line of each of a page's ascending tops, as in ``line_starts``."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("no"), F.expr("cast(array() as array<int>)").alias("nos"))

    def step(acc: Column, t: Column) -> Column:
        new = F.when(acc["first"].isNull() | (t - acc["first"] > tolerance), 1).otherwise(0)
        return F.struct(F.when(new == 1, t).otherwise(acc["first"]).alias("first"), (acc["no"] + new).alias("no"), F.array_append(acc["nos"], acc["no"] + new).alias("nos"))

    return F.aggregate(tops, start, step)["nos"]


def group_lines(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Adds ``line_no`` (from 0 on each page). A page's distinct tops are folded into lines, and each word looks for its top among them: words that are dealt by page are neither sorted nor shuffled."""
    tops = words.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.col("top").cast("double"))).alias("_tops"))
    pages = tops.select(*PAGE, "_tops", line_numbers(F.col("_tops"), tolerance).alias("_nos"))
    line = F.get("_nos", (F.array_position("_tops", F.col("top").cast("double")) - 1).cast("int"))
    return words.join(pages.hint("shuffle_hash"), list(PAGE)).select(*words.columns, line.alias("line_no"))


def in_order(value: str, *keys: str, sep: str = " ") -> Column:
    """Texts of a group joined in the order of ``keys``."""
    return F.array_join(F.array_sort(F.collect_list(F.struct(*keys, F.col(value).alias("_v"))))["_v"], sep)


def line_texts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE, "line_no").agg(in_order("text", "x0", "word_no").alias("text"), F.min("top").alias("top"))


def reading_order_text(lines: DataFrame) -> DataFrame:
    """``doc_id, page_no, text``: words of a line by x joined by spaces, lines by line ends."""
    return line_texts(lines).groupBy(*PAGE).agg(in_order("text", "line_no", sep="\n").alias("text"))


def document_text(lines: DataFrame) -> DataFrame:
    """Pages joined by form feeds."""
    return reading_order_text(lines).groupBy("doc_id").agg(in_order("text", "page_no", sep="\f").alias("text"))


def text_in_columns(lines: DataFrame, left: float, right: float) -> DataFrame:
    """Text of each line's words with ``left <= x0 <= right``."""
    return line_texts(lines.where(F.col("x0").between(left, right))).select(*PAGE, "line_no", "text")


def value_after_label(text: Column, label: str) -> Column:
    """What follows a label in a line, whatever its case; null without the label."""
    at = F.locate(label.upper(), F.upper(text))
    return F.when(at > 0, F.trim(F.substring(text, at + len(label), F.length(text))))


def meet(words: DataFrame, ranges: DataFrame, y: Column, low: Column, high: Column, band: float = 50.0) -> DataFrame:
    """Words of a page with the ranges (boxes, blocks, surroundings of anchors) of the page that hold their ``y``; ``low`` and ``high`` are of ``ranges``.

    Both meet by band of ``band`` points, a range in each band that it touches within the page, so a page costs its words in the same bands
    as a range, not all words times all ranges. A page's ranges come to its words as one row that lists them by band, so words that are
    dealt by page stay where they are. Columns of both sides are kept; a range without a bound meets nothing.
    """
    place = words.withColumn("_band", F.floor(y / band))
    pages = place.groupBy(*PAGE).agg(F.min("_band").alias("_first"), F.max("_band").alias("_last"))
    first, last = F.greatest(F.floor(low / band), F.col("_first")), F.least(F.floor(high / band), F.col("_last"))
    bounded = ranges.withColumns({"_low": low, "_high": high}).where(F.col("_low").isNotNull() & F.col("_high").isNotNull())
    own = [c for c in bounded.columns if c not in PAGE]
    touched = bounded.join(pages.hint("shuffle_hash"), list(PAGE)).withColumn("_band", F.explode(F.when(first <= last, F.sequence(first, last))))
    listed = touched.groupBy(*PAGE, "_band").agg(F.collect_list(F.struct(*own)).alias("_ranges")).groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("_band", "_ranges"))).alias("_held"))
    met = place.join(listed.hint("shuffle_hash"), list(PAGE)).withColumn("_r", F.explode(F.try_element_at("_held", F.col("_band"))))
    return met.where(y.between(F.col("_r._low"), F.col("_r._high"))).select(*words.columns, *(F.col(f"_r.{c}").alias(c) for c in own if c not in ("_low", "_high")))


def words_in_box(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """``boxes (doc_id, page_no, box, bx0, btop, bx1, bbottom)`` -> text of the words whose centre lies in each, by (top, x0)."""
    hit = meet(derive_geometry(words), boxes, F.col("cy"), F.col("btop"), F.col("bbottom")).where(F.col("cx").between(F.col("bx0"), F.col("bx1")))
    return hit.groupBy(*PAGE, "box").agg(in_order("text", "top", "x0", "word_no").alias("text"), F.count("*").alias("n_words"))


def tokens_in_box(tokens: DataFrame, boxes: DataFrame) -> DataFrame:
    """The same over OCR tokens: grouped by their line, lines by least y, line ends between."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    hit = meet(tokens, boxes, cy, F.col("btop"), F.col("bbottom")).where(cx.between(F.col("bx0"), F.col("bx1")))
    lines = hit.groupBy(*PAGE, "box", "line_id").agg(in_order("text", "x", "token_no").alias("text"), F.min("y").alias("y"))
    return lines.groupBy(*PAGE, "box").agg(in_order("text", "y", "line_id", sep="\n").alias("text"))


def merge_boxes(words: DataFrame, *keys: str) -> DataFrame:
    return words.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def nearby_words(anchors: DataFrame, words: DataFrame, dy: float = 60.0, dx: float = 200.0, most: int = 24) -> DataFrame:
    """``anchors (doc_id, page_no, anchor, acx, acy)`` -> the first words around each, by (top, x0), with coordinates rounded to 0.1."""
    near = meet(derive_geometry(words), anchors, F.col("cy"), F.col("acy") - dy - 1, F.col("acy") + dy + 1).where((F.abs(F.col("cy") - F.col("acy")) <= dy) & (F.abs(F.col("cx") - F.col("acx")) <= dx))
    place = F.row_number().over(Window.partitionBy(*PAGE, "anchor").orderBy("top", "x0", "word_no"))
    return near.withColumn("place", place).where(F.col("place") <= most).select(*PAGE, "anchor", "place", "text", F.round("x0", 1).alias("x0"), F.round("top", 1).alias("top"))
