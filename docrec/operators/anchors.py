"""Labels and the values around them: page-local equi and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrec.functions.scalar import fuzz_ratio, ratio_bound
from docrec.operators.geometry import derive_geometry
from docrec.sources.pages import PAGE

ANCHOR = ("ax0", "atop", "ax1", "abottom")


def find_label(words: DataFrame, label: str) -> DataFrame:
    """The first word of each page that equals a one-word label, whatever its case."""
    box = F.min_by(F.struct("word_no", *(F.col(c).alias(a) for c, a in zip(("x0", "top", "x1", "bottom"), ANCHOR))), "word_no")
    return words.where(F.upper("text") == label.upper()).groupBy(*PAGE).agg(box.alias("a")).select(*PAGE, "a.*")


def find_phrase(lines: DataFrame, label: str, first: bool = True) -> DataFrame:
    """Consecutive words of a line that spell a label, as one box; the first on each page, or all."""
    tokens = label.upper().split()
    on_line = Window.partitionBy(*PAGE, "line_no").orderBy("x0", "word_no")
    same = F.upper("text") == tokens[0]
    for k, token in enumerate(tokens[1:], 1):
        same &= F.upper(F.lead("text", k).over(on_line)) == token
    over = lambda f, c: f(*[F.lead(c, k).over(on_line) if k else F.col(c) for k in range(len(tokens))]) if len(tokens) > 1 else F.col(c)
    hits = lines.select(*PAGE, "line_no", "word_no", same.alias("hit"), over(F.least, "x0").alias("ax0"), over(F.least, "top").alias("atop"), over(F.greatest, "x1").alias("ax1"), over(F.greatest, "bottom").alias("abottom"), "x0").where("hit")
    if first:
        hits = hits.withColumn("r", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no", "x0"))).where("r = 1")
    return hits.select(*PAGE, "word_no", *ANCHOR)


def similar_words(words: DataFrame, label: str, threshold: float) -> DataFrame:
    """The first word of each distinct text of a page whose similarity to a label reaches ``threshold``, with its ``score``. Lengths and characters bound the similarity, so most words are never compared, and nothing leaves its page."""
    target, n, t = F.lit(label.upper()), len(label), F.upper("text")
    close = 200 * F.least(F.length(t), F.lit(n)) / (F.length(t) + n) >= threshold
    box = F.struct("word_no", *(F.col(c).alias(a) for c, a in zip(("x0", "top", "x1", "bottom"), ANCHOR)))
    first = words.where(close & (ratio_bound(t, target) >= threshold)).groupBy(*PAGE, t.alias("t")).agg(F.min_by(box, "word_no").alias("a"))
    return first.withColumn("score", fuzz_ratio(F.col("t"), target)).where(F.col("score") >= threshold).select(*PAGE, "t", "score", "a.*")


def find_label_fuzzy(words: DataFrame, label: str, threshold: float = 85.0) -> DataFrame:
    """The most similar word of each page, the first of equals."""
    found = similar_words(words, label, threshold)
    best = found.groupBy(*PAGE).agg(F.min_by(F.struct("word_no", "score", *ANCHOR), F.struct(-F.col("score"), "word_no")).alias("b"))
    return best.select(*PAGE, "b.*")


def cascade(*found: DataFrame) -> DataFrame:
    """For each page the anchor of the first of several searches that has one."""
    every = None
    for k, f in enumerate(found):
        own = f.select(*PAGE, *ANCHOR).withColumn("priority", F.lit(k))
        every = own if every is None else every.unionByName(own)
    best = F.row_number().over(Window.partitionBy(*PAGE).orderBy("priority"))
    return every.withColumn("r", best).where("r = 1").drop("r")


def _nearest(hits: DataFrame, upward: bool, most: int) -> DataFrame:
    by_anchor = Window.partitionBy(*PAGE, *ANCHOR)
    first = F.max("top").over(by_anchor) if upward else F.min("top").over(by_anchor)
    line = hits.withColumn("first_y", first).where(F.abs(F.col("top") - F.col("first_y")) < 4.0)
    return _join(line, most)


def _join(hits: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*PAGE, *ANCHOR).orderBy("x0", "word_no"))
    kept = hits.withColumn("place", place).where(F.col("place") <= most)
    value = F.array_join(F.array_sort(F.collect_list(F.struct("place", "text")))["text"], " ")
    return kept.groupBy(*PAGE, *ANCHOR).agg(value.alias("value"))


def _open(words: DataFrame, anchors: DataFrame, blocked: tuple[str, ...]) -> DataFrame:
    own = derive_geometry(words)
    own = own.where(~F.upper("text").isin(*blocked)) if blocked else own
    return own.join(anchors.select(*PAGE, *ANCHOR).hint("shuffle_hash"), list(PAGE))


def value_below(words: DataFrame, anchors: DataFrame, max_dy: float = 25.0, tolerance: float = 40.0, most: int = 6, blocked: tuple[str, ...] = ()) -> DataFrame:
    """The nearest line below each anchor, within its width and a tolerance."""
    hit = (F.col("top") > F.col("abottom") - 1) & (F.col("top") - F.col("abottom") < max_dy) & F.col("cx").between(F.col("ax0") - tolerance, F.col("ax1") + tolerance)
    return _nearest(_open(words, anchors, blocked).where(hit), False, most)


def value_right(words: DataFrame, anchors: DataFrame, max_dx: float = 250.0, tolerance: float = 4.0, most: int = 8, blocked: tuple[str, ...] = ()) -> DataFrame:
    """What stands right of each anchor on its line."""
    hit = (F.col("x0") > F.col("ax1") - 1) & (F.col("x0") - F.col("ax1") < max_dx) & (F.abs(F.col("cy") - (F.col("atop") + F.col("abottom")) / 2) < tolerance)
    return _join(_open(words, anchors, blocked).where(hit), most)


def value_above(words: DataFrame, anchors: DataFrame, max_dy: float = 25.0, tolerance: float = 40.0, most: int = 6) -> DataFrame:
    """The nearest line above each anchor; labels are not left out here."""
    hit = (F.col("bottom") < F.col("atop") + 1) & (F.col("atop") - F.col("bottom") < max_dy) & F.col("cx").between(F.col("ax0") - tolerance, F.col("ax1") + tolerance)
    return _nearest(_open(words, anchors, ()).where(hit), True, most)


def stop_and_clean(value: Column, stop_at: tuple[str, ...] = (), pattern: str = "", group: int = 0) -> Column:
    """Cut at the earliest stop word, then the pattern's match if there is one."""
    if stop_at:
        cuts = F.filter(F.array(*(F.locate(s.upper(), F.upper(value)) for s in stop_at)), lambda c: c > 0)
        value = F.when(F.size(cuts) > 0, F.trim(F.substring(value, F.lit(1), F.array_min(cuts) - 1))).otherwise(value)
    if pattern:
        value = F.when(F.regexp_like(value, F.lit(pattern)), F.trim(F.regexp_extract(value, pattern, group))).otherwise(value)
    return F.trim(value)


def header_first_nonempty(values: DataFrame) -> DataFrame:
    """``doc_id, page_no, field, value``: for each document and field, the value of the first page that has one."""
    return values.where(F.trim("value") != "").groupBy("doc_id", "field").agg(F.min_by("value", "page_no").alias("value"))
