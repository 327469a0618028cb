"""Format detection, fingerprints and text samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrec.operators.matching import found_patterns

#: Patterns of bill numbers, of containers and of the words before them, and of weights.
BL_PATTERNS = (
    r"\bABJ\d{9}\b", r"\bMEDU\w{6,}\b", r"\bMAEU\w{6,}\b", r"\bONEY\w{6,}\b", r"\bHLCU\w{6,}\b", r"\bCMDU\w{6,}\b", r"\bCOSU\w{6,}\b",
    r"\bEGLV\w{6,}\b", r"\bPABV\d{6,}\b", r"\bGMSL\w{6,}\b", r"\b[A-Z]{4}\d{10}\b", r"\b[A-Z]{4}\d{8,9}\b", r"\b[A-Z]{2,3}\d{7,12}\b",
)
LOOSE = r"\b[A-Z]{2,4}\d{6,12}\b"
ISO = r"\b[A-Z]{4}\d{7}\b"
MARKERS = ((r"\(\s*CN\s*\)\s*([A-Z]{4}\d{7})", "(CN)"), (r"\bCN[\s:]+([A-Z]{4}\d{7})", "CN:"), (r"\bCONT(?:AINER)?[\s.:N°#]+([A-Z]{4}\d{7})", "CONT:"))
WEIGHT = r"(?i)[0-9]{1,3}(?:[ ,.][0-9]{3})*(?:[.,][0-9]{1,3})?\s*(?:KGS?|MT|TONS?|TONNES?)\b"


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def distinct_matches(text: Column, pattern: str) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)))


def number_sketches(docs: DataFrame, pattern: str, *keys: str, lg_k: int = 14) -> DataFrame:
    """``text`` and ``keys`` -> a sketch of the distinct matches for each group, a few KB whatever its size, to be stored and merged."""
    found = docs.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))).alias("number"))
    return found.groupBy(*keys).agg(F.hll_sketch_agg("number", F.lit(lg_k)).alias("sketch"))


def merged_totals(sketches: DataFrame, *keys: str) -> DataFrame:
    """Estimates of the distinct matches of all groups that ``keys`` bring together; at 2^14 registers the standard error is 0.8 %."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def detect_signature(docs: DataFrame, formats: DataFrame, share: float = 0.6, words: bool = True) -> DataFrame:
    """``doc_id, text`` and ``name, signature`` -> the format of which the largest share of signature words is found (then the largest number): at least ``share`` and two, or the only one.

    White space counts as one space and empty signature words do not count. A simple word (letters, digits, underscores) is found only as a whole word, unless ``words`` is false.
    """
    spaced = lambda c: F.upper(F.regexp_replace(c, r"\s+", " "))
    signature = F.filter(F.transform("signature", lambda s: F.trim(spaced(s))), lambda s: s != "")
    tokens = formats.select("name", signature.alias("signature")).select("name", F.size("signature").alias("n"), F.explode("signature").alias("token"))
    simple = F.regexp_like("token", F.lit("^[A-Z0-9_]+$")) if words else F.lit(False)
    found = found_patterns(docs.select("doc_id", spaced(F.col("text")).alias("t")), tokens.select(F.col("token").alias("pattern"), simple.alias("whole")), "t")
    seen = found.join(tokens, found["pattern"] == tokens["token"]).groupBy("doc_id", "name", "n").agg(F.count("*").alias("found"))
    ok = seen.withColumn("ratio", F.col("found") / F.col("n")).where(((F.col("n") > 1) & (F.col("ratio") >= share) & (F.col("found") >= 2)) | ((F.col("n") == 1) & (F.col("ratio") == 1)))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("ratio"), F.desc("found"), "name"))
    return ok.withColumn("r", best).where("r = 1").select("doc_id", "name", "found")


def carrier_hint(text: Column, carriers: list[tuple[str, list[str]]], head: int = 2000) -> Column:
    """The first carrier of which a word stands in the first ``head`` characters."""
    top = F.upper(F.substring(F.coalesce(text, F.lit("")), 1, head))
    return F.coalesce(*(F.when(F.contains(top, F.lit(t)), name) for name, tokens in carriers for t in tokens), F.lit(""))


def marker_hits(text: Column, least: int = 5, top: int = 3) -> Column:
    """The patterns with at least ``least`` matches, most first, ``top`` at most; else the loose pattern if it has 3: array of (pattern number, hits). The loose pattern has number -1."""
    counts = F.array(*(F.struct((-hits(text, p)).alias("minus"), F.lit(k).alias("pattern")) for k, p in enumerate(BL_PATTERNS)))  # each counted once
    best = F.transform(F.slice(F.array_sort(F.filter(counts, lambda s: s["minus"] <= -least)), 1, top), lambda s: F.struct(s["pattern"].alias("pattern"), (-s["minus"]).alias("hits")))
    loose = F.filter(F.array(F.struct(F.lit(-1).alias("pattern"), hits(text, LOOSE).alias("hits"))), lambda s: s["hits"] >= 3)
    both = F.filter(F.array(best, loose), lambda a: F.size(a) > 0)
    return F.coalesce(F.get(both, F.lit(0)), F.slice(best, 1, 0))


def container_marker(text: Column) -> Column:
    """The label of the most frequent marker with at least 3 matches; else ISO with 3 distinct numbers; else empty."""
    counts = [hits(text, p) for p, _ in MARKERS]
    most = F.greatest(*counts)
    label = F.coalesce(*(F.when(c == most, name) for c, (_, name) in zip(counts, MARKERS)))
    return F.when(most >= 3, label).when(distinct_matches(text, ISO) >= 3, "ISO").otherwise("")


def weight_scope(blocks: DataFrame) -> DataFrame:
    """``doc_id, text`` of sample blocks -> ``per_bl`` or ``per_container`` by the majority of blocks with more than one container; a tie is per_bl."""
    b = blocks.select("doc_id", distinct_matches(F.col("text"), ISO).alias("c"), hits(F.col("text"), WEIGHT).alias("w"))
    each = (F.col("c") > 1) & (F.col("w") > 1) & (F.col("c") == F.col("w"))
    votes = b.groupBy("doc_id").agg(F.count_if(each).alias("each"), F.count_if((F.col("c") > 1) & ~each).alias("once"))
    return votes.select("doc_id", F.when(F.col("each") > F.col("once"), "per_container").otherwise("per_bl").alias("scope"))


def representative_sample(text: Column, pattern: str, head: int = 2000, back: int = 200, most: int = 6000) -> Column:
    """The head of a text and what begins ``back`` characters before the first bill number, if that is beyond the head."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(F.lit(head + 1), at - back)
    return F.when(at > head, F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.substring(text, start, F.lit(most - head)))).otherwise(F.substring(text, 1, most))


def first_cargo_page(pages: DataFrame, pattern: str) -> DataFrame:
    """The first page of each document with a bill number, 1 without."""
    at = F.min(F.when(F.regexp_like("text", F.lit(pattern)), F.col("page_no")))
    return pages.groupBy("doc_id").agg(F.coalesce(at, F.lit(1)).alias("page_no"))


def piece_lengths(text: Column, most: int) -> Column:
    """A text of more than ``most`` characters in pieces that end at line ends (a line of more than that is cut): their lengths. A shorter one is one piece."""
    lines = F.transform(F.split(text, r"(?<=\n)|(?<=\r)(?!\n)"), F.length)
    cut = F.flatten(F.transform(lines, lambda n: F.concat(F.array_repeat(F.lit(most), F.floor(n / most).cast("int")), F.when(n % most > 0, F.array(n % most)).otherwise(F.expr("cast(array() as array<int>)")))))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("done"))

    def step(acc: Column, n: Column) -> Column:
        new = (acc["used"] > 0) & (acc["used"] + n > most)
        return F.struct(F.when(new, n).otherwise(acc["used"] + n).alias("used"), F.when(new, F.array_append(acc["done"], acc["used"])).otherwise(acc["done"]).alias("done"))

    return F.when(F.length(text) > most, F.aggregate(cut, start, step, lambda acc: F.array_append(acc["done"], acc["used"]))).otherwise(F.array(F.length(text)))


def pack_chunks(pages: DataFrame, most: int = 18000) -> DataFrame:
    """Pages packed greedily into chunks of at most ``most`` characters (a page counts its length and 2): ``doc_id, page_no, chunk_no, start, length``, the last two saying what of the page's text (from 1 on).

    A page of more than ``most`` characters is split at line ends, each piece a chunk of its own. Order-dependent, so one document's page lengths are folded together.
    """
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.expr("cast(array() as array<struct<page_no:int,chunk_no:int,start:int,length:int>>)").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        size = p["n"] + 2
        new = (acc["used"] > 0) & (p["alone"] | (acc["used"] + size > most))
        chunk = acc["chunk"] + F.when(new, 1).otherwise(0)
        used = F.when(p["alone"], most).when(new, size).otherwise(acc["used"] + size)
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.array_append(acc["done"], F.struct(p["page_no"].alias("page_no"), chunk.alias("chunk_no"), p["start"].alias("start"), p["n"].alias("length"))).alias("done"))

    sized = pages.select("doc_id", "page_no", piece_lengths(F.coalesce("text", F.lit("")), most).alias("ns"))
    before = lambda k: F.aggregate(F.slice("ns", 1, k), F.lit(0), lambda a, n: a + n)
    pieces = F.transform("ns", lambda n, k: F.struct(F.col("page_no"), (before(k) + 1).alias("start"), n.alias("n"), (F.size("ns") > 1).alias("alone")))
    ordered = sized.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("page_no", pieces.alias("pieces"))))["pieces"]).alias("pieces"))
    return ordered.select("doc_id", F.explode(F.aggregate("pieces", start, step)["done"]).alias("c")).select("doc_id", "c.*")


def signature_text(pages: DataFrame, first: int = 3) -> DataFrame:
    """The text of a document's first pages."""
    own = pages.where(F.col("page_no") <= first)
    return own.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_no", "text")))["text"], "\n").alias("text"))


def detect_builtin(first_page: Column, keywords: dict[str, str], heuristics: list[tuple[str, list[tuple[str, ...]]]], words: int = 500) -> Column:
    """The format of a document's first page, by its first ``words`` words: configured keywords in the order of format names, then heuristics, each a list of alternatives of which all words must occur."""
    top = F.upper(F.array_join(F.slice(F.split(F.trim(first_page), r"\s+"), 1, words), " "))
    has = lambda ws: [F.contains(top, F.lit(w.upper())) for w in ws]
    all_of = lambda ws: F.when(~F.array_contains(F.array(*has(ws)), False), True).otherwise(False)
    rules = [(name, [(keywords[name],)]) for name in sorted(keywords)] + heuristics
    return F.coalesce(*(F.when(all_of(ws), name) for name, ways in rules for ws in ways), F.lit(None).cast("string"))


def route(learned: Column, usable: Column, builtin: Column, scanned: Column) -> Column:
    """How a document is read: by a usable learned format, a built-in parser, a learned format without parser, as a scan, or not at all."""
    return (
        F.when(learned.isNotNull() & usable, "learned").when(builtin.isNotNull(), "builtin").when(learned.isNotNull(), "learned_without_parser").when(scanned, "scanned").otherwise("unknown")
    )


def sample_blocks(blocks: DataFrame, first: int = 3, most: int = 400, least: int = 100) -> DataFrame:
    """``doc_id, page_no, block_no, carry_over, text`` -> the first blocks of each document that are not carried over, each cut to ``most`` characters, at a line end if one stands beyond ``least``."""
    t = F.trim("text")
    head = F.substring(t, 1, most)
    back = F.locate("\n", F.reverse(head))
    cut = F.when(back > 0, F.length(head) - back).otherwise(-1)
    own = blocks.where(~F.col("carry_over") & (t != "")).withColumn("sample", F.when(F.length(t) <= most, t).when(cut > least, F.substring(t, F.lit(1), cut)).otherwise(head))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "block_no"))
    return own.withColumn("place", place).where(F.col("place") <= first).select("doc_id", "place", "sample")


def fingerprint(docs: DataFrame, samples: DataFrame, carriers: list[tuple[str, list[str]]]) -> DataFrame:
    """One row per document (``doc_id, text``): carrier hint, container marker, the best bill pattern and its hits, distinct containers, and the weight scope that its samples vote for."""
    best = F.try_element_at(marker_hits(F.col("text")), F.lit(1))
    own = docs.select("doc_id", carrier_hint(F.col("text"), carriers).alias("hint"), container_marker(F.col("text")).alias("marker"), best["pattern"].alias("pattern"), best["hits"].alias("hits"), distinct_matches(F.col("text"), ISO).alias("containers"))
    scope = weight_scope(samples.select("doc_id", F.col("sample").alias("text")))
    return own.join(scope, "doc_id", "left").withColumn("scope", F.coalesce("scope", F.lit("per_bl")))
