"""Text segmentation of questionnaire-style manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of references and of weights.
REF = "EAIF[0-9]{3,4}"
WEIGHT = "(?<![0-9])([0-9]{5,9})(?![0-9])"
#: Known cargo, shippers and consignees, the first that matches counts.
CARGO = [
    r"(DI\s+AMMONIUM(?:[\s\d,]+)?PHOSPHATE\s+IN\s+BULK)", r"(PINK\s+GRANNULAR\s+MURIATE\s+OF\s+POTASH\s+IN\s+BULK)", r"(MURIATE\s+OF\s+POTASH\s+IN\s+BULK)", r"(PRILLED\s+UREA\s+IN\s+BULK)",
    r"(GRANULAR\s+UREA\s+IN\s+BULK)", r"(DIAMMONIUM\s+PHOSPHATE\s+IN\s+BULK)", r"(PRILLED\s+URE\w*\s+IN\s+BULK)",
]
SHIPPERS = [r"(JOINT\s+STOCK\s+COMPANY\s+APATIT)", r"(PACIFIC\s+RIL\s+INTERNATIONAL\s+FERTILIZER\s+LIMITED)", r"(PACIFIC\s+RIL\w*)", r"(ACRON\s+\w+)", r"(URALCHEM\s+\w+)"]
CONSIGNEES = [
    r"(ETG\s+INPUTS\s+IVC(?:\s+LIMITED)?)", r"(SOBIMAP)", r"(CORIS\s+BANK\s+INTERNATIONAL\s*SA)", r"(ETG\s+AGROSCIENCES(?:\s+(?:COTE\s+D.?IVOIRE|LIMITED))*\s*(?:SA|CO)?)", r"(PACIFIC\s+\w+\s+FERTILIZER)",
]
#: Where header fields stand on a page: pattern and the least length of its value. On one page the first counts.
HEADER = {
    "vessel": [(r"nom du navire\s*[?:]\s*(.+?)(?=QUEL|JEL|$)", 1), (r"M/?V[:\s]+([A-Z0-9 ]+?)(?=Vge|ETA|$)", 4)],
    "flag": [(r"pavillon\s*[?:]\s*([A-Z ]+?)(?=QUEL|JEL|$)", 1)],
    "master": [(r"nom du capitaine\s*[?:]\s*(.+?)(?=QUEL|JEL|$)", 1), (r"CAPITAINE\s*[:\s]+([A-Z ]+?)(?=RECAPIT|MANI|SAKINA|$)", 5)],
    "acconier": [(r"acconier\s*[?:]\s*(.+?)(?=QUEL|JEL|$)", 1)],
    "shipowner_company": [(r"compagnie appartient.+?[?:]\s*(.+?)(?=COMB|$)", 1)],
    "voyage": [(r"Vge\s*[:\s]+([A-Z0-9/]+)", 1)],
}
#: Patterns of dates, ports, the words after a port, and the country of transit.
QA_DATE = r"abidjan[,\s]+le\s+(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})"
RECAP_DATE = r"ETA\s*[:\s]+(\d{1,2}[/\-]\d{1,2}[/\-]\d{4})"
PORTS = {
    "port_of_loading": [r"pris sa cargaison\s*[?:]\s*(.+?)(?=QUEL|JEL|COMB|$)", r"([A-Z][A-Z. ]+)\s*/\s*ABIDJAN", r"DE\s*\(FROM\)\s*[:\s]+([A-Z][A-Z., ']+?)(?=\s+A\s*\(TO\)|$)"],
    "port_of_discharge": [r"port final\s*[?:]\s*(.+?)(?=QUEL|JEL|one|SERVICE|$)", r"port qu.il touchera\s*[?:]\s*(.+?)(?=QUEL|JEL|DANS|$)", r"A\s*\(TO\)\s*[:\s]+([A-Z][A-Z., ']{4,40}?)(?=\s+EXPEDITEUR|\s{3,}|$)"],
}
PORT_NOISE = r"\s+(?:one\b|a\s+service|service\b|consignation|sakina|manif|quel|dans|acconier|combien|arrete|total|vge|eta|mani|via)"
TRANSIT = "BURKINA FASO"


def normalize_ocr(text: Column) -> Column:
    """Letters that look like digits are read as digits in the four characters behind EAIF, and three wrongly decoded characters are put right."""
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)EAIF[A-Z0-9]{4}\b"), 0))
    fixed = lambda r: F.concat(F.lit("EAIF"), F.translate(F.substring(r, 5, 4), "IOSZBLGT", "10528167"))
    return F.translate(F.aggregate(refs, text, lambda acc, r: F.regexp_replace(acc, F.concat(r, F.lit(r"\b")), fixed(r))), "\u00c6\u00da\u00b6", "'EO")


#: The words that tell kinds of pages, and those without which few words of the first kind count less.
PAGE_KEYWORDS = {
    "questionnaire": ("questionnaire", "quel est", "capitaine", "equipage", "pavillon"),
    "recap": ("recapitulation", "total feuillet", "arretee la presente"),
    "cargo_table": ("manifeste d'entree", "expediteur", "destinataire", "de (from)", "a (to)", "shipper", "consignee"),
    "customs": ("ministere", "republique de cote d'ivoire", "nombre de conteneur", "vrac solide"),
}
SURE_QUESTIONS = ("quel est", "questionnaire")


def classify_page(text: Column, classes: dict[str, tuple[str, ...]] = PAGE_KEYWORDS, guarded: str = "questionnaire", strong: tuple[str, ...] = SURE_QUESTIONS) -> Column:
    """The class with most keywords on the page, the first of equals, ``unknown`` without any. A positive score of the guarded class loses 2 unless a strong word is there."""
    low = F.lower(text)
    scores = []
    for name, words in classes.items():
        score = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
        if name == guarded:
            sure = F.coalesce(*(F.when(F.contains(low, F.lit(w)), True) for w in strong), F.lit(False))
            score = F.when((score > 0) & ~sure, F.greatest(F.lit(0), score - 2)).otherwise(score)
        scores.append(score)
    most = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.when(most > 0, F.coalesce(*(F.when(s == most, name) for name, s in zip(classes, scores)))).otherwise("unknown")


def all_occurrences(docs: DataFrame, pattern: str = REF) -> DataFrame:
    """``doc_id, ref, start, stop``: every occurrence of a reference (upper-case), by character offsets from 0."""
    parts = docs.select("doc_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?is).*?({pattern})"), 0)).alias("i", "upto"))
    stop = F.sum(F.length("upto")).over(Window.partitionBy("doc_id").orderBy("i"))
    found = parts.select("doc_id", F.upper(F.regexp_extract("upto", f"(?i)({pattern})$", 1)).alias("ref"), stop.alias("stop"))
    return found.withColumn("start", F.col("stop") - F.length("ref"))


def occurrences(docs: DataFrame, pattern: str = REF) -> DataFrame:
    """The first occurrence of each reference."""
    return all_occurrences(docs, pattern).groupBy("doc_id", "ref").agg(F.min("stop").alias("stop")).withColumn("start", F.col("stop") - F.length("ref"))


def between_markers(docs: DataFrame, back: int = 800, ahead: int = 600) -> DataFrame:
    """For each reference the text between the one before (the first: ``back`` characters) and it, and from it to the next (the last: ``ahead`` characters)."""
    order = Window.partitionBy("doc_id").orderBy("start")
    at = occurrences(docs).withColumns({"from": F.coalesce(F.lag("stop").over(order), F.greatest(F.lit(0), F.col("start") - back)), "to": F.coalesce(F.lead("start").over(order), F.col("stop") + ahead)})
    cut = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    return at.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "ref", cut(F.col("from"), F.col("start")).alias("between"), cut(F.col("stop"), F.col("to")).alias("after"))


def keyword_field(text: Column, patterns: list[str]) -> Column:
    """Empty without a match, else group 1 of the first pattern in the list that matches, white space collapsed."""
    return F.trim(F.regexp_replace(F.coalesce(*(F.when(F.regexp_like(text, F.lit(p)), F.regexp_extract(text, p, 1)) for p in patterns), F.lit("")), r"\s+", " "))


def _known(text: Column, patterns: list[str]) -> Column:
    return keyword_field(text, [f"(?i){p}" for p in patterns])


def flat(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")


def header_fields(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, text`` -> per document the header fields, each from the first page that has it; null where none has."""
    own = pages.select("doc_id", "page_no", flat(normalize_ocr(F.coalesce("text", F.lit("")))).alias("t"))
    value = lambda p, g=1: F.trim(F.regexp_extract("t", f"(?i){p}", g))
    long_enough = lambda p, least: F.when(F.length(value(p)) >= least, value(p))
    cols = {name: F.coalesce(*(long_enough(*p) for p in patterns)) for name, patterns in HEADER.items()}
    date = F.when(value(QA_DATE) != "", F.concat_ws("/", *(value(QA_DATE, g) for g in (1, 2, 3))))
    cols["date_of_arrival"] = F.coalesce(date, F.nullif(value(RECAP_DATE), F.lit("")))
    found = own.select("doc_id", "page_no", *(c.alias(n) for n, c in cols.items()))
    return found.groupBy("doc_id").agg(*(F.min_by(n, F.when(F.col(n).isNotNull(), F.col("page_no"))).alias(n) for n in cols))


def clean_port(raw: Column) -> Column:
    """A port without what was read behind its country, of 60 characters at most; null if nothing is left."""
    cut = F.regexp_replace(F.trim(raw), f"(?is){PORT_NOISE}.*$", "")
    return F.nullif(F.trim(F.substring(F.rtrim(F.regexp_replace(cut, r"[,/\s]+$", "")), 1, 60)), F.lit(""))


def refine_ports(text: Column) -> dict[str, Column]:
    """Ports of loading and discharge in a document's text, each by the first of three patterns that gives one."""
    return {name: F.coalesce(*(clean_port(F.nullif(F.regexp_extract(flat(text), f"(?i){p}", 1), F.lit(""))) for p in patterns)) for name, patterns in PORTS.items()}


def normalize_description(c: Column) -> Column:
    """A cut-off UREA is completed, numbers within go, white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\bURE\b", "UREA"), r"[0-9]+\s*", ""), r"\s+", " "))


def infer_description(text: Column) -> Column:
    """The cargo that words in a text stand for; empty if none does."""
    has = lambda *words: F.coalesce(*(F.when(F.contains(F.upper(text), F.lit(w)), True) for w in words), F.lit(False))
    urea = F.when(has("PRILLED"), "PRILLED UREA IN BULK").otherwise("UREA IN BULK")
    pink, potash = has("PINK") & has("GRANNULAR", "GRANULAR"), has("MURIATE") & has("POTASH")
    phosphate = has("AMMONIUM", "PHOSPHATE") & has("DI ", "DIAMMONIUM")
    return F.when(pink, "PINK GRANNULAR MURIATE OF POTASH IN BULK").when(potash, "MURIATE OF POTASH IN BULK").when(phosphate, "DI AMMONIUM PHOSPHATE IN BULK").when(has("UREA", "URE "), urea).otherwise("")


def described_refs(docs: DataFrame, ahead: int = 400) -> DataFrame:
    """``doc_id, ref, description, weight``: for each reference the first known cargo in the ``ahead`` characters behind an occurrence, with the weight up to 50 characters behind it (empty if none). The first occurrence with a weight counts, else the first."""
    at = all_occurrences(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "ref", "start", F.substring("text", F.col("stop") + 1, F.lit(ahead)).alias("after"))
    which = F.coalesce(*(F.when(F.regexp_like("after", F.lit(f"(?i){p}")), F.lit(f"(?i){p}")) for p in CARGO))
    hit = at.withColumn("p", which).where("p is not null").withColumn("raw", F.expr("regexp_extract(after, p, 1)"))
    end = F.expr("regexp_instr(after, p)") - 1 + F.length("raw")
    read = hit.select("doc_id", "ref", "start", normalize_description(F.regexp_replace("raw", "[0-9]+", " ")).alias("description"), F.regexp_extract(F.substring("after", F.lit(1), end + 50), WEIGHT, 1).alias("weight"))
    best = read.groupBy("doc_id", "ref").agg(F.min(F.struct((F.col("weight") == "").alias("bare"), "start", "description", "weight")).alias("b"))
    return best.select("doc_id", "ref", "b.description", "b.weight")


def segment_fields(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> a record a reference: description, weight, shipper, consignee and transit, from the known cargo behind it, the text before it and the text behind it. Fields that are not found are null."""
    j = between_markers(docs).join(described_refs(docs).withColumnsRenamed({"description": "d", "weight": "w"}), ["doc_id", "ref"], "left")
    between, first = F.col("between"), lambda n: F.substring("after", 1, n)
    some = lambda *cols: F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))
    sure = F.when(F.col("w") != "", F.col("d"))
    place = TRANSIT.replace(" ", r"\s+")
    transit = F.regexp_like(F.concat("between", "after"), F.lit(rf"(?i)EN\s+TRANSIT.{{0,150}}{place}|{place}.{{0,150}}EN\s+TRANSIT"))
    return j.select(
        "doc_id", "ref", some(sure, infer_description(between), normalize_description(_known(between, CARGO)), infer_description(first(400)), normalize_description(_known(first(300), CARGO))).alias("description"),
        some(F.col("w"), F.regexp_extract(first(200), WEIGHT, 1)).alias("weight"), some(_known(between, SHIPPERS), _known(first(400), SHIPPERS)).alias("shipper"),
        some(_known(between, CONSIGNEES), _known(first(400), CONSIGNEES)).alias("consignee"), F.when(transit, TRANSIT).alias("transit_to"),
    )


def by_description(docs: DataFrame) -> DataFrame:
    """Documents without any reference: a record for each distinct cargo description as it is written, with what stands near its first occurrence."""
    bare = docs.where(~F.regexp_like("text", F.lit(f"(?i){REF}"))).select("doc_id", "text")
    named = bare.select("doc_id", "text", F.posexplode(F.array(*(F.lit(f"(?i){p}") for p in CARGO))).alias("pattern_no", "p")).where("regexp_like(text, p)")
    parts = named.select("doc_id", "pattern_no", "p", F.posexplode(F.expr("regexp_extract_all(text, '(?s).*?' || p, 0)")).alias("i", "upto"))
    stop = F.sum(F.length("upto")).over(Window.partitionBy("doc_id", "pattern_no").orderBy("i"))
    found = parts.select("doc_id", "pattern_no", stop.alias("stop"), F.expr("regexp_extract(upto, p || '$', 1)").alias("raw")).withColumn("seen", F.trim(flat(F.col("raw"))))
    first = found.groupBy("doc_id", "seen").agg(F.min(F.struct("pattern_no", "stop", "raw")).alias("f")).select("doc_id", "seen", "f.pattern_no", "f.stop", (F.col("f.stop") - F.length("f.raw")).alias("start"))
    j = first.join(bare, "doc_id")
    left = F.greatest(F.lit(0), F.col("start") - 300)
    near, after = F.substring("text", left + 1, F.col("stop") + 200 - left), F.substring("text", F.col("stop") + 1, F.lit(200))
    some = lambda c: F.nullif(c, F.lit(""))
    own = j.withColumns({"near": near, "behind": after})
    return own.select(
        "doc_id", "pattern_no", "start", normalize_description(F.col("seen")).alias("description"), some(F.regexp_extract("behind", WEIGHT, 1)).alias("weight"), some(_known(F.col("near"), SHIPPERS)).alias("shipper"),
        some(_known(F.col("near"), CONSIGNEES)).alias("consignee"), F.when(F.regexp_like("near", F.lit("(?i)" + TRANSIT.replace(" ", r"\s+"))), TRANSIT).alias("transit_to"),
    )


def assemble_rows(docs: DataFrame, headers: DataFrame) -> DataFrame:
    """Records of bulk manifests: cargo by reference, else by description, else a row with the header alone. ``headers``: ``doc_id`` and the header fields with the two ports."""
    cargo = segment_fields(docs).withColumnRenamed("ref", "bl_number").unionByName(by_description(docs).drop("pattern_no", "start"), allowMissingColumns=True)
    j = headers.join(cargo, "doc_id", "left")
    text = F.lit
    return j.select(
        "doc_id", "vessel", "voyage", "date_of_arrival", "bl_number", text("BL").alias("bl_type"), F.when(F.col("transit_to").isNotNull(), "LCL").otherwise("FCL/FCL").alias("movement"), "port_of_loading", "port_of_discharge",
        F.coalesce("transit_to", "port_of_discharge").alias("place_of_delivery"), F.col("port_of_loading").alias("place_of_acceptance"), "shipper", "consignee", F.col("acconier").alias("freight_forwarder"), F.lit(1).alias("split_number"),
        text("VRAC").alias("container_type"), text("COLIS").alias("pack_unit"), "weight", text("KGS").alias("weight_unit"), "description", F.col("shipowner_company").alias("shipowner"), F.lit(True).alias("is_scanned"), "transit_to",
    )
