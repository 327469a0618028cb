"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def nonblank(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def to_string(c: Column) -> Column:
    """Trimmed text; null is empty."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def normalize_key(c: Column) -> Column:
    """Trimmed, lower-case, white space collapsed; null counts as empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def slug(c: Column, default: str = "format") -> Column:
    """Runs of other characters than letters, digits, _ and - become _; the ends are stripped of _."""
    out = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_-]+", "_"), F.lit("_"))
    return F.when(out == "", F.lit(default)).otherwise(out)


def lenient_float(c: Column) -> Column:
    """Commas and spaces dropped; what is no number is 0."""
    return F.coalesce(F.regexp_replace(c.cast("string"), "[, ]", "").try_cast("double"), F.lit(0.0))


def loose(c: Column) -> Column:
    """Without white space and commas, lower-case: equal loose forms are the same value."""
    return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\s,]+", ""))


def alpha_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / n).otherwise(0.0)


def trim_number(c: Column, digits: int) -> Column:
    """Fixed decimals without trailing zeros; 0 is empty."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", c), r"\.?0+$", "")
    return F.when(c == 0, "").otherwise(text)


def coerce_numeric(c: Column, as_int: bool = False, thousands: str | None = None) -> Column:
    """Number in a text with units. A lone comma with at most three digits behind it is a decimal comma, other commas separate thousands; ``thousands='comma'`` makes every comma a separator."""
    s = F.regexp_replace(c.cast("string"), r"[^0-9,.\-]", "")
    plain = F.replace(s, F.lit(","), F.lit(""))
    if thousands != "comma":
        lone = (F.length(s) - F.length(plain) == 1) & ~F.contains(s, F.lit(".")) & (F.length(F.substring_index(s, ",", -1)) <= 3)
        plain = F.when(lone, F.replace(s, F.lit(","), F.lit("."))).otherwise(plain)
    n = plain.try_cast("double")
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("long") if as_int else n


def page_estimate(row_no: Column, rows: Column, pages: Column) -> Column:
    """The page of a row without one: its share of the pages, rounded half to even, within 1 and the last page."""
    return F.greatest(F.lit(1), F.least(pages, F.bround((row_no + 1) / rows * pages).cast("int")))


def clean_number(c: Column) -> Column:
    """The first number, with its spaces, points and commas, after look-alike letters are read as digits."""
    return F.trim(F.regexp_extract(F.translate(c, "OolISB", "001158"), r"[0-9][0-9\s.,]*", 0))


def post_process(kind: Column, c: Column) -> Column:
    """Strip marks at the ends; for numbers and dates the first match in the value, else the value."""
    v = F.btrim(c, F.lit(" :;-|"))
    pattern = lambda p: F.coalesce(F.nullif(F.trim(F.regexp_extract(v, p, 0)), F.lit("")), v)
    return F.when(kind == "number", pattern(r"[0-9][0-9\s.,]*")).when(kind == "date", pattern(r"[0-9]{1,2}[\-/.\s][A-Za-z0-9]{1,9}[\-/.\s][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}")).otherwise(v)


def split_date(c: Column, months: list[str]) -> tuple[Column, Column, Column]:
    """Year, month name and day of the first d/m/y; two-digit years are of this century, months out of range stay as written."""
    pattern = r"([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})"
    day, month, year = (F.regexp_extract(F.coalesce(c, F.lit("")), pattern, g) for g in (1, 2, 3))
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    n = month.try_cast("int")
    named = F.when(n.between(1, len(months)), F.get(F.array(*map(F.lit, months)), n - 1)).otherwise(month)
    return year, named, day


def ratio_bound(a: Column, b: Column) -> Column:
    """No less than ``fuzz_ratio`` and far cheaper: only characters that the other text has can be common."""
    common = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    return F.when(F.length(a) + F.length(b) > 0, 200.0 * F.least(common(a, b), common(b, a)) / (F.length(a) + F.length(b))).otherwise(100.0)


def _lcs_bits(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence for ``b`` of at most 62 characters: a bit per character of ``b`` stays set until it is matched."""
    one, zero, cb = F.lit(1).cast("long"), F.lit(0).cast("long"), F.split(b, "")
    bit = lambda j: F.call_function("shiftleft", one, j)
    places = F.sequence(F.lit(0), F.length(b) - 1)
    full = bit(F.length(b)) - 1

    def step(v: Column, ch: Column) -> Column:
        same = F.aggregate(places, zero, lambda acc, j: F.when(F.get(cb, j) == ch, acc.bitwiseOR(bit(j))).otherwise(acc))
        hit = v.bitwiseAND(same)
        return (v + hit).bitwiseOR(v - hit).bitwiseAND(full)

    return F.length(b) - F.bit_count(F.aggregate(F.split(a, ""), full, step))


def _lcs_rows(a: Column, b: Column) -> Column:
    """The same for texts of any length: rows of the table of lengths, folded over the characters of ``a``."""
    cb, zero = F.split(b, ""), F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(prev: Column, ch: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.greatest(F.element_at(done, -1), F.get(prev, j + 1), F.when(F.get(cb, j) == ch, F.get(prev, j) + 1).otherwise(0))
            return F.array_append(done, best)

        return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(F.split(a, ""), zero, row), -1)


def fuzz_ratio(a: Column, b: Column) -> Column:
    """Normalised indel similarity, 0 to 100: 200 * LCS / (len a + len b)."""
    lcs = F.when(F.length(b) <= 62, _lcs_bits(a, b)).when(F.length(a) <= 62, _lcs_bits(b, a)).otherwise(_lcs_rows(a, b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.when(F.length(a) == F.length(b), 100.0).otherwise(0.0)).otherwise(200.0 * lcs / (F.length(a) + F.length(b)))


def largest_number(field: Column, nearby: Column) -> Column:
    """``nearby``: array of structs with ``text``, in reading order -> struct ``value, anchor``: for weights, volumes and package counts the largest number as it is written, and the word before it; null for other fields or without a number."""
    number = r"[0-9]{1,3}(?:[ ,.][0-9]{3})*(?:[.,][0-9]{1,3})?"
    raw = lambda w: F.regexp_extract(w["text"], f"^(?:{number})$|{number}", 0)
    read = lambda t: F.regexp_replace(F.regexp_replace(t, "[ ,]", ""), r"\.+$", "").try_cast("double")
    # the pattern is looked for once a word
    found = F.filter(F.transform(nearby, lambda w, i: F.struct(raw(w).alias("value"), F.coalesce(F.get(nearby, i - 1)["text"], F.lit("")).alias("anchor"))), lambda w: w["value"] != "")
    numbers = F.transform(found, lambda w: F.struct(read(w["value"]).alias("n"), w["value"].alias("value"), w["anchor"].alias("anchor")))
    best = F.array_max(F.filter(numbers, lambda s: s["n"].isNotNull()))
    return F.when(field.isin("weight", "volume", "pack_qty") & best.isNotNull(), F.struct(best["value"].alias("value"), best["anchor"].alias("anchor")))
