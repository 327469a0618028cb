"""Rows from JSON responses that may be fenced, wrapped in prose or cut short; rows keep all their keys."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrec.sources.spelled import few

#: Fields of the whole response.
HEADER = ("vessel", "voyage", "date_of_arrival", "shipowner")
#: The next mark that counts between the items of an array and within an object, or the end. Strings are passed over; one may be cut short at the end.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\Z)'
BETWEEN, WITHIN = (re.compile(rf'(?:[^"{marks}]++|{STRING})*+([{marks}]|\Z)', re.S) for marks in (r"{}\],", "{}"))
OBJECTS = "array<struct<index:int,object:string>>"


def unfenced(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def objects_in(text: str) -> list[dict]:
    """The objects of ``array_objects``."""
    depth = index = at = 0
    start, found = -1, []
    while True:
        m = (WITHIN if depth else BETWEEN).match(text, at)
        mark, at = m[1], m.end()
        if mark == "{":
            if depth == 0:
                start = at - 1
            depth += 1
        elif mark == "}":
            depth -= 1
            if depth == 0 and start >= 0:
                found.append({"index": index, "object": text[start:at]})
                start = -1
        elif depth == 0 and mark == ",":
            index += 1
        else:  # the array's own bracket, or the end
            return found


def objects_of_texts(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct({"index": pa.int32(), "object": pa.string()}))
    # an Arrow array a few texts, so that no more of them are Python's at a time
    return pa.chunked_array([pa.array([None if t is None else objects_in(t) for t in some.to_pylist()], kind) for some in few(texts)], kind).combine_chunks()


def array_objects(text: Column) -> Column:
    """``index, object``: the texts of the objects that are items of an array, of which ``text`` holds what follows its bracket, and their places among all items.

    One walk over the marks with the depth of braces: nested objects, braces in strings and what is no object cost nothing, and
    an object that is cut short is left out. Braces that close nothing count, as depth below zero.
    """
    return F.arrow_udf(objects_of_texts, OBJECTS)(text)


def fields(text: Column) -> Column:
    """All keys of an object with their values as texts (nested ones as JSON, numbers in their shortest spelling); null for what is no object."""
    return F.when(F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, "map<string,string>"))


def inside_array(value: Column) -> Column:
    """What follows the bracket of an array; null for what is no array."""
    return F.when(F.startswith(F.ltrim(value), F.lit("[")), F.substring(F.ltrim(value), F.lit(2), F.length(value)))


def parse_response(raw: Column) -> Column:
    """``header, rows``: the object in a response, as it is, else from the first brace to the last, else what can be salvaged.

    * a header field is the response's own, under the top level; ``rows`` are its objects with all their keys
    * of a text cut short the header fields are found by pattern and every whole object of the first ``rows`` array is taken; a row that does not parse is left out, and places count the rows that are left
    * null where nothing is found: no object, no field and no row
    """
    return rows_of(read_response(raw))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` reads it."""
    return F.transform(F.array(value), f)[0]


def read_response(raw: Column) -> Column:
    """What ``rows_of`` reads: the object in a response (``o``), or that there is none and what can be salvaged (``left``), and the text inside the array that holds its rows (``items``)."""
    top = ", ".join(f"`{c}` string" for c in (*HEADER, "rows"))
    none = F.lit(None).cast(f"struct<{top}>")
    is_whole = lambda t: F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull()

    def items(s: Column) -> Column:
        text, behind = s["text"], F.substring(s["text"], F.locate('"rows"', s["text"]), F.length(s["text"]))
        tail = F.when((F.locate('"rows"', text) > 0) & (F.locate("[", behind) > 0), F.substring(behind, F.locate("[", behind) + 1, F.length(text))).otherwise("")
        field = lambda n: F.when(F.regexp_like(text, F.lit(rf'"{n}"\s*:\s*"[^"]*"')), F.regexp_extract(text, rf'"{n}"\s*:\s*"([^"]*)"', 1))
        left = s["o"].isNull() & s["no_other"]
        found = F.when(left, F.struct(*(field(c).alias(c) for c in HEADER)))
        return F.struct(s["o"].alias("o"), found.alias("left"), F.when(s["o"].isNotNull(), inside_array(s["o"]["rows"])).when(left, tail).alias("items"))

    # a whole text that is no object has no rows
    one = lambda text: F.struct(text.alias("text"), F.try_parse_json(text).isNull().alias("no_other"))
    braced = lambda s: F.when(s["no_other"], F.regexp_extract(s["text"], r"(?s)(\{.*\})", 1))
    other = lambda s: let(braced(s), lambda t: F.when(is_whole(t), F.from_json(t, f"struct<{top}>")))
    own = lambda s: F.when(F.startswith(s["text"], F.lit("{")) & ~s["no_other"], F.from_json(s["text"], f"struct<{top}>")).otherwise(F.when(s["no_other"], other(s)).otherwise(none))
    return let(let(let(unfenced(raw), one), lambda s: F.struct(s["text"].alias("text"), s["no_other"].alias("no_other"), own(s).alias("o"))), items)


def rows_of(r: Column) -> Column:
    """``header, rows`` from what ``read_response`` found; one array is walked, whichever holds the rows."""
    objects = F.coalesce(array_objects(r["items"]), F.expr(f"cast(array() as {OBJECTS})"))
    # objects only, each with its place among all items, or among the rows that are left of a text cut short
    every = F.filter(F.transform(objects, lambda o: F.struct((o["index"] + 1).alias("place"), fields(o["object"]).alias("fields"))), lambda o: o["fields"].isNotNull())

    def result(s: Column) -> Column:
        own, left, rows = s["r"]["o"], s["r"]["left"], s["rows"]
        header = lambda o: F.struct(*(o[c].alias(c) for c in HEADER)).alias("header")
        some = F.coalesce(*(left[c] for c in HEADER)).isNotNull() | (F.size(rows) > 0)
        again = F.transform(rows, lambda o, i: F.struct((i + 1).alias("place"), o["fields"].alias("fields")))
        return F.when(own.isNotNull(), F.struct(header(own), rows.alias("rows"))).when(left.isNotNull() & some, F.struct(header(left), again.alias("rows")))

    return let(F.struct(r.alias("r"), every.alias("rows")), result)


def flatten_rows(responses: DataFrame) -> DataFrame:
    """``doc_id, chunk_no, raw`` -> a row per extracted row, with ``fields``, the map of all its keys.

    The number of its split is its own, or its place from 1; its page its own, as a number or a text of one, or 0; header fields are
    its own, or the response's. A value that is no number where one is needed is null in the column and as it stands in ``fields``.
    """
    read = responses.select("doc_id", "chunk_no", read_response(F.col("raw")).alias("read"))
    parsed = read.select("doc_id", "chunk_no", rows_of(F.col("read")).alias("r"))
    rows = parsed.select("doc_id", "chunk_no", "r.header", F.inline("r.rows"))
    own = lambda c: F.map_contains_key("fields", c)
    number = lambda c, other: F.when(own(c), F.col("fields")[c].try_cast("int")).otherwise(other)
    return rows.select(
        "doc_id", "chunk_no", number("split_number", F.col("place")).alias("split_number"), *(F.col("fields")[c].alias(c) for c in ("bl_number", "container_number", "weight")), number("page", F.lit(0)).alias("page"),
        *(F.when(own(c), F.col("fields")[c]).otherwise(F.col("header")[c]).alias(c) for c in HEADER), "fields",
    )


def merge_headers(rows: DataFrame) -> DataFrame:
    """The first chunk's header fills blanks of that and later chunks of its document."""
    before = Window.partitionBy("doc_id").orderBy("chunk_no").rangeBetween(Window.unboundedPreceding, 0)
    fill = {c: F.coalesce(F.nullif(c, F.lit("")), F.first(F.nullif(c, F.lit("")), ignorenulls=True).over(before)) for c in HEADER if c in rows.columns}
    return rows.withColumns(fill)
