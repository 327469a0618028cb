"""Rows of responses against a plain depth walk in Python, cut at every place."""

import json
import re

import pytest
from pyspark.sql import functions as F

from docrec.operators import jsonrows as js

TEXTS = [
    '{"vessel": "A", "voyage": "7", "rows": [{"bl_number": "1", "page": "2", "extra": {"a": {"b": "}]"}}, "note": "x\\"}{"}, {"bl_number": "2", "list": [1, {"c": 2}]}, {}, {"bl_number": "3"}]}',
    '{"rows": [{"a": "1"}, 5, "{\\"b\\": 1}", null, {"split_number": "9", "vessel": "own"}], "shipowner": "S", "date_of_arrival": "d"}',
    '```json\n{"rows": [{"k": "]", "é": "ü 漢"}, {"k": "[{"}, {bad}, {"k": "4"}]}\n```',
    'Here it is: {"voyage": "", "rows": [{"k": null, "n": 1.50, "t": true}]} done',
    '{"other": {"rows": 1}, "vessel": "V"', '[{"a": 1}]', "nothing", "", '{"rows": "none"}', '{"rows": []}', '{"vessel": "x\\', '{"rows": [}, {"a": "1"}, {"b": "2"}]',
]


def walk(raw):
    """Header fields and (place, keys) of the rows, or None."""
    s = (raw or "").strip()
    s = re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```[a-zA-Z]*\s*", "", s)).strip()
    for t in (s, (re.search(r"\{.*\}", s, re.S) or [""])[0]):
        try:
            data = json.loads(t)
        except ValueError:
            continue
        if not isinstance(data, dict):
            return None
        rows = data.get("rows") if isinstance(data.get("rows"), list) else []
        return {c: data.get(c) for c in js.HEADER}, [(i + 1, set(r)) for i, r in enumerate(rows) if isinstance(r, dict)]
    header = {c: m[1] if (m := re.search(rf'"{c}"\s*:\s*"([^"]*)"', s)) else None for c in js.HEADER}
    rows, at = [], s.find('"rows"')
    at = s.find("[", at) if at >= 0 else -1
    depth = i = 0
    string = escaped = False
    start = None
    for i, c in enumerate(s[at + 1 :] if at >= 0 else "", at + 1):
        if string:
            escaped, string = (not escaped and c == "\\"), escaped or c != '"'
        elif c == '"':
            string, escaped = True, False
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and start is not None:
                try:
                    rows.append(set(json.loads(s[start : i + 1])))
                except ValueError:
                    pass
                start = None
        elif c == "]" and depth == 0:
            break
    return (header, list(enumerate(rows, 1))) if rows or any(v is not None for v in header.values()) else None


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, raw string").withColumn("r", js.parse_response(F.col("raw")))
    return [r["r"] and (r["r"]["header"].asDict(), [(x["place"], set(x["fields"])) for x in r["r"]["rows"]]) for r in df.orderBy("n").collect()]


def test_every_truncation_of_every_text(spark):
    cuts = sorted({t[:k] for t in TEXTS for k in range(len(t) + 1)})
    for text, got in zip(cuts, parsed(spark, cuts)):
        assert got == walk(text), text


def test_rows_keep_all_keys_and_their_own_values(spark):
    df = spark.createDataFrame([(1, 0, TEXTS[0]), (2, 0, TEXTS[1]), (3, 0, TEXTS[3]), (4, 0, None)], "doc_id int, chunk_no int, raw string")
    got = sorted(js.flatten_rows(df).collect(), key=lambda r: (r["doc_id"], r["split_number"]))
    assert [(r["doc_id"], r["split_number"], r["page"], r["bl_number"], r["vessel"], r["voyage"]) for r in got] == [
        (1, 1, 2, "1", "A", "7"), (1, 2, 0, "2", "A", "7"), (1, 3, 0, None, "A", "7"), (1, 4, 0, "3", "A", "7"), (2, 1, 0, None, None, None), (2, 9, 0, None, "own", None), (3, 1, 0, None, None, ""),
    ]
    assert json.loads(got[0]["fields"]["extra"]) == {"a": {"b": "}]"}} and got[0]["fields"]["note"] == 'x"}{'
    assert got[4]["shipowner"] == "S" and got[4]["date_of_arrival"] == "d" and got[6]["fields"] == {"k": None, "n": "1.5", "t": "true"}


@pytest.mark.parametrize("n", [1, 3000])
def test_long_responses(spark, n):
    rows = [{"bl_number": f"B{k}", "note": '\\"{}[]' * 50, "deep": [{"x": {"y": k}}]} for k in range(n)]
    text = json.dumps({"vessel": "V", "rows": rows})
    ((header, got), (_, cut)) = parsed(spark, [text, text[:-5]])
    assert header["vessel"] == "V" and len(got) == n and len(cut) == n - 1
