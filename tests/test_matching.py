"""Many patterns in one pass against plain search."""

import random
import re

import pytest

from docrec.operators import matching as ma


def test_matches_equal_plain_search():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("AB_ .é1") for _ in range(rng.randint(0, 60)))
        patterns = {("".join(rng.choice("AB_ .é1") for _ in range(rng.randint(1, 4))), rng.random() < 0.5) for _ in range(12)}
        want = {p for p, whole in patterns if re.search((r"(?<![A-Z0-9_])" if whole else "") + re.escape(p) + (r"(?![A-Z0-9_])" if whole else ""), text)}
        got = ma.matches(text, ma.automaton(list(patterns)))
        assert set(got) == want and len(got) == len(set(got))


@pytest.mark.parametrize("most_bytes", [1 << 24, 3])
def test_patterns_in_as_many_passes_as_they_need(spark, most_bytes):
    texts = spark.createDataFrame([(1, "THE MSC SHIP"), (1, "MSC"), (2, None), (3, ""), (4, "EMSC")], "id int, t string")
    patterns = spark.createDataFrame([("MSC", True), ("MSC", True), ("SC", False), ("", False), ("SHIP", True), ("THE M", False)], "pattern string, whole boolean")
    got = sorted((r["id"], r["pattern"]) for r in ma.found_patterns(texts, patterns, "t", most_bytes).collect())
    assert got == sorted([(1, "MSC"), (1, "SC"), (1, "SHIP"), (1, "THE M"), (1, "MSC"), (1, "SC"), (4, "SC")])
    assert ma.found_patterns(texts, patterns.limit(0), "t").count() == 0
    plan = ma.found_patterns(texts, patterns, "t", most_bytes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
