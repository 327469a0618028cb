"""Near groups without odds: lists of all values, against all pairs."""

import random

from docrec.llm import near_dedup
from tests.llm.test_operators import brute_components

SCHEMA = "doc_id long, text string"


def test_agree_zero_finds_every_link(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(40)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 5)):
            own = list(b)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    pool = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(12)]
    rows += [" ".join(rng.sample(pool, 6)) for _ in range(60)] + ["", None, "the same", "the same"]
    rows = list(enumerate(rows))
    want = sorted(brute_components(rows, 4))
    for block in (4, 128):
        got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA), words=4, agree=0, block=block).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
