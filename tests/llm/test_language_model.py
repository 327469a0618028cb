"""The pair model against a plain one in Python, its probabilities as a distribution, and odd tables."""

import collections
import math
import os
import re

import numpy as np
from pyspark.sql import functions as F

from docrec.llm import language_model as lm

SCHEMA = "doc_id long, text string"
TEXTS = ["the cat sat", "the cat ran", "A dog ran", "the dog sat", "the cat sat", "", "a a a a b", "the the the", "rare words here", "é É ê"]


class Plain:
    def __init__(self, texts):
        self.c = collections.Counter()
        for t in texts:
            w = ["<s>", *self.words(t), "</s>"]
            self.c.update(zip(w, w[1:]))
        self.n, self.kinds, self.total = collections.Counter(), collections.Counter(w for _, w in self.c), collections.Counter()
        for (v, w), n in self.c.items():
            self.n[w] += n
            self.total[v] += n

    @staticmethod
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(x.lower() if "A" <= x <= "Z" else x for x in t or ""))

    @staticmethod
    def discounts(counts):
        n = [sum(x == k for x in counts) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        found = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [0, *(min(max(d, least), k) for k, (d, least) in enumerate(zip(found, (0.1, 0.2, 0.3)), 1))]

    def single(self, w):
        d = self.discounts(self.kinds.values())
        left = sum(d[min(x, 3)] for x in self.kinds.values())
        return (max(self.kinds[w] - d[min(self.kinds[w], 3)], 0) + left / (len(self.n) + 1)) / len(self.c)

    def p(self, v, w):
        if not self.total[v]:
            return self.single(w)
        d = self.discounts(self.c.values())
        held = sum(d[min(x, 3)] for (a, _), x in self.c.items() if a == v)
        return (max(self.c[v, w] - d[min(self.c[v, w], 3)], 0) + held * self.single(w)) / self.total[v]

    def score(self, t):
        w = ["<s>", *self.words(t), "</s>"]
        return sum(math.log10(self.p(*x)) for x in zip(w, w[1:]))

    def base(self, t):
        return sum(math.log10((self.n[x] + 1) / (sum(self.n.values()) + len(self.n) + 1)) for x in [*self.words(t), "</s>"])


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def test_scores_equal_a_plain_model_for_any_number_of_shards(spark):
    plain, asked = Plain(TEXTS), [*TEXTS, "the unseen cat", "unseen", None, "ran the"]
    for shard_bytes in (1 << 25, 4, 1):
        model = lm.trained(frame(spark, TEXTS), shard_bytes=shard_bytes)
        assert model.bits == {1 << 25: 1, 4: 3, 1: 4}[shard_bytes]
        got = {r["doc_id"]: r for r in lm.perplexities(frame(spark, asked), model).collect()}
        for k, t in enumerate(asked):
            assert abs(got[k]["score"] - plain.score(t)) < 2e-6 and abs(got[k]["base_score"] - plain.base(t)) < 2e-6
            assert got[k]["n_tokens"] == len(plain.words(t)) + 1 and got[k]["n_known"] == sum(plain.n[w] > 0 for w in plain.words(t)) + 1
            assert got[k]["train_tokens"] == sum(plain.n.values())


def test_probabilities_after_any_word_sum_to_one(spark):
    model = lm.trained(frame(spark, TEXTS))
    words = sorted({w for t in TEXTS for w in Plain.words(t)})
    for before in (*words, "unseen"):
        texts = [f"{before} {w}" for w in (*words, "unheard")]
        got = lm.scored([t.encode() for t in texts], model)["score"]
        # leave out what all these texts share, and the end after the last word
        first = Plain(TEXTS)
        tail = np.array([math.log10(first.p("<s>", before)) + math.log10(first.p(w, "</s>")) for w in (*words, "unheard")])
        seen = sum(10 ** (got - tail))
        assert abs(seen + first.p(before, "</s>") - 1) < 1e-9  # the unheard word has the share of all unknown ones


def test_files_are_sorted_hashes_and_whole(spark):
    model = lm.trained(frame(spark, TEXTS), shard_bytes=4)
    names = os.listdir(model.folder)
    assert not [n for n in names if not n.endswith(".npy")]
    for n in (n for n in names if n.endswith("-key.npy")):
        key = np.load(os.path.join(model.folder, n), mmap_mode="r")
        assert isinstance(key, np.memmap) and (np.diff(key.astype(object)) > 0).all()
    assert sum(len(np.load(os.path.join(model.folder, n))) for n in names if n.startswith("pairs-") and n.endswith("key.npy")) == len(Plain(TEXTS).c) == model.totals.pairs


def test_odd_rows_and_no_text_to_learn_from(spark):
    rows = [(1, "word " * 300_000), (None, "Hello"), (2, None), (2, None), (3, " \n\t"), (4, "hello"), (5, "   ")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "_text", "_0", "n", "shard", "n_tokens", "held_out")})
    got = lm.perplexities(df, lm.trained(df)).collect()
    assert len(got) == 7 and sorted(r["n_tokens"] for r in got) == [1, 1, 1, 2, 2, 3, 300_001]
    assert len({r["score"] for r in got if r["doc_id"] in (None, 4)}) == 1 and all(math.isfinite(r["score"]) for r in got)
    nothing = lm.trained(df.limit(0))
    assert nothing.totals == lm.Totals() and {(r["score"], r["base_score"], r["n_known"]) for r in lm.perplexities(df, nothing).collect()} == {(0.0, 0.0, 0)}
    assert lm.perplexities(df.limit(0), nothing).count() == 0
