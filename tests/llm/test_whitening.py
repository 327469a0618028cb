"""Whitening against an eigenvalue decomposition of the whole covariance, with exact sums, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docrec.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def checked(rows, found, components=8):
    """``rows``: (id, vector) of all whole vectors."""
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    a = x - s / n
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    some = [k for k in range(min(components, x.shape[1])) if e[k] > 1e-12 * e[0]]
    got = {}
    for r in found:
        got.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(got) == [k + 1 for k in some] if e[0] > 0 else not got
    for k in some if e[0] > 0 else []:
        own = got[k + 1]
        want = {}
        for i, (name, _) in enumerate(rows):
            want.setdefault(name, []).append(((a[i] @ q[:, k]) / np.sqrt(e[k]), int((((n * x[i].astype(object)) - s.astype(object)) ** 2).sum())))
        assert {i: sorted(r["deviation"] for r in v) for i, v in own.items()} == {i: sorted(d for _, d in v) for i, v in want.items()}
        one = [(sorted(r["whitened"] for r in own[i]), sorted(w for w, _ in want[i])) for i in want]
        flip = [(g, sorted(-w for w in x)) for g, x in one]
        gap = min(abs(e[k] - e[j]) for j in range(len(e)) if j != k) / e[0]
        far = min(max(abs(np.array(g) - np.array(x)).max() for g, x in y) for y in (one, flip))
        assert gap < 1e-6 or far < 1e-8, (k, far)
        assert all(r["n"] == n and abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 for v in own.values() for r in v)


def test_query_equals_an_eigenvalue_decomposition(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = wh.query(spark, small).collect()
    assert len(found) == 8 * len(rows)
    checked(rows, found)


@pytest.mark.parametrize("case", ["few rows", "few directions", "repeated eigenvalues", "one of two", "scales", "steps"])
def test_spectra(spark, case):
    rng = np.random.default_rng(3)
    if case == "few rows":
        a = rng.standard_normal((4, 20))
    elif case == "few directions":
        a = np.round(rng.standard_normal((60, 3)) * 64) / 64 @ np.round(rng.standard_normal((3, 12)) * 4)
    elif case == "repeated eigenvalues":
        a = np.concatenate([np.eye(6), -np.eye(6)] * 3)
    elif case == "one of two":
        a = np.array([[1.0, 2.0]] * 30 + [[3.0, 2.0]])
    else:
        a = rng.standard_normal((300, 24)) * np.logspace(3, -1, 24)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(a)]
    checked(rows, wh.whitened(spark.createDataFrame(rows, SCHEMA), steps=24 if case == "steps" else None).collect())


def test_repeated_eigenvalues_span_their_space(spark):
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(np.concatenate([np.eye(6), -np.eye(6)]))]
    fit = wh.fitted(wh.vectors(spark.createDataFrame(rows, SCHEMA)))
    assert fit.components.shape == (6, 6) and np.abs(fit.components.T @ fit.components - np.eye(6)).max() < 1e-12 and np.ptp(fit.eigenvalues) < 1e-6 * fit.eigenvalues[0]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k), float(k * k % 7), 0.25]) for k in range(9)] + [(3, [1.0, 1.0, 0.5]), (None, [2.0, 0.0, 0.0]), (4, [1.0, 1.0, 0.5]), (4, [1.0, 1.0, 0.5])]
    bad = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [nan, 1.0, 1.0]), (24, [1.0, inf, 1.0]), (25, [1.0, -inf, 1.0]), (26, [1.0, 2.0]), (27, [1.0] * 4)]
    df = spark.createDataFrame(good + bad, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "x", "k", "value", "n", "component")})
    found = wh.whitened(df).collect()
    assert len(found) == 3 * len(good)
    checked(good, found)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(50)]):
        assert wh.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []
    large = [(k, [3e38 * (-1) ** k, 1.0 * k]) for k in range(6)]
    found = wh.whitened(spark.createDataFrame(large, SCHEMA)).collect()
    assert found and all(r["deviation"] is None for r in found)
