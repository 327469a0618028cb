"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows ``A`` stay where they are; the driver holds vectors of the length of a row only. A left vector ``u`` is
never stored: it is ``A p`` for a short ``p`` that follows from the same recursion, so a task makes the left vectors of
its own rows when it needs them, whatever executor it runs on. One step is one job over all rows:

* ``w = A v - beta u`` of the last step, its products with all earlier left vectors, and ``A' w``, summed over the rows;
* the driver takes the products with earlier vectors out of ``w`` and ``A' w`` (full reorthogonalisation on the left, as
  the same combination of short vectors), which gives ``alpha`` and, after reorthogonalisation on the right, ``beta``.

The singular value decomposition of the small bidiagonal matrix gives components and deviations. Where a direction is
exhausted (``alpha`` or ``beta`` vanishes, as with repeated eigenvalues or few rows), the recursion goes on from a new
vector that is orthogonal to the old ones, so that after as many steps as there are dimensions nothing is missing.

Sums come from each task as one short row a number and are added up by Spark; the driver gets ``d + steps + 2`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrec.llm.common import stored, table

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 50
CELLS = 1 << 21
VANISHED = 1e-13
LEAST = 1e-12  # of the largest deviation; components below it are not told from zero


@dataclass(frozen=True)
class Fit:
    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    components: np.ndarray  # (d, c), of length one
    eigenvalues: np.ndarray
    trace: float
    steps: int

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x``: the rows whose vector is whole, with entries ``floor(1024 c) + 100000``; of vectors of several lengths those of the most frequent (of equally frequent ones the greatest) stay."""
    c = F.col(vector_col)
    whole = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    entry = lambda e: F.floor(F.least(F.greatest(e.cast("double") * SCALE, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))) + SHIFT
    kept = stored(table.where(c.isNotNull() & whole & (F.size(c) > 0)).select(F.col(id_col).alias("id"), F.transform(c, entry).alias("x")), "vectors")
    sizes = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return kept if len(sizes) < 2 else kept.where(F.size("x") == sizes[0]["d"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and entries of some rows at a time."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rows = max(1, CELLS // flat.shape[1])
            for k in range(0, batch.num_rows, rows):
                yield batch.column("id").slice(k, rows), flat[k : k + rows]


def summed(x: DataFrame, f: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of ``f``, which gives ``width`` numbers for a block of rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, block in blocks(batches):
            got = f(block)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["k", "value"])

    out = np.zeros(width, np.int64 if kind == "long" else np.float64)
    for row in x.mapInArrow(task, f"k int, value {kind}").groupBy("k").agg(F.sum("value").alias("value")).collect():
        out[row["k"]] = row["value"]
    return out


def fitted(x: DataFrame, components: int = 8, steps: int | None = None, seed: int = 11) -> Fit | None:
    """Fit on all rows of ``vectors``; None if there is none. ``steps`` bounds the recursion (None: one a dimension, which misses nothing); it also ends once the wanted components no longer change."""
    first = x.select("x").first()
    if first is None:
        return None
    d = len(first[0])
    halves = lambda b: np.concatenate([(b >> 20).sum(axis=0), (b & ((1 << 20) - 1)).sum(axis=0), [len(b)]])
    got = [int(v) for v in summed(x, halves, 2 * d + 1, "long")]
    n, sums = got[-1], tuple((a << 20) + b for a, b in zip(got[:d], got[d : 2 * d]))
    mean = np.array([s / n for s in sums])
    square = float(summed(x, lambda b: np.array([((b - mean) ** 2).sum()]), 1)[0])
    size = np.sqrt(square)
    rng = np.random.default_rng(seed)

    v = np.zeros((d, 0))  # right vectors
    p, z = np.zeros((d, 0)), np.zeros((d, 0))  # A p are the left vectors, z = A' A p
    bidiagonal = np.zeros((d, d))
    beta, after = 0.0, None
    most = min(d, steps or d)
    while v.shape[1] < most and size > 0:
        if after is None:  # a start that owes nothing to the vectors so far
            after, beta = rng.standard_normal(d), 0.0
            for _ in range(2):
                after -= v @ (v.T @ after)
            after /= np.linalg.norm(after)
        right, k, m = after, v.shape[1], p.shape[1]
        v = np.column_stack([v, right])
        for again in (False, True):
            short = (right - (beta * p[:, -1] if beta else 0)) if not again else short - p @ h

            def step(b: np.ndarray, short: np.ndarray = short) -> np.ndarray:
                a = b - mean
                w = a @ short
                return np.concatenate([(a @ p).T @ w, a.T @ w, [w @ w]])

            got = summed(x, step, m + d + 1)
            h, back, length = got[:m], got[m : m + d], got[-1]
            if h @ h <= 1e-6 * length or length <= (VANISHED * size) ** 2:
                break
        alpha = np.sqrt(max(length - h @ h, 0.0))
        if beta:
            bidiagonal[m - 1, k] = beta
        after = None
        if alpha > VANISHED * size:
            bidiagonal[m, k] = alpha
            p, z = np.column_stack([p, (short - p @ h) / alpha]), np.column_stack([z, (back - z @ h) / alpha])
            rest = z[:, -1] - alpha * right
            for _ in range(2):
                rest -= v @ (v.T @ rest)
            beta = float(np.linalg.norm(rest))
            if beta > VANISHED * size:
                after = rest / beta
                if steps and k + 1 >= components:
                    left, s, _ = np.linalg.svd(bidiagonal[: m + 1, : k + 1])
                    if beta * np.abs(left[-1, :components]).max() <= 4 * np.finfo(float).eps * s[0]:
                        break
    k = v.shape[1]
    if not k:
        return Fit(n, sums, mean, np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    _, deviations, turned = np.linalg.svd(bidiagonal[: max(p.shape[1], 1), :k])
    some = [i for i in range(min(components, len(deviations))) if deviations[i] > LEAST * deviations[0]]
    found = v @ turned[some].T
    found *= np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(some))])  # the largest entry is positive
    return Fit(n, sums, mean, found, deviations[some] ** 2 / n, square / n, k)


def identity_error(x: DataFrame, fit: Fit) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    c = fit.components.shape[1]
    whiten, mean = fit.projection, fit.mean
    middle = summed(x, lambda b: ((b - mean) @ whiten).sum(axis=0), c) / fit.n

    def products(b: np.ndarray) -> np.ndarray:
        y = (b - mean) @ whiten - middle
        return (y.T @ y).ravel()

    return float(np.abs(summed(x, products, c * c).reshape(c, c) / fit.n - np.eye(c)).max())


def spread(block: np.ndarray, fit: Fit) -> list[int | None]:
    """The sum of ``(n x - S) ** 2`` of each row, exactly; None where it is beyond 63 bits."""
    base = np.array([s // fit.n for s in fit.sums])
    rest = [s - fit.n * int(b) for s, b in zip(fit.sums, base)]
    away = block - base
    bound = fit.n * (np.abs(away).max(axis=1).astype(float) + 1)
    out: list[int | None] = []
    small = np.flatnonzero(bound**2 * block.shape[1] < 2.0**62)
    exact = np.zeros(len(block), np.int64)
    exact[small] = ((away[small] * fit.n - np.array(rest, np.int64)) ** 2).sum(axis=1) if len(small) else 0
    fits = set(small.tolist())
    for k in range(len(block)):
        value = int(exact[k]) if k in fits else sum((int(a) * fit.n - r) ** 2 for a, r in zip(away[k], rest))
        out.append(value if value < 1 << 63 else None)
    return out


def whitened(embeddings: DataFrame, components: int = 8, steps: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``: a row for each whole vector and component.

    * vectors that are null or empty or hold a null or a number that is not finite have no rows, nor have those of another length than most
    * repeated rows count and come out each for itself; null ids are ids like any other; other columns are not read
    * fewer components come out where the vectors vary in fewer directions: none if all are equal, and no row for an empty table
    * entries are held within ``2 ** 50 / 1024``; ``deviation`` is null where it is beyond 63 bits
    * a component's largest entry is positive; components of equal eigenvalues are any basis of their plane
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = vectors(embeddings, id_col, vector_col)
    fit = fitted(x, components, steps)
    if fit is None or not fit.components.shape[1]:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error, c = identity_error(x, fit), fit.components.shape[1]
    whiten, explained = fit.projection, fit.eigenvalues / fit.trace

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in blocks(batches):
            rows = len(block)
            each = pa.array(np.repeat(np.arange(rows), c))
            cols = [
                ids.take(each), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), rows)), pa.array(np.full(rows * c, fit.n)), pa.array(spread(block, fit), pa.int64()).take(each),
                pa.array(((block - fit.mean) @ whiten).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * c, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(task, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))
