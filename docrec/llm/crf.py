"""A linear-chain conditional random field with two labels, in numpy: training by gradient, decoding by Viterbi.

Sequences of a batch whose lengths lie within a factor of two are padded to the longest of them and worked on together, one
position of every sequence at a time, so padding never takes more room than the items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Weights:
    emit: np.ndarray  # (features, 2)
    step: np.ndarray  # (2, 2): from, to
    first: np.ndarray  # (2,)


def emissions(emit: np.ndarray, feats: list[list[int]]) -> np.ndarray:
    """The summed weights of each item's features; every item has at least one."""
    n = np.fromiter(map(len, feats), np.int64, len(feats))
    flat = np.fromiter((f for own in feats for f in own), np.int64, int(n.sum()))
    return np.add.reduceat(emit[flat], np.cumsum(n) - n, axis=0) if len(feats) else np.zeros((0, 2))


def padded(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of all sequences -> (sequences, longest, 2) and which places are items."""
    mask = np.arange(int(lengths.max(initial=0))) < lengths[:, None]
    out = np.zeros((*mask.shape, 2))
    out[mask] = rows
    return out, mask


def alike(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences of similar length, empty ones left out: their lengths and the places of their items."""
    starts = np.cumsum(lengths) - lengths
    sizes = np.frexp(lengths.astype(float))[1]
    for size in np.unique(sizes[lengths > 0]):
        rows = np.flatnonzero((sizes == size) & (lengths > 0))
        own = lengths[rows]
        yield own, np.repeat(starts[rows] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))


def viterbi(w: Weights, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of all items, from their ``emissions``, one sequence after another."""
    out = np.zeros(len(scores), np.int64)
    for own, items in alike(lengths):
        out[items] = _best(w, *padded(scores[items], own))
    return out


def _best(w: Weights, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
    score, back = e[:, 0] + w.first, np.zeros((*mask.shape, 2), np.int8)
    for t in range(1, mask.shape[1]):
        ways = score[:, :, None] + w.step
        back[:, t] = ways.argmax(axis=1)
        score = np.where(mask[:, t, None], ways.max(axis=1) + e[:, t], score)
    out = np.zeros(mask.shape, np.int64)
    now = score.argmax(axis=1)
    for t in range(mask.shape[1] - 1, -1, -1):
        out[:, t] = now
        now = np.where(mask[:, t], back[np.arange(len(now)), t, now] if t else now, now)
    return out[mask]


def expectations(e: np.ndarray, mask: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition of each sequence, label posteriors at each place, and expected transitions summed over all."""
    n, longest = mask.shape
    a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    a[:, 0] = e[:, 0] + first
    for t in range(1, longest):
        a[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(a[:, t - 1, :, None] + step, axis=1) + e[:, t], a[:, t - 1])
    z = np.logaddexp.reduce(a[:, -1], axis=1)
    moves = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        own = mask[:, t]
        ahead = step + (e[:, t] + b[:, t])[:, None, :]
        b[:, t - 1] = np.where(own[:, None], np.logaddexp.reduce(ahead, axis=2), b[:, t])
        moves += np.exp(a[own, t - 1, :, None] + ahead[own] - z[own, None, None]).sum(axis=0)
    return z, np.exp(a + b - z[:, None, None]), moves


def trained(pages: list[tuple[list[list[int]], list[int]]], features: int, rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Weights:
    """Maximum likelihood by Adam over all sequences at once, with an L2 penalty. ``pages``: features and labels of the items of each sequence."""
    pages = [p for p in pages if p[1]]
    lengths = np.array([len(y) for _, y in pages])
    feats = [f for own, _ in pages for f in own]
    y = np.array([v for _, own in pages for v in own], np.int64)
    n = np.fromiter(map(len, feats), np.int64, len(feats))
    flat, item = np.fromiter((f for own in feats for f in own), np.int64, int(n.sum())), np.repeat(np.arange(len(feats)), n)
    gold = np.bincount(flat * 2 + y[item], minlength=2 * features).reshape(-1, 2).astype(float)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), bool)
    inner[starts] = False
    gold_step = np.bincount(y[np.flatnonzero(inner) - 1] * 2 + y[inner], minlength=4).reshape(2, 2).astype(float)
    gold_first = np.bincount(y[starts], minlength=2).astype(float)
    w = [np.zeros((features, 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for k in range(1, rounds + 1):
        e = np.add.reduceat(w[0][flat], np.cumsum(n) - n, axis=0)
        p, moves = np.zeros_like(e), np.zeros((2, 2))
        for own, items in alike(lengths):
            rows, mask = padded(e[items], own)
            _, q, m_ = expectations(rows, mask, w[1], w[2])
            p[items], moves = q[mask], moves + m_
        want = np.stack([np.bincount(flat, weights=p[item, c], minlength=features) for c in (0, 1)], axis=1)
        slopes = [(want - gold) / len(y) + decay * w[0], (moves - gold_step) / len(y) + decay * w[1], (p[starts].sum(axis=0) - gold_first) / len(y) + decay * w[2]]
        for i, g in enumerate(slopes):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return Weights(*w)
