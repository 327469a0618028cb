"""Language-model scoring: an interpolated modified Kneser-Ney model of word pairs, counted in Spark and memory-mapped by the workers.

1. Tasks turn texts into pairs of a word and the one before it (a start before the first, an end after the last), add up
   equal pairs in numpy and send each shard its part, as packed columns. A pair's shard follows from some hash bits of
   both words, so the followers of a very common word lie in as many shards as the square root of their number, and a
   common pair is one row of each task.
2. A shard adds up its pairs and writes them as an array of sorted hashes and one of counts. For each word it sends on
   what it knows of it as a predecessor (followers seen once, twice, more often) and as a follower (times, predecessors).
3. Word shards, as many as there are of pairs, add those up and write sorted hashes, counts and continuation counts. The counts of counts, from which the
   discounts follow, are summed by Spark: one row for the driver.
4. Scoring maps the arrays into memory and looks up each batch's words and pairs in sorted order, so a page of an array is
   read once a batch. Texts never leave their partition.

``p(w | v) = (max(c(v, w) - D(c), 0) + (D1 N1(v) + D2 N2(v) + D3 N3(v)) p(w)) / c(v)``, and ``p(w)`` likewise from the number
of distinct predecessors, with the uniform probability ``1 / (V + 1)`` below it, where one share is that of all unknown words.

The number of shards grows with the text, so that a shard stays at some 10 million tokens. Files are written under a
name of their own and renamed, so a task that runs twice leaves one whole file. They are scratch, in a shared folder
that workers can open by path: mapping needs one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrec.llm.common import CRC32_SQL, UPPER, WORD, new_folder, slices, table, utf8
from docrec.llm.language_id import held_out
from docrec.llm.shingles import PLACES, mixed, word_hashes

#: No word holds a space.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))
SHARD_BYTES = 1 << 25
FLUSH = 1 << 21
LOW = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class Totals:
    """Sums over the corpus: tokens, words, pairs and how many pairs and words have a count of 1 to 4."""

    tokens: int = 0
    words: int = 0
    pairs: int = 0
    pair1: int = 0
    pair2: int = 0
    pair3: int = 0
    pair4: int = 0
    word1: int = 0
    word2: int = 0
    word3: int = 0
    word4: int = 0


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int  # of each word's hash in a shard's number
    totals: Totals

    def discounts(self, kind: str) -> np.ndarray:
        """What counts 0, 1, 2 and 3 or more lose."""
        n1, n2, n3, n4 = (getattr(self.totals, f"{kind}{k}") for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        found = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        return np.array([0.0, *(min(max(d, least), k) for k, (d, least) in enumerate(zip(found, (0.1, 0.2, 0.3)), 1))])


# tokens and keys


def narrowed(h: np.ndarray, bits: int) -> np.ndarray:
    """The part of a word's hash that tells it from others: the bits of its shard and 48 below them."""
    return h >> np.uint64(16 - bits)


def pair_keys(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """The hash of each pair, headed by its shard."""
    shard = ((v >> np.uint64(48)) << np.uint64(bits)) | (w >> np.uint64(48))
    return (shard << np.uint64(64 - 2 * bits)) | (mixed(v * PLACES[0] + w * PLACES[1]) >> np.uint64(2 * bits))


def word_shards(w: np.ndarray, bits: int) -> np.ndarray:
    return w >> np.uint64(48 - bits)


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where the runs of equal values start and end."""
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist() if len(x) else []
    return list(zip(starts, [*starts[1:], len(x)]))


def tokens(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predecessors and words of all texts, one after another, and where each text ends."""
    words = [word_hashes(t) for t in texts]
    ends = np.cumsum([len(x) + 1 for x in words], dtype=np.int64)
    w = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    at = 0
    for x in words:
        w[at : at + len(x)] = x
        at += len(x) + 1
    w[ends - 1] = END
    v = np.roll(w, 1)
    v[np.concatenate(([0], ends[:-1]))[: len(ends)]] = START
    return narrowed(v, bits), narrowed(w, bits), ends


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(pieces: list[bytes], top: int) -> np.ndarray:
    low = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.view("<u8").ravel() | np.uint64(top << 48)


def numbers(pieces: list[bytes], width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(p, "<i8").reshape(width, -1) for p in pieces], axis=1) if pieces else np.zeros((width, 0), np.int64)


def summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and the sums of ``values`` (a row a number) over equal keys."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return sorted_key[first], order[first], np.add.reduceat(values[:, order], first, axis=1) if len(key) else values


# files


def save(folder: str, name: str, x: np.ndarray) -> None:
    """Write an array in the least type that holds it, whole or not at all."""
    if x.dtype != np.uint64:
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f"{name}.{uuid.uuid4().hex}.part")
    with open(part, "wb") as out:
        np.save(out, x)
    os.replace(part, os.path.join(folder, f"{name}.npy"))


@lru_cache(maxsize=1024)
def mapped(folder: str, name: str) -> np.ndarray | None:
    path = os.path.join(folder, f"{name}.npy")
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def looked_up(folder: str, kind: str, columns: tuple[str, ...], keys: np.ndarray, shift: int) -> np.ndarray:
    """The numbers of sorted ``keys``, 0 where a key is not there; ``keys >> shift`` is the shard of each."""
    out = np.zeros((len(columns), len(keys)), np.int64)
    shards = keys >> np.uint64(shift)
    for a, b in runs(shards):
        there = mapped(folder, f"{kind}-{int(shards[a])}-key")
        if there is None or not len(there):
            continue
        at = np.searchsorted(there, keys[a:b])
        at[at == len(there)] = 0
        hit = np.flatnonzero(there[at] == keys[a:b])
        for k, c in enumerate(columns):
            out[k, a + hit] = mapped(folder, f"{kind}-{int(shards[a])}-{c}")[at[hit]]
    return out


def shared_path(uri: str) -> str:
    if "://" not in uri and not uri.startswith("file:"):
        return uri
    if not uri.startswith("file:"):
        raise RuntimeError(f"arrays can't be mapped from {uri}: set spark.checkpoint.dir to a shared folder that is mounted on all workers")
    return "/" + uri.removeprefix("file:").lstrip("/")


# training and scoring


def trained(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count all rows of ``docs``; a null text counts as empty. A task of the second step gets a few pieces from each of ``2 ** bits`` tasks of the first for either side; the driver gets one row of sums."""
    spark = docs.sparkSession
    texts = docs.select(utf8(F.col(text_col)).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 1
    while bits < 16 and size > shard_bytes << (2 * bits):
        bits += 1
    folder = shared_path(new_folder(spark, "kneser-ney"))

    def flushed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        v, w = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        key, at, n = summed(pair_keys(v, w, bits), np.ones((1, len(v)), np.int64))
        v, w, n = v[at] & LOW, w[at] & LOW, n[0].astype("<u4")
        shards = key >> np.uint64(64 - 2 * bits)
        parts = [slice(a, b) for a, b in runs(shards)]
        cols = [pa.array([int(shards[p.start]) for p in parts], pa.int32()), *(pa.array([packed(x[p]) for p in parts], pa.binary()) for x in (v, w)), pa.array([n[p].tobytes() for p in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "v", "w", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text"):
            v, w, _ = tokens(batch.column("text").to_pylist(), bits)
            held.append((v, w))
            size += len(w)
            if size >= FLUSH:
                yield flushed(held)
                held, size = [], 0
        if size:
            yield flushed(held)

    def shard_of(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        i, j = shard >> bits, shard & ((1 << bits) - 1)
        v, w = unpacked(group.column("v").to_pylist(), i), unpacked(group.column("w").to_pylist(), j)
        n = np.frombuffer(b"".join(group.column("n").to_pylist()), "<u4").astype(np.int64)
        key, at, (n,) = summed(pair_keys(v, w, bits), n[None])
        save(folder, f"pairs-{shard}-key", key)
        save(folder, f"pairs-{shard}-n", n)
        sent: dict[str, list] = {c: [] for c in SENT.names}
        for before, of, values in ((True, v[at], np.stack([n, n == 1, n == 2, n >= 3])), (False, w[at], np.stack([n, np.ones_like(n)]))):
            of, _, values = summed(of, values)
            for a, b in runs(shards := word_shards(of, bits)):
                first = not sent["shard"]
                row = (int(shards[a]), before, packed(of[a:b] & LOW), values[:, a:b].astype("<i8").tobytes(), len(n) * first, *(int((n == k).sum()) * first for k in (1, 2, 3, 4)))
                for c, x in zip(SENT.names, row):
                    sent[c].append(x)
        return pa.table(sent, schema=SENT)

    def words_of(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        before = group.column("before").to_numpy(zero_copy_only=False)
        get = lambda c, which: [x for x, y in zip(group.column(c).to_pylist(), before) if y == which]
        v, w = (unpacked(get("word", which), shard >> bits) for which in (True, False))
        of_v, of_w = numbers(get("numbers", True), 4), numbers(get("numbers", False), 2)
        zeros = np.zeros((1, len(w)), np.int64)
        key, _, found = summed(np.concatenate([v, w]), np.concatenate([np.concatenate([of_v, np.zeros((2, len(v)), np.int64)]), np.concatenate([zeros, zeros, zeros, zeros, of_w])], axis=1))
        total, once, twice, often, n, kinds = found
        save(folder, f"words-{shard}-key", key)
        for c, x in (("n", n), ("total", total), ("kinds", kinds), ("once", once), ("twice", twice), ("often", often)):
            save(folder, f"words-{shard}-{c}", x)
        sums = {c: [sum(group.column(c).to_pylist())] for c in ("pairs", "pair1", "pair2", "pair3", "pair4")}
        return pa.table({"tokens": [int(n.sum())], "words": [int((n > 0).sum())], **sums, **{f"word{k}": [int((kinds == k).sum())] for k in (1, 2, 3, 4)}})

    counted = texts.mapInArrow(pairs, "shard int, v binary, w binary, n binary").groupBy("shard").applyInArrow(shard_of, "shard int, before boolean, word binary, numbers binary, pairs long, pair1 long, pair2 long, pair3 long, pair4 long")
    names = [f.name for f in fields(Totals)]
    sums = counted.groupBy("shard").applyInArrow(words_of, ", ".join(f"{c} long" for c in names))
    row = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    return Model(folder, bits, Totals(*row))


SENT = pa.schema([("shard", pa.int32()), ("before", pa.bool_()), ("word", pa.binary()), ("numbers", pa.binary()), *((c, pa.int64()) for c in ("pairs", "pair1", "pair2", "pair3", "pair4"))])


def scored(texts: list[bytes], model: Model) -> dict[str, np.ndarray]:
    """``n_tokens, n_known, base_score, score`` of each text."""
    t, bits = model.totals, model.bits
    v, w, ends = tokens(texts, bits)
    known, place = np.unique(np.concatenate([w, narrowed(np.array([START]), bits)]), return_inverse=True)
    n, total, kinds, once, twice, often = looked_up(model.folder, "words", ("n", "total", "kinds", "once", "twice", "often"), known, 48 - bits)
    low, high = model.discounts("word"), model.discounts("pair")
    left = low[1] * t.word1 + low[2] * t.word2 + low[3] * (t.words - t.word1 - t.word2)
    single = (np.maximum(kinds - low[np.minimum(kinds, 3)], 0) + left / (t.words + 1)) / t.pairs if t.pairs else np.ones(len(known))
    held = high[1] * once + high[2] * twice + high[3] * often

    starts = np.concatenate(([0], ends[:-1]))[: len(ends)]
    at_w, at_v = place[:-1], np.roll(place[:-1], 1)
    at_v[starts] = place[-1]
    order = np.argsort(key := pair_keys(v, w, bits))
    c = np.zeros(len(w), np.int64)
    c[order] = looked_up(model.folder, "pairs", ("n",), key[order], 64 - 2 * bits)[0]
    all_v = total[at_v]
    p = np.where(all_v > 0, (np.maximum(c - high[np.minimum(c, 3)], 0) + held[at_v] * single[at_w]) / np.maximum(all_v, 1), single[at_w])
    log_p, base = np.log10(p), np.log10((n[at_w] + 1) / (t.tokens + t.words + 1))
    summed_up = lambda x: np.array([x[a:b].sum() for a, b in zip(starts, ends)])
    return {"n_tokens": ends - starts, "n_known": summed_up((n[at_w] > 0).astype(np.int64)), "base_score": summed_up(base), "score": summed_up(log_p)}


def perplexities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``n_tokens, n_known, train_tokens, base_score, score, perplexity``: one row per input row.

    * a null or empty text is its end alone, one token; equal texts have equal scores; repeated rows and null ids stay rows
    * a model without any text gives each token the probability 1, by both scores
    * words are told apart by 48 bits of a hash beside those of their shard, pairs by 64 bits; columns not named are not read
    * scores are rounded to six decimals; ``perplexity`` is ``10 ** (-score / n_tokens)``
    * memory follows a batch of some 2 MB of text, and the longest text
    """
    own = {id_col: F.col(id_col), **(keep or {})}
    read = docs.select(*(c.alias(f"_{k}") for k, c in enumerate(own.values())), utf8(F.col(text_col)).alias("_text"))
    kinds = [f.dataType.simpleString() for f in read.schema][:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 22):
            got = scored(batch.column("_text").to_pylist(), model)
            cols = [pa.array(got["n_tokens"]), pa.array(got["n_known"].astype(np.int64)), pa.array(np.full(batch.num_rows, model.totals.tokens)), *(pa.array(got[c].round(6)) for c in ("base_score", "score")), pa.array((10 ** (-got["score"] / got["n_tokens"])).round(6))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kinds))), *cols], names=[*batch.schema.names[:-1], *SCORES])

    out = read.mapInArrow(score, ", ".join([*(f"_{k} {x}" for k, x in enumerate(kinds)), *(f"{c} {'long' if k < 3 else 'double'}" for k, c in enumerate(SCORES))]))
    return out.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(own)), *SCORES)


SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 7, 2)
    return perplexities(docs, trained(docs.where(~held)), keep={"held_out": held})


ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {CRC32_SQL.format("doc_id::VARCHAR")} % 7 = 2 AS held_out, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS words FROM documents
), tokens AS (
  SELECT rid, held_out, unnest(list_prepend('  ', words)) AS v, unnest(list_append(words, ' ')) AS w FROM docs
), pairs AS (
  SELECT v, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY v, w
), words AS (
  SELECT w, sum(c)::BIGINT AS n, count(*) AS kinds FROM pairs GROUP BY w
), befores AS (
  SELECT v, sum(c)::BIGINT AS total, count(*) FILTER (c = 1) AS once, count(*) FILTER (c = 2) AS twice, count(*) FILTER (c > 2) AS often FROM pairs GROUP BY v
), counts AS (
  SELECT 'pair' AS kind, count(*)::DOUBLE AS n, count(*) FILTER (c = 1)::DOUBLE AS n1, count(*) FILTER (c = 2)::DOUBLE AS n2, count(*) FILTER (c = 3)::DOUBLE AS n3, count(*) FILTER (c = 4)::DOUBLE AS n4 FROM pairs
  UNION ALL SELECT 'word', count(*), count(*) FILTER (kinds = 1), count(*) FILTER (kinds = 2), count(*) FILTER (kinds = 3), count(*) FILTER (kinds = 4) FROM words
), discounts AS (
  SELECT kind, n, n1, n2,
    least(greatest(CASE WHEN n1 > 0 THEN 1 - 2 * (n1 / (n1 + 2 * n2)) * n2 / n1 ELSE 0.5 END, 0.1), 1) AS d1,
    least(greatest(CASE WHEN n2 > 0 THEN 2 - 3 * (CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0 END) * n3 / n2 ELSE 1.0 END, 0.2), 2) AS d2,
    least(greatest(CASE WHEN n3 > 0 THEN 3 - 4 * (CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0 END) * n4 / n3 ELSE 1.5 END, 0.3), 3) AS d3
  FROM counts
), sums AS (SELECT coalesce(sum(n), 0)::BIGINT AS tokens, count(*) AS vocabulary FROM words
), singles AS (
  SELECT s.tokens, s.vocabulary, l.d1, l.d2, l.d3, p.n AS pairs, p.d1 AS h1, p.d2 AS h2, p.d3 AS h3, l.d1 * l.n1 + l.d2 * l.n2 + l.d3 * (l.n - l.n1 - l.n2) AS left_over
  FROM sums s, discounts l, discounts p WHERE l.kind = 'word' AND p.kind = 'pair'
), priced AS (
  SELECT t.rid, coalesce(w.n, 0) AS n, coalesce(b.total, 0) AS total, coalesce(p.c, 0) AS c, s.*, h1 * once + h2 * twice + h3 * often AS held,
    CASE WHEN s.pairs = 0 THEN 1.0 ELSE (coalesce(greatest(w.kinds - CASE WHEN w.kinds = 1 THEN d1 WHEN w.kinds = 2 THEN d2 ELSE d3 END, 0), 0) + left_over / (vocabulary + 1)) / s.pairs END AS single
  FROM tokens t CROSS JOIN singles s LEFT JOIN words w ON w.w = t.w LEFT JOIN befores b ON b.v = t.v LEFT JOIN pairs p ON p.v = t.v AND p.w = t.w
), scored AS (
  SELECT rid, count(*) AS n_tokens, count(*) FILTER (n > 0) AS n_known, any_value(tokens) AS train_tokens, fsum(log10((n + 1) / (tokens + vocabulary + 1)::DOUBLE)) AS base_score,
    fsum(log10(CASE WHEN total > 0 THEN (greatest(c - CASE c WHEN 0 THEN 0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END, 0) + held * single) / total ELSE single END)) AS score
  FROM priced GROUP BY rid
)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score, round(pow(10, -score / n_tokens), 6) AS perplexity FROM docs JOIN scored USING (rid)
"""
