"""Words of texts and where they stand, in Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Of each byte: 0 part of a word, 1 white space, 2 white space that ends a line.
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]], KIND[[10, 11, 12, 13]] = 1, 2


#: Fixed value: bytes of texts that are looked at together; what that takes besides is some twenty times as much.
MOST = 1 << 21


def few(texts: pa.Array, most: int = MOST) -> Iterator[pa.Array]:
    """Slices of about ``most`` bytes, one text at least."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(ends.searchsorted((ends[start - 1] if start else 0) + most, "right")))
        yield texts.slice(start, end - start)
        start = end


def kinds(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``KIND`` of the bytes of texts that stand one behind the other; of a line end of several bytes the last one counts, the others are white space. ``ends``: where texts end."""
    kind = KIND[b]
    at = np.flatnonzero((b[:-1] == 13) & (b[1:] == 10))
    kind[at[~np.isin(at + 1, ends)]] = 1
    if b.size and b.max() > 127:
        at = np.flatnonzero((b[:-1] == 0xC2) & (b[1:] == 0x85))
        kind[at], kind[at + 1] = 1, 2
        at = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x80) & ((b[2:] == 0xA8) | (b[2:] == 0xA9)))
        kind[at], kind[at + 1], kind[at + 2] = 1, 1, 2
    return kind


def spelled(texts: pa.Array) -> pa.Array:
    """The words of each text: ``text``, ``at`` (its place in its line, in code points), ``n`` (its code points) and ``line_no``; null has none. All texts are looked at together."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    b = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    kind = kinds(b, off)
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = off[off < b.size]
    first[inner] = word[inner]  # a text's first byte begins a word of its own
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    page = np.searchsorted(off, starts, "right") - 1
    breaks = np.flatnonzero(kind == 2)
    before, before_page = np.searchsorted(breaks, starts), np.searchsorted(breaks, off)[page]
    line = off[page]
    own = before > before_page
    line[own] = breaks[before[own] - 1] + 1
    points = None
    if b.size and b.max() > 127:
        points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    at, n = (starts - line, ends - starts) if points is None else (points[starts] - points[line], points[ends] - points[starts])
    held = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(held), pa.py_buffer(b[word].tobytes()))
    whole = lambda v: pa.array(v.astype(np.int32))
    words = pa.StructArray.from_arrays([text, whole(at), whole(n), whole(before - before_page)], names=["text", "at", "n", "line_no"])
    return pa.ListArray.from_arrays(whole(np.searchsorted(starts, off)), words)


def spelled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of keys and, last, a text -> the keys of each word, its number in its text and what ``spelled`` tells of it, a few texts at a time."""
    for batch in batches:
        start = 0
        for texts in few(batch.column(batch.num_columns - 1)):
            found = spelled(texts)
            words, first = found.flatten(), found.offsets.to_numpy()
            of = np.repeat(np.arange(len(texts)), np.diff(first))
            keys = [c.slice(start, len(texts)).take(pa.array(of)) for c in batch.columns[:-1]]
            number = pa.array((np.arange(len(words)) - first[:-1][of]).astype(np.int32))
            start += len(texts)
            yield pa.RecordBatch.from_arrays([*keys, number, *words.flatten()], names=[*batch.schema.names[:-1], "word_no", *(f.name for f in words.type)])
