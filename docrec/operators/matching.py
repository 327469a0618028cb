"""Many patterns in many texts: one automaton for all patterns, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 1 << 24
ROWS = 64  # texts that are Python strings at once
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def automaton(patterns: list[tuple[str, bool]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for text, whole in patterns:
        held = out.get(text, ())
        out.add_word(text, (*held, (text, whole)))
    if len(out):
        out.make_automaton()
    return out


def matches(text: str, machine: ahocorasick.Automaton) -> list[str]:
    """The distinct patterns in a text, in the order in which they first end; one that has to be a whole word stands between characters that are none of A-Z, 0-9 and underscore."""
    seen: dict[str, None] = {}
    for end, found in machine.iter(text):
        for p, whole in found:
            if p not in seen:
                before, after = text[end - len(p) : end - len(p) + 1] if end >= len(p) else "", text[end + 1 : end + 2]
                if not whole or not (before in WORD or after in WORD):
                    seen[p] = None
    return list(seen)


def found_patterns(texts: DataFrame, patterns: DataFrame, text_col: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``texts`` without ``text_col`` and with ``pattern``: a row for each distinct pattern of ``patterns (pattern, whole)`` that is in a text.

    The patterns go to the tasks as an automaton, of at most about ``most_bytes`` bytes of them: more are taken in as many
    passes over the texts as they need, so none is left out. Whatever their number, a pass looks at each character once.
    A null text has no pattern, an empty pattern is in none; texts stay rows of their own.
    """
    some = patterns.where("pattern <> ''").select("pattern", "whole").distinct()
    size = some.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    passes = -(-size // most_bytes)
    own = [c for c in texts.columns if c != text_col]
    schema = ", ".join([f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in own] + ["pattern string"])
    out = None
    for k in range(passes):
        held = [(r["pattern"], r["whole"]) for r in (some if passes == 1 else some.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k)).collect()]
        sent = texts.sparkSession.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = automaton(sent.value)
            for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
                at, hit = [], []
                for i, t in enumerate(batch.column(len(own)).to_pylist()):
                    found = matches(t, machine) if t and len(machine) else []
                    at += [i] * len(found)
                    hit += found
                if at:
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(len(own))), pa.array(hit)], names=[*own, "pattern"])

        found = texts.select(*own, text_col).mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.select(*own, F.lit("").alias("pattern")).limit(0)
