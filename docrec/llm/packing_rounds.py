"""Best-fit packing in bulk-synchronous rounds over Spark tables of runs.

Rounds go from long classes of lengths to short ones (each half as long as the one before). A round range-sorts the gaps and the
waiting pieces of a class by size, into ranges that are swept at once: every piece meets its successor, the tightest gap that is wide enough and that no
longer piece has claimed; conflicts are settled by rank. What finds no partner in its own range meets the rest of the other ranges in a second sweep.
Gaps are updated, and the next round begins. When no gap of the class is left, sequences are opened, as many as its pieces need
at least. Short pieces go into wide gaps as bundles of equal ones, so that rounds follow the logarithm of the capacity.

Pieces of one length are interchangeable and so are gaps of one size, so the tables hold runs: at most ``capacity`` lengths and
what the rounds split off, however many documents there are. An empty table gives no runs.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrec.llm.common import new_folder

#: Ranges of sizes that are swept apart, and the shortest class of lengths, as a part of the capacity.
PARTS, FINEST = 32, 32
#: Kinds of rows: ``n`` sequences from number ``first`` on with ``size`` tokens of room; ``n`` waiting pieces of ``size`` tokens with ranks from ``first``
#: on; pieces that went to sequences from ``seq`` on; and what a round leaves, by class: pieces, tokens, least and greatest size.
GAP, PIECE, PLACED, LEFT = range(4)
COLUMNS = "kind int, size long, first long, n long, seq long, each long, offset long"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
SCHEMA = pa.schema([(c, pa.int32() if c == "kind" else pa.int64()) for c in NAMES])


def matched(rows: list[tuple], capacity: int, low: int, top: int, least: int) -> list[tuple]:
    """One sweep from the widest to the narrowest: rows of gaps, of pieces and of what was placed, after it.

    Pieces of ``low < size <= top`` take part, as bundles of as many equal ones as a sequence holds, and gaps of ``least`` tokens or more. Going down, a gap opens a
    level and a bundle closes the last open one, which is the tightest gap that no longer bundle has claimed; bundles that find
    none come again at half the number. Runs open and close many levels at once, and a gap takes one bundle in a sweep.
    """
    out, taking, open_gaps = [], [], []
    for row in rows:
        kind, size, first, n = row[:4]
        if kind == GAP and size >= least:
            taking.append((-size, kind, first, size, n, 1))
        elif kind == PIECE and low < size <= top:
            each = min(n, capacity // size)
            taking.append((-size * each, kind, first, size, n, each))
        else:
            out.append(row)
    heapify(taking)
    while taking:
        _, kind, first, size, n, each = heappop(taking)
        if kind == GAP:
            open_gaps.append([size, first, n])
            continue
        bundles = n // each
        while bundles and open_gaps:
            gap = open_gaps[-1]
            taken = min(bundles, gap[2])
            gap[2] -= taken
            bundles, n = bundles - taken, n - taken * each
            seq, room = gap[1] + gap[2], gap[0] - size * each
            out.append((PLACED, size, first + n, taken * each, seq, each, capacity - gap[0]))
            if room:
                out.append((GAP, room, seq, taken, None, None, None))
            if not gap[2]:
                open_gaps.pop()
        if n and each > 1:
            each = min(n, each // 2)
            heappush(taking, (-size * each, kind, first, size, n, each))
        elif n:
            out.append((PIECE, size, first, n, None, None, None))
    return out + [(GAP, *gap, None, None, None) for gap in open_gaps]


def left(rows: list[tuple], tops: list[int]) -> list[tuple]:
    """What the rows leave: a row of kind LEFT for each class of waiting pieces, and one (class -1) for gaps."""
    own: dict[int, list[tuple]] = {}
    for kind, size, _, n, *_ in rows:
        if kind in (GAP, PIECE):
            own.setdefault(sum(size <= top for top in tops) - 1 if kind == PIECE else -1, []).append((size, n))
    return [(LEFT, k, sum(n for _, n in v), sum(size * n for size, n in v), min(v)[0], max(v)[0], None) for k, v in own.items()]


def swept(table: pa.Table, sweep: tuple, opened: list[tuple] = (), tops: list[int] = ()) -> pa.Table:
    """``matched`` over the rows of one range, or of all ranges with newly ``opened`` gaps; then with what is left."""
    rows = matched([*zip(*(table.column(c).to_pylist() for c in NAMES), strict=True), *opened], *sweep)
    rows += left(rows, tops) if tops else []
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(NAMES), SCHEMA.types, strict=True)], schema=SCHEMA)


class Rounds:
    """Best fit in rounds over a Spark table of runs.

    Every round is written to a folder of its own, so none is repeated when an executor is lost. The driver sees one row a class of lengths.
    """

    def __init__(self, counts: DataFrame, capacity: int):
        self.spark, self.capacity, self.path, self.done, self.opened = counts.sparkSession, capacity, new_folder(counts.sparkSession, "pack-rounds"), 0, 0
        self.tops = [capacity]
        while self.tops[-1] > max(1, capacity // FINEST):
            self.tops.append(self.tops[-1] // 2)
        self.new: list[tuple] = []
        nothing = [F.lit(None).cast("long").alias(c) for c in NAMES[4:]]
        self.state = counts.select(F.lit(PIECE).alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("count").alias("n"), *nothing)
        self.sweep(-1)

    def sweep(self, k: int) -> None:
        """One round for class ``k`` (-1: none, only count): ranges first, each for itself, then what they leave together."""
        low, top, least = (self.tops[k + 1] if k + 1 < len(self.tops) else 0, self.tops[k], self.waiting[k][2]) if k >= 0 else (0, 0, self.capacity + 1)
        how = (self.capacity, low, top, least)
        size, n = F.col("size"), F.col("n")
        wide = F.when(F.col("kind") == GAP, size).otherwise(size * F.least(n, F.floor(F.lit(self.capacity) / size)))
        ranges = self.state.groupBy(F.floor(wide * PARTS / self.capacity)).applyInArrow(lambda rows: swept(rows, how), COLUMNS) if k >= 0 else self.state
        opened, tops = self.new, self.tops
        rows = ranges.groupBy().applyInArrow(lambda rows: swept(rows, how, opened, tops), COLUMNS)
        path = f"{self.path}/round={self.done}"
        rows.write.parquet(path)
        written = self.spark.read.schema(COLUMNS).parquet(path)
        self.state = written.where(F.col("kind") < PLACED)
        seen = written.where(F.col("kind") == LEFT).collect()
        self.waiting = {r["size"]: (r["first"], r["n"], r["seq"]) for r in seen if r["size"] >= 0}
        self.widest = max((r["each"] for r in seen if r["size"] < 0), default=0)
        self.done, self.new = self.done + 1, []

    def open(self, k: int) -> None:
        """Open empty sequences for class ``k``: as many as its pieces need at least, by tokens and by number."""
        n, tokens, least = self.waiting[k]
        more = max(-(-tokens // self.capacity), -(-n // (self.capacity // least)))
        self.new = [(GAP, self.capacity, self.opened, more, None, None, None)]
        self.opened, self.widest = self.opened + more, self.capacity

    def run(self) -> DataFrame:
        """Rounds from the longest class to the shortest until nothing waits; the runs of kind PLACED of all rounds."""
        for k in range(len(self.tops)):
            while k in self.waiting:
                if self.widest < self.waiting[k][2]:
                    self.open(k)
                self.sweep(k)
        whole = self.spark.read.schema(COLUMNS).parquet(*(f"{self.path}/round={i}" for i in range(self.done)))
        return whole.where(F.col("kind") == PLACED).select("size", "first", "n", "seq", "each", "offset")
