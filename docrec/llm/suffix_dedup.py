"""Suffix-array deduplication: later copies of long byte strings are removed, the first copy stays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus (an earlier document, or the
same one further left), which is to say that its longest previous factor reaches ``length``.

1. Whole texts that equal an earlier document's text need no search; the first of each takes part.
2. Every string of ``length`` bytes has a least hash among its 32-byte grams. Neighbouring strings mostly share theirs, so
   a text falls into runs of strings with one hash. Equal strings have equal hashes: a hash that occurs in one run of the
   whole corpus is done with.
3. The runs that are left are cut from their texts and meet by hash. Their suffixes are sorted by prefix doubling up to
   ``length`` bytes, and the longest-previous-factor array follows from the previous and next smaller positions in that order.
4. Matches are united by document and the bytes left over are hashed.

Scale: texts are shuffled by document; grams are one row for about 35 bytes; only repeated passages travel as bytes. Runs are
counted by hash in units of ``UNIT`` bytes of text before they are sent: of a unit, one run of each hash goes to that
hash's task with the counts, the others stay spread out and are told only whether their hash is a hot one. Long texts are worked
on in windows. Equal pieces are united in each task before the shuffle. A hash with more than ``hot`` strings is split further:
its strings travel one by one, keyed by their own content, so a passage shared by a third of all documents costs one row
a task and the texts around it spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrec.llm.common import slices, stored, table, utf8
from docrec.llm.shingles import PLACES, mixed

LENGTH, GRAM = 100, 32
HOT = 1 << 18
SHARED_BYTES, CHUNK_BYTES = 1 << 26, 1 << 20
#: Bytes of text worked on at once, and of texts whose runs are counted together before they are sent.
WINDOW, UNIT = 1 << 18, 1 << 23


def words_at(buf: bytes | bytearray, order: str) -> np.ndarray:
    """The 8 bytes from each position as an unsigned number."""
    return np.ndarray((max(0, len(buf) - 7),), f"{order}u8", buf, strides=(1,)).astype(np.uint64)


def least_hashes(buf: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each string of ``length`` bytes the least hash of its grams."""
    v = words_at(buf, "<")
    m = len(buf) - GRAM + 1
    h = mixed(v[:m] * PLACES[0] + v[8 : 8 + m] * PLACES[1] + v[16 : 16 + m] * PLACES[2] + v[24 : 24 + m] * PLACES[3])
    least, width, want = h, 1, length - GRAM + 1
    while width < want:
        step = min(width, want - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    return h, least


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one least hash: ``hash, text number, start, strings, whether the hash occurs twice inside``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    off = np.cumsum(sizes) - sizes
    buf = b"".join(texts)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool))
    h, least = least_hashes(buf, length)
    first, last = off[long], off[long] + sizes[long] - length
    inside = np.zeros(len(least) + 1, np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    starts = np.concatenate(([True], least[1:] != least[:-1]))
    starts[first] = True
    at = np.flatnonzero(starts & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    text = np.searchsorted(first, at, "right") - 1
    ends = np.minimum(np.concatenate((at[1:], [len(buf)])), last[text] + 1)
    n = ends - at
    span = 2 * (length - GRAM) + 1
    twice = n > length - GRAM + 1
    short = np.flatnonzero(~twice)
    grams = at[short, None] + np.arange(span)
    own = (grams < (at + n)[short, None] + length - GRAM) & (h[np.minimum(grams, len(h) - 1)] == least[at[short], None])
    twice[short] = own.sum(axis=1) > 1
    return least[at], long[text], at - off[long[text]], n, twice


def ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks: the place of each key among the sorted distinct keys."""
    order = np.argsort(keys)
    s = keys[order]
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1]))).astype(np.uint64) if len(s) else s
    return rank


def smaller_before(p: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller number, -1 without one: steps back over ever smaller powers of two of larger numbers."""
    least, width = [p], 1  # least[k][i]: of the 2 ** k numbers that end at i
    while 2 * width <= len(p):
        own = least[-1].copy()
        own[width:] = np.minimum(own[width:], least[-1][:-width])
        least, width = [*least, own], 2 * width
    at = np.arange(len(p)) - 1
    for k in range(len(least) - 1, -1, -1):
        go = at + 1 >= 1 << k
        go[go] = least[k][at[go]] > p[go]
        at[go] -= 1 << k
    return at


def longest_previous(pieces: list[bytes], order: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The longest-previous-factor array of the pieces' strings of ``length`` bytes, up to ``length``, and each string's piece.

    ``order`` gives the pieces' places in the corpus. Suffixes are sorted to the depth ``length`` by prefix doubling, equal ones by
    position. The longest earlier match of a suffix is its common prefix with the previous or the next suffix of smaller
    position in that order. Of equal ones, all but the first have the one before as the previous; so these two are looked up among
    the first ones only. Common prefixes are read off the ranks that the doubling left at each width.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    off, n = np.cumsum(sizes) - sizes, sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), n)
    if not len(piece):
        return np.zeros(0, np.int64), piece
    within = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    start = off[piece] + within
    text = b"".join(pieces)
    ranks = {8: ranked(words_at(text, ">"))}
    width = 8
    while 2 * width <= length:
        ranks[2 * width] = ranked(ranks[width][:-width] << np.uint64(32) | ranks[width][width:])
        width *= 2
    whole = ranked(ranks[width][start] << np.uint64(32) | ranks[width][start + length - width])

    place = np.lexsort((within, order[piece]))  # corpus order of the strings
    position = np.empty(len(place), np.int64)
    position[place] = np.arange(len(place))
    suffixes = np.lexsort((position, whole))
    first = np.flatnonzero(np.concatenate(([True], whole[suffixes][1:] != whole[suffixes][:-1])))
    p, at = position[suffixes[first]], start[suffixes[first]]
    letters = np.frombuffer(text, np.uint8)

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for w in sorted(ranks, reverse=True):
            on = np.flatnonzero(out + w <= length)
            out[on[ranks[w][i[on] + out[on]] == ranks[w][j[on] + out[on]]]] += w
        for _ in range(7):
            on = np.flatnonzero(out < length)
            on = on[letters[i[on] + out[on]] == letters[j[on] + out[on]]]
            if not len(on):
                break
            out[on] += 1
        return out

    best = np.zeros(len(first), np.int64)
    for near in (smaller_before(p), len(p) - 1 - smaller_before(p[::-1])[::-1]):
        has = np.flatnonzero((near >= 0) & (near < len(p)))
        best[has] = np.maximum(best[has], common(at[has], at[near[has]]))
    factor = np.full(len(piece), length, np.int64)
    factor[suffixes[first]] = best
    return factor, piece


def stretches(hit: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of hits within a piece."""
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], piece[1:] != piece[:-1]))
    first = hit & (new | np.concatenate(([True], ~hit[:-1])))
    last = hit & np.concatenate((new[1:] | ~hit[1:], [True]))
    return np.flatnonzero(first), np.flatnonzero(last)


def repeated_parts(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``ord, text`` -> ``ord, first, last``: stretches of start positions whose strings of ``length`` bytes also start earlier (smaller ``ord``, or further left)."""

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def unit() -> pa.RecordBatch:
            h, ord_, start, n, twice = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool))
            held.clear()
            by = np.argsort(h, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], h[by][1:] != h[by][:-1]))) if len(h) else np.zeros(0, np.int64)
            runs_, strings, inside = (np.add.reduceat(x[by], new) if len(h) else x for x in (np.ones(len(h), np.int64), n, twice.astype(np.int64)))
            count, total = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            count[by[new]], total[by[new]] = runs_ + (inside > 0), strings  # one that repeats inside counts as a second run
            here = mixed(h * PLACES[4] + np.array([ord_[0] if len(h) else 0]).astype(np.uint64) * PLACES[5])  # the hash, in this unit
            speaks = count > 0
            run = np.stack((np.where(speaks, here, h).view(np.int64), ord_, start << 32 | n, count << 32 | total), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.where(speaks, h, here).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * 4), pa.array(run.ravel()))], names=["key", "run"])

        for batch in slices(batches, "text", WINDOW):
            texts_, ords = batch.column("text").to_pylist(), batch.column("ord").to_numpy()
            parts = [(r, at) for r, t in enumerate(texts_) for at in range(0, max(1, len(t) - length + 1), WINDOW)]
            for own in [parts] if len(parts) == len(texts_) else [[x] for x in parts]:  # a long text's windows one by one
                h, part, start, n, twice = runs([texts_[r][at : at + WINDOW + length - 1] for r, at in own], length)
                row, shift = np.array(own, np.int64).reshape(-1, 2)[part].T
                held.append((h, ords[row], start + shift, n, twice))
            size += sum(map(len, texts_))
            if size > UNIT:
                yield unit()
                size = 0
        yield unit()

    # Rows of a partition come in the order of ``ord``, so that a task that is run again makes the same units. The rows are dealt once
    # for all three readers: packed in one column (the hash, or the hash in this unit; ord; start and strings; runs and strings of the
    # unit, 0 for silent rows), and told apart by a test that is not moved before the shuffle.
    found = texts.sortWithinPartitions("ord").mapInArrow(find_runs, "key long, run array<long>").repartition("key")
    other, ord_, span, tally = (F.get("run", F.lit(k)) for k in range(4))
    low = lambda c: c.bitwiseAND(F.lit((1 << 32) - 1))
    spoken = F.when(F.monotonically_increasing_id() >= 0, tally)
    speakers = found.where(spoken > 0)
    many = speakers.groupBy("key").agg(F.sum(F.shiftright(tally, 32)).alias("df"), (F.sum(low(tally)) > hot).alias("hot")).where("df > 1")
    told = speakers.join(many.hint("shuffle_hash"), "key")
    silent = found.where(spoken == 0).join(told.where("hot").select(other.alias("key"), "hot"), "key", "left")

    def runs_of(rows: DataFrame, h: Column) -> DataFrame:
        run = F.struct(F.shiftright(span, 32).cast("int").alias("start"), low(span).cast("int").alias("n"), h.alias("h"), F.coalesce("hot", F.lit(False)).alias("hot"))
        return rows.select(ord_.alias("ord"), run.alias("run"))

    again = runs_of(told, F.col("key")).unionByName(runs_of(silent, other))
    by_text = again.groupBy("ord").agg(F.collect_list("run").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ord", "start", "last", "piece"]
        held: dict[bytes, tuple[int, int, int]] = {}
        size = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=names)

        def drain() -> pa.RecordBatch:
            rows = [(key, ord_, start, None, piece) for piece, (ord_, start, key) in held.items()]
            held.clear()
            return out(rows)

        for batch in slices(batches, "text"):
            done = []
            runs_ = batch.column("runs")
            lists, flat = runs_.offsets.to_numpy(), runs_.values
            starts, ns, hs, hots = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("start", "n", "h", "hot"))
            for r, (ord_, text) in enumerate(zip(batch.column("ord").to_pylist(), batch.column("text").to_pylist())):
                for k in range(lists[r], lists[r + 1]):
                    step = 1 if hots[k] else ns[k]
                    for start in range(starts[k], starts[k] + ns[k], step):
                        piece = text[start : start + step + length - 1]
                        own = (ord_, start, xxhash.xxh3_64_intdigest(piece) - (1 << 63) if hots[k] else hs[k])
                        old = held.get(piece)
                        if old is None:
                            held[piece] = own
                            size += len(piece)
                        else:  # equal pieces: the earlier stays, the later is found
                            held[piece], later = (old, own) if old < own else (own, old)
                            if done and done[-1][1] == later[0] and done[-1][3] + 1 == later[1]:
                                done[-1] = (*done[-1][:3], later[1] + step - 1, None)
                            else:
                                done.append((later[0] ^ later[1], later[0], later[1], later[1] + step - 1, None))
                        if size > SHARED_BYTES or len(done) > 1 << 16:
                            yield out(done)
                            done = []
                            if size > SHARED_BYTES:
                                yield drain()
                                size = 0
            yield out(done)
        yield drain()

    texts_of = by_text.join(texts, "ord").select("ord", "text", "runs")
    pieces = texts_of.mapInArrow(cut, "key long, ord long, start int, last int, piece binary").repartition("key").sortWithinPartitions("key", "ord", "start")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ord", "first", "last"]

        def flush(keys, ords, starts, bodies) -> pa.RecordBatch:
            ords, starts = np.array(ords, np.int64), np.array(starts, np.int64)
            place = np.empty(len(ords), np.int64)
            place[np.lexsort((starts, ords))] = np.arange(len(ords))
            seen: dict[bytes, int] = {}
            own = np.array([seen.setdefault(b, i) for i, b in enumerate(bodies)], np.int64)  # rows come in corpus order
            copies = np.flatnonzero(own != np.arange(len(own)))
            distinct = np.flatnonzero(own == np.arange(len(own)))
            factor, piece = longest_previous([bodies[i] for i in distinct], place[distinct], length)
            a, b = stretches(factor >= length, piece)
            lens = np.array([len(bodies[i]) - length + 1 for i in distinct], np.int64)
            base = np.cumsum(lens) - lens
            at = distinct[piece[a]] if len(a) else np.zeros(0, np.int64)
            shift = starts[at] - base[piece[a]] if len(a) else np.zeros(0, np.int64)
            n = np.array([len(bodies[i]) - length for i in copies], np.int64)
            cols = [np.concatenate((ords[copies], ords[at])), np.concatenate((starts[copies], a + shift)), np.concatenate((starts[copies] + n, b + shift))]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=names)

        rows: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            known = batch.filter(batch.column("piece").is_null())
            yield pa.RecordBatch.from_arrays([known.column("ord"), known.column("start").cast(pa.int64()), known.column("last").cast(pa.int64())], names=names)
            open_ = batch.filter(batch.column("piece").is_valid())
            for row in zip(*(open_.column(c).to_pylist() for c in ("key", "ord", "start", "piece"))):
                if size > CHUNK_BYTES and row[0] != rows[0][-1]:
                    yield flush(*rows)
                    rows, size = ([], [], [], []), 0
                for column, x in zip(rows, row):
                    column.append(x)
                size += len(row[3])
        if rows[0]:
            yield flush(*rows)

    return pieces.mapInArrow(match, "ord long, first long, last long")


def kept_bytes(text: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed spans, from stretches of start positions, and the bytes that stay."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), (last + length).tolist())):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    at, left = 0, []
    for a, b in spans:
        left.append(text[at:a])
        at = b
    return spans, b"".join([*left, text[at:]])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts earlier.

    Returns one row per input row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (the bytes
    that stay, concatenated) and ``spans`` (removed, as byte offsets).

    * documents come in the order of their ids; a null id comes last; rows that repeat an id come in the order of the input
    * a null text counts as empty; nothing is removed from texts shorter than ``length``
    * an empty table gives an empty result; columns other than id and text are not read
    """
    body = utf8(F.col(text_col))
    narrow = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(body, 256)).alias("sha"), F.octet_length(body).cast("long").alias("n"), F.monotonically_increasing_id().alias("rid"))
    rows = stored(narrow, "suffix-rows")
    order = F.struct(F.col("id").isNull().alias("z"), "id", "rid")
    leads = stored(rows.where(F.col("n") >= length).groupBy("sha").agg(F.min(order).alias("lead")).select("sha", "lead.id", "lead.rid"), "suffix-leads")
    texts = docs.select(F.col(id_col).alias("id"), body.alias("text"))
    plain = docs.schema[id_col].dataType.simpleString() in ("bigint", "int") and leads.groupBy("id").count().where("count > 1 or id is null").isEmpty()
    if plain:  # ids are the order
        numbered = leads.select(F.col("id").cast("long").alias("ord"), "rid")
        texts = texts.select(F.col("id").cast("long").alias("ord"), "text")
        own = rows.groupBy("id").count().where("count > 1").select(F.col("id").cast("long").alias("ord"))
        if not own.isEmpty():
            plain = False
            texts = docs.select(F.col(id_col).alias("id"), body.alias("text"))
    if not plain:  # number the first copies in the order of ids
        sorted_ = leads.select("*", F.col("id").isNull().alias("z")).repartitionByRange("z", "id", "rid").sortWithinPartitions("z", "id", "rid")
        numbered = stored(sorted_.select(F.monotonically_increasing_id().alias("ord"), "id", "sha", "rid"), "suffix-order")
        keyed = texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
        same = keyed["id"].eqNullSafe(numbered["id"]) & (keyed["sha"] == numbered["sha"])
        texts = stored(keyed.join(numbered, same).select("ord", "text").dropDuplicates(["ord"]), "suffix-texts")
        numbered = numbered.select("ord", "rid")
    first_copies = texts.join(numbered.select("ord").hint("shuffle_hash"), "ord", "left_semi")
    parts = repeated_parts(first_copies, length, hot).groupBy("ord").agg(F.collect_list(F.struct("first", "last")).alias("parts"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows_ = []
            parts_ = batch.column("parts")
            lists, flat = parts_.offsets.to_numpy(), parts_.values
            first, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            for r, text in enumerate(batch.column("text").to_pylist()):
                spans, left = kept_bytes(text, first[lists[r] : lists[r + 1]], last[lists[r] : lists[r + 1]], length)
                rows_.append((len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if with_text else None, [{"start": a, "stop": b} for a, b in spans] if with_text else None))
            cols = list(zip(*rows_)) if rows_ else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("ord"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["ord", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    removed = first_copies.join(parts, "ord").select("ord", "text", "parts").mapInArrow(remove, "ord long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,stop:long>>")
    removed = stored(removed if with_text else removed.drop("kept", "spans"), "suffix-removed")

    lead = numbered.join(removed, "ord", "left")
    out = rows.join(lead, "rid", "left")
    copy = F.col("ord").isNull() & (F.col("n") >= length)
    sha = F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha"))))
    cols = [F.col("id").alias(id_col), F.col("n").alias("n_bytes"), F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed")]
    cols += [F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), sha.alias("kept_sha256")]
    if not with_text:
        return out.select(*cols)
    bodies = docs.select(F.unhex(F.sha2(body, 256)).alias("sha2"), body.alias("whole")).dropDuplicates(["sha2"])
    out = out.join(bodies, out["sha"] == bodies["sha2"])
    kept = F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", "whole"))
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))
    return out.select(*cols, kept.alias("kept"), F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"))


def query(spark, sf_dir):
    return deduplicated(table(spark, sf_dir, "documents"))
