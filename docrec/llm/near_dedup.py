"""Near-duplicate detection with bottom-k sketches from one hash function.

1. Every whole text becomes the set of its hashed word shingles; the ``k`` smallest are its sketch. Rows with equal sets
   are one class from here on.
2. Inverted lists of sketch values. Sketches of a pair that reaches the similarity agree on at least ``agree`` of ``k``
   values (the odds against are under 1e-5 at the very threshold and vanish above it), so such a pair also shares one of
   each side's ``k - agree + 1`` rarest values: only those are listed. A passage that many documents share is common, so it
   is in no list of a document that has enough text of its own, and documents without company leave here.
3. Full sets of the documents that are left. A shingle that no other set has can be part of no overlap: documents with
   too many of them leave, and the same count bounds what any pair can reach.
4. Each list is led by its document with the smallest share of such shingles. Whoever shares a list shares its leader,
   so the pairs to decide are those inside the leaders' groups. Of a pair, the union sketch is estimated first: of the ``k``
   smallest values of both sketches together, ``agree`` must be in both, the same condition as in step 2. What passes is
   verified by the exact Jaccard similarity of the full sets. Large groups are worked off by ``star_links``.
   A task sends out at most one link for each of its members, never its pairs.
5. Connected components of the links.

Scale: the sketches of all documents and the sets of the candidates are shuffled, the rest is numbers. Lists of any
length cost rows in proportion to their length. Hot values and hot classes meet only in joins that adaptive execution
can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrec.llm.common import slices, stored, table, utf8
from docrec.llm.components import components
from docrec.llm.shingles import shingle_set

K, AGREE = 32, 14
ODDS = 2e-6
BLOCK = 128
TOP = np.uint64(1 << 63)


def shingled(docs: DataFrame, id_col: str, text_col: str, words: int, keep: int | None) -> DataFrame:
    """``id, key, n, hashes``: the digest and size of each text's set, and its ``keep`` smallest hashes (all: None)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            some = [(s[:keep] ^ TOP).view(np.int64) for s in sets]  # in the order of signed numbers
            ends = np.concatenate(([0], np.cumsum([len(s) for s in some], dtype=np.int64))).astype(np.int32)
            flat = pa.array(np.concatenate(some) if some else np.zeros(0, np.int64))
            key = pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), key, pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "key", "n", "hashes"])

    read = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text"))
    return read.mapInArrow(shingle, f"id {kind}, key binary, n long, hashes array<long>")


class Sets:
    """The shingle sets of a task's group: columns ``sid, n, u, hashes``, hashes sorted."""

    def __init__(self, group: pa.Table, k: int):
        self.sid, self.n, self.u = (group.column(c).to_numpy() for c in ("sid", "n", "u"))
        sets = group.column("hashes").combine_chunks()
        self.starts, values = sets.offsets.to_numpy()[:-1] - sets.offsets[0].as_py(), sets.flatten().to_numpy()
        self.ids = np.unique(values, return_inverse=True)[1]
        self.flag = np.zeros(int(self.ids.max(initial=-1)) + 1, np.int64)
        self.k, self.kept = k, np.minimum(self.n, k)
        self.valid = np.arange(k) < self.kept[:, None]
        self.sketch = np.zeros(self.valid.shape, np.int64)
        self.sketch[self.valid] = values[(self.starts[:, None] + np.arange(k))[self.valid]]

    def estimated(self, i: int, least: int, share: float) -> np.ndarray:
        """Whom set ``i`` may be similar to: of the ``k`` smallest hashes of the two sketches' union at least ``least`` are in both; ``share`` of them if the union has fewer, which then is the whole one."""
        if not least:
            return np.ones(len(self.sid), bool)
        own = self.sketch[i, : self.kept[i]]
        place = np.searchsorted(own, self.sketch)
        both = self.valid & (own[np.minimum(place, len(own) - 1)] == self.sketch)
        rank = np.arange(self.k) + place - (np.cumsum(both, axis=1) - both)  # how many hashes of the union are smaller
        union = self.kept[i] + self.kept - both.sum(axis=1)
        return (both & (rank < self.k)).sum(axis=1) >= np.where(union < self.k, np.ceil(share * union - 1e-9), least)

    def shared(self, i: int, which: np.ndarray) -> np.ndarray:
        """Exact overlaps of set ``i`` with those at the places ``which``."""
        own = self.ids[self.starts[i] : self.starts[i] + self.n[i]]
        self.flag[own] = 1
        out = np.array([self.flag[self.ids[s : s + m]].sum() for s, m in zip(self.starts[which], self.n[which])], np.int64)
        self.flag[own] = 0
        return out


def links_within(group: pa.Table, k: int, agree: int, num: int, den: int) -> pa.Table:
    """Links of each ``probe`` with all others, ``a`` hanging on ``b``: enough of them to connect what is linked. Where the leader is in the group, those who hang on it need no comparison with each other."""
    s = Sets(group, k)
    root = np.arange(len(s.sid))
    free = s.n - s.u  # hashes that no other set has are in no overlap

    def linked(i: int) -> np.ndarray:
        most = np.minimum(free, free[i])
        which = np.flatnonzero((den * most >= num * (s.n + s.n[i] - most)) & s.estimated(i, agree, num / den))
        both = s.shared(i, which[which != i])
        which = which[which != i]
        return which[den * both >= num * (s.n[which] + s.n[i] - both)]

    lead = np.flatnonzero(s.sid == group.column("leader")[0].as_py())
    for i in lead[:1]:
        root[linked(i)] = i
    hung = root != np.arange(len(root))
    for i in np.flatnonzero(group.column("probe").to_numpy(zero_copy_only=False) & ~hung):
        if i not in lead:
            for r in np.unique(root[linked(i)]):
                root[root == r] = root[i]
    hung = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": s.sid[hung], "b": s.sid[root[hung]]})


def against_leader(group: pa.Table, k: int, least: int, num: int, den: int) -> pa.Table:
    """``leader, sid, linked, similarity`` of the group's sets and its leader; the similarity is 0 where the sketches say that it is too small to matter."""
    s = Sets(group, k)
    leader = group.column("leader")[0].as_py()
    lead = int(np.flatnonzero(s.sid == leader)[0])
    which = np.flatnonzero(s.estimated(lead, least, 2 * num / den - 1))
    both = s.shared(lead, which)
    similar, linked = np.zeros(len(s.sid)), np.zeros(len(s.sid), bool)
    union = s.n[which] + s.n[lead] - both
    similar[which], linked[which] = both / union, den * both >= num * union
    out = pa.table({"leader": pa.array(np.full(len(s.sid), leader)), "sid": s.sid, "linked": linked, "similarity": similar})
    return out.filter(pa.array(s.sid != leader))


def least_agreeing(k: int, similarity: float, odds: float) -> int:
    """The largest count that sketches of ``k`` values of a pair of this similarity stay below with odds of at most ``odds``."""
    below = 0.0
    for count in range(k + 1):
        below += comb(k, count) * similarity**count * (1 - similarity) ** (k - count)
        if below > odds:
            return count
    return k


def star_links(stars: DataFrame, sizes: DataFrame, sets: DataFrame, k: int, agree: int, num: int, den: int, block: int) -> DataFrame:
    """``a, b``: links inside the leaders' groups (``leader, sid``), each group with its leader among its rows.

    A group of at most ``block`` sets meets in one task. A larger one meets its leader first, in parts, each with a copy of the
    leader's set. Those who are linked with it are connected and need not meet each other. By the triangle inequality of the Jaccard
    distance they can be linked only with sets in a band of similarities to the leader below the threshold, so only those
    near the band go on; the sets that the leader is not linked with meet each other and these, a pair of parts a task.
    """
    counts = stored(stars.groupBy("leader").agg(F.count("*").alias("n_star")), "near-star-sizes")  # so that a hot leader's join can be split
    stars = stars.join(counts, "leader")
    with_sets = lambda df: df.join(sizes.select("sid", "u"), "sid").join(sets.select("sid", "n", "hashes"), "sid")
    within = lambda df, *keys: with_sets(df).groupBy(*keys).applyInArrow(lambda group: links_within(group, k, agree, num, den), "a long, b long")
    links = within(stars.where(F.col("n_star") <= block).select("leader", "sid", F.lit(True).alias("probe")), "leader")
    large = stars.where(F.col("n_star") > block).withColumn("parts", F.ceil(F.col("n_star") / block).cast("int"))
    if counts.where(F.col("n_star") > block).isEmpty():
        return links

    own_part = F.array(F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    part = F.explode(F.when(F.col("sid") == F.col("leader"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own_part)).alias("part")
    least = least_agreeing(k, max(2 * num / den - 1, 0.0), ODDS)
    judged = with_sets(large.select("leader", "sid", part)).groupBy("leader", "part")
    judged = stored(judged.applyInArrow(lambda group: against_leader(group, k, least, num, den), "leader long, sid long, linked boolean, similarity double"), "near-judged")

    reach = 1 - num / den + 1e-9
    apart = judged.where("NOT linked")
    band = apart.where(F.col("similarity") >= num / den - reach).groupBy("leader").agg(F.max("similarity").alias("top"))
    beside = judged.where("linked").join(stored(band, "near-band"), "leader").where(F.col("similarity") <= F.col("top") + reach)
    rest = stored(apart.select("leader", "sid", F.lit(True).alias("probe")).unionByName(beside.select("leader", "sid", F.lit(False).alias("probe"))), "near-rest")
    parts = lambda flag: F.ceil(F.count_if(F.col("probe") == flag) / block).cast("int")
    dealt = rest.join(stored(rest.groupBy("leader").agg(parts(True).alias("probes"), parts(False).alias("others")).where("probes > 0"), "near-parts"), "leader")
    at = F.pmod(F.xxhash64("sid"), F.when(F.col("probe"), F.col("probes")).otherwise(F.col("others"))).cast("int").alias("at")
    dealt = dealt.select("leader", "sid", "probe", "probes", "others", at)
    upto = lambda c: F.slice(F.sequence(F.lit(0), F.col(c)), F.lit(1), F.col(c))
    meet = lambda i, j, beside_, probe: F.struct(i.alias("i"), j.alias("j"), F.lit(beside_).alias("beside"), probe.alias("probe"))
    among = F.transform(upto("probes"), lambda t: meet(F.least(t, "at"), F.greatest(t, "at"), False, F.col("at") <= t))
    aside = F.transform(upto("others"), lambda t: meet(F.col("at"), t, True, F.lit(True)))
    back = F.transform(upto("probes"), lambda t: meet(t, F.col("at"), True, F.lit(False)))
    met = dealt.select("leader", "sid", F.explode(F.when(F.col("probe"), F.concat(among, aside)).otherwise(back)).alias("m")).select("leader", "sid", "m.*")
    return links.unionByName(judged.where("linked").select(F.col("sid").alias("a"), F.col("leader").alias("b"))).unionByName(within(met, "leader", "i", "j", "beside"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, k: int = K, agree: int = AGREE, block: int = BLOCK) -> DataFrame:
    """Link documents whose shingle sets have ``den * intersection >= num * union`` and find the linked groups.

    Returns one row per input row: ``id_col, n_shingles, component_id, kept``. ``component_id`` is the smallest id that can be
    reached over links, the row's own included; ``kept`` is whether that is the row's own.

    * a null or empty text, or one without words, has an empty set and no links
    * rows with equal sets are linked; a null id counts as larger than any other
    * rows that repeat an id are rows of their own, and all of them are kept if that id is their group's smallest
    * an empty table gives an empty result; columns other than id and text are not read
    * ``agree`` 0 leaves nothing to odds: the lists are those of all values of whole sets, as many of each set's rarest as any partner must share one of, and no estimate is asked; it costs a row for about each fifth shingle
    """
    exact = not agree
    k = 1 if exact else k
    sketch = shingled(docs, id_col, text_col, words, None if exact else k)
    rows = stored(sketch.withColumn("rid", F.monotonically_increasing_id()), "near-rows")
    classes = stored(rows.where("n > 0").groupBy("key").agg(F.min("rid").alias("first"), F.min("id").alias("least_id")), "near-classes")
    own = rows.join(classes.select(F.col("first").alias("rid")), "rid", "left_semi")

    values = own.select("key", "n", F.explode("hashes").alias("v"))
    counts = stored(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "near-counts")  # so that a hot value's join can be split
    company = values.join(counts, "v").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))
    listed = F.when(F.lit(exact) | (F.col("n") < k), F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")).otherwise(k - agree + 1) - (F.when(F.lit(exact), F.col("n")).otherwise(F.least("n", F.lit(k))) - F.size("shared"))
    rare = company.withColumn("listed", listed.cast("int")).where("listed > 0").select("key", F.explode(F.slice("shared", 1, F.col("listed"))).alias("s"))
    rare = stored(rare.select("key", F.col("s.v").alias("v")), "near-lists")
    lists = rare.join(rare.groupBy("v").count().where("count > 1").select("v"), "v", "left_semi")

    wanted = stored(own.join(lists.select("key").distinct(), "key", "left_semi").select(F.col("id").alias("_id")).distinct(), "near-wanted")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(wanted.hint("shuffle_hash"), texts["id"].eqNullSafe(wanted["_id"]), "left_semi")
    full = shingled(texts, "id", "text", words, None).groupBy("key").agg(F.any_value("n").alias("n"), F.any_value("hashes").alias("hashes"))
    sets = stored(full.withColumn("sid", F.monotonically_increasing_id()), "near-sets")

    alone = sets.select("sid", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("df"), F.min("sid").alias("sid"))
    alone = alone.where("df = 1").groupBy("sid").agg(F.count("*").alias("u"))
    sizes = stored(sets.select("key", "sid", "n").join(alone, "sid", "left").fillna(0, ["u"]).where((F.col("n") - F.col("u")) * den >= F.col("n") * num), "near-sizes")
    members = stored(lists.join(sizes, "key").select("v", "sid", "n", "u"), "near-members")
    leaders = members.groupBy("v").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "sid"))["sid"].alias("leader"))
    leaders = stored(leaders, "near-leaders")  # so that a hot value's join can be split
    stars = stored(members.join(leaders, "v").select("leader", "sid").distinct(), "near-stars")

    links = star_links(stars, sizes, sets, k, agree, num, den, block)
    labels = components(links)
    ids = sets.select(F.col("sid").alias("node"), "key").join(labels, "node").join(classes.select("key", "least_id"), "key").select("key", "label", "least_id")
    ids = stored(ids, "near-labels")
    least = ids.groupBy("label").agg(F.min("least_id").alias("group_id"))
    found = stored(classes.select("key", "least_id").join(ids.select("key", "label"), "key", "left").join(least, "label", "left").select("key", F.coalesce("group_id", "least_id").alias("group_id")), "near-groups")
    out = rows.select("id", "n", "key").join(found, "key", "left")
    component = F.when(F.col("n") > 0, F.col("group_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def distinct_enough(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, one of each group, with all their columns."""
    kept = stored(near_groups(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("_id")).distinct(), "near-kept")
    return docs.join(kept.hint("shuffle_hash"), docs[id_col].eqNullSafe(kept["_id"]), "left_semi")


def query(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), words=4)


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM t
), p AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS v FROM s
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM p a JOIN p b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM o WHERE 100 * c >= 80 * (na + nb - c)
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a
), m AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id
"""
