"""Repair of conversation structure: the cheapest edits that make turns alternate, by Viterbi decoding with survivor coalescence.

Spark damages (for the registered query), orders and marks the turns; a conversation is then read once, in order, by one
task. The decoder keeps a survivor for each of four states (nothing kept, after a system turn, after a user's, after an
assistant's). Survivors share a tree of back pointers with counts of references: a survivor that is beaten gives back the
branch that only it used, and once all survivors descend from one node the edits up to that node are decided and leave
the tree. Each survivor carries the running digest of its repaired text, so no turn is held, however late it is decided.

Equal costs are told apart by whole edit strings. Strings of two survivors have one letter for each turn read and end
with such a letter, so none is a prefix of another and their order never changes by what follows: each step keeps the
order of the survivors as their ranks, and a tie is decided by rank first and by the new letters within one rank.

What a task holds: an edit a turn that is not decided, in blocks of letters, and the edits of the conversation that it is
reading, which are a value of the result. The digest of a conversation is sequential, so one conversation is one task's
stream; it is sorted by Spark, which spills, and never gathered.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docrec.llm.common import CRC32_SQL, slices, table

BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: Which initial comes next after each state; ``0`` is the start, where a system turn may come too.
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NONE, BLANK, DUPLICATE, CUT = range(4)
BLOCK = 4096
#: Edits that complete a conversation in each state.
CLOSING = {"0": "", "s": "II", "u": "I", "a": ""}


@lru_cache(maxsize=64)
def moves(initial: str, fault: int) -> tuple[tuple[str, str, str, int], ...]:
    """All ways to take a turn: state before, edits, state after, cost. Two insertions are of use at the start only; later they lead back to their state."""
    out = []
    for state in NEXT:
        at, letters, cost = state, "", 0
        for _ in range(3 if state in "0s" else 2):
            out.append((state, letters + "D", at, cost + DELETE))
            if fault not in (BLANK, DUPLICATE):
                more = cost + (TRUNCATED if fault == CUT else 0)
                if initial == NEXT[at] or (initial == "s" and at == "0"):
                    out.append((state, letters + "K", initial, more))
                out.append((state, letters + "R", NEXT[at], more + REROLE))
            at, letters, cost = NEXT[at], letters + "I", cost + INSERT
    return tuple(out)


class Node:
    """Some edits in a row, below those of ``parent``; ``refs`` survivors and nodes hold it."""

    __slots__ = ("letters", "parent", "refs")

    def __init__(self, letters: str, parent: Node | None):
        self.letters, self.parent, self.refs = letters, parent, 1
        if parent is not None:
            parent.refs += 1


class Survivor:
    __slots__ = ("cost", "node", "digest", "some")

    def __init__(self, cost: int, node: Node, digest, some: bool):
        self.cost, self.node, self.digest, self.some = cost, node, digest, some


class Repair:
    """The cheapest edits of one conversation, of which the turns come one by one."""

    def __init__(self):
        self.root = Node("", None)
        self.alive = {"0": Survivor(0, self.root, hashlib.sha256(), False)}  # by state, in the order of their edit strings
        self.decided: list[str] = []
        self.made, self.left = 0, 0  # nodes since the last look for a common ancestor, and nodes it left

    def turn(self, role: str, text: str, fault: int) -> None:
        best: dict[str, tuple[int, int, str, str]] = {}
        ranks = {state: k for k, state in enumerate(self.alive)}
        for state, letters, to, cost in moves(role[:1] if role[:1] in ("s", "u", "a") else "", fault):
            if state in ranks:
                found = (self.alive[state].cost + cost, ranks[state], letters, state)
                if to not in best or found < best[to]:
                    best[to] = found
        self._prune(best)
        uses = Counter(x[3] for x in best.values())
        held, now = self.alive, {}
        for to, (cost, _, letters, state) in sorted(best.items(), key=lambda x: x[1][1:3]):
            old = held[state]
            uses[state] -= 1
            digest = old.digest.copy() if uses[state] else old.digest
            some = self._written(digest, old.some, state, letters, role, text)
            now[to] = Survivor(cost, Node(letters, old.node), digest, some)
        self.alive = now
        for old in held.values():
            self._release(old.node)
        self.made += len(now)
        if self.made >= max(64, self.left):
            self._coalesce()

    @staticmethod
    def _prune(best: dict[str, tuple[int, int, str, str]]) -> None:
        """Drop survivors of which another can do all that they can at no more cost, ties included: what the start can still do, every state can, but keep a system turn, which costs 3 to delete."""
        zero, system, user, assistant = (best.get(x) for x in "0sua")
        if assistant and zero and (zero[0], *zero[1:3]) < (assistant[0], *assistant[1:3]):
            del best["a"]
        if system and any(x and x[:3] < system[:3] for x in (zero, assistant)):
            del best["s"]
        if zero and any(x and x[0] + more < zero[0] for x, more in ((assistant, DELETE), (user, DELETE + INSERT), (system, 2 * INSERT))):
            del best["0"]

    @staticmethod
    def _written(digest, some: bool, state: str, letters: str, role: str, text: str) -> bool:
        for x in letters:
            if x == "D":
                continue
            if x == "K":
                line, state = f"{role}:{text}", role[:1]
            else:
                state = NEXT[state]
                line = f"{ROLES[state]}:{text if x == 'R' else ''}"
            digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
            some = True
        return some

    @staticmethod
    def _release(node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            node = node.parent

    def _coalesce(self) -> None:
        """Emit the edits above the last common ancestor of all survivors; join what is left into one node from fork to fork, in blocks."""
        paths = []
        for s in self.alive.values():
            path, node = [], s.node
            while node is not self.root:
                path.append(node)
                node = node.parent
            paths.append(path[::-1])
        shared = 0
        for level in zip(*paths):
            if any(x is not level[0] for x in level):
                break
            shared += 1
        if shared:
            self.decided.append("".join(x.letters for x in paths[0][:shared]))
            self.root = paths[0][shared - 1]
            self.root.parent, self.root.letters = None, ""
        done: set[int] = set()
        for s in self.alive.values():
            path, node = [], s.node
            while node is not self.root and id(node) not in done:
                path.append(node)
                node = node.parent
            block, size = [], 0
            for node in reversed(path):
                block.append(node)
                done.add(id(node))
                size += len(node.letters)
                if node.refs > 1 or node is s.node or size > BLOCK:  # the last of them stands for all
                    if len(block) > 1:
                        node.letters, node.parent = "".join(x.letters for x in block), block[0].parent
                    block, size = [], 0
        self.made, self.left = 0, sum(self._length(s.node) for s in self.alive.values())

    def _length(self, node: Node) -> int:
        for k in count():
            if node is self.root:
                return k
            node = node.parent

    def held(self) -> int:
        """Letters in the tree, for tests."""
        seen, total = set(), 0
        for s in self.alive.values():
            node = s.node
            while node is not None and id(node) not in seen:
                seen.add(id(node))
                total += len(node.letters)
                node = node.parent
        return total

    def end(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the repaired conversation."""
        order = list(self.alive)
        state = min(order, key=lambda x: (self.alive[x].cost + INSERT * len(CLOSING[x]), order.index(x)))
        s = self.alive[state]
        self._written(s.digest, s.some, state, CLOSING[state], "", "")
        path, node = [], s.node
        while node is not None:
            path.append(node.letters)
            node = node.parent
        return s.cost + INSERT * len(CLOSING[state]), "".join([*self.decided, *path[::-1], CLOSING[state]]), s.digest.hexdigest()


class Conversation:
    """Counts and repair of one conversation, of which the turns come in order."""

    def __init__(self):
        self.repair, self.faults, self.illegal = Repair(), [0] * 4, 0
        self.first = self.last = self.before = None
        self.turns = 0

    def take(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        self.repair.turn(role, text, fault)

    def row(self) -> tuple:
        cost, audit, digest = self.repair.end()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, cost, audit, digest


COLUMNS = ("gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string", "repaired_sha256 string")


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row a conversation: ``conv`` and ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    * the turns of a conversation are taken by ``turn``, nulls first; of one turn by role, then by the SHA-256 of their text
    * a null role or text counts as one space, so such a text is blank and such a role is neither user nor assistant; a null
      ``conv`` is a conversation of its own; a role is what its first character says, ``S``, ``U`` and ``A`` are none of the three
    * rows where the column ``gone`` is true are not there, but their conversation is: without any other row it has zeros, no edits and the digest of nothing
    * repeated rows are duplicates of the first of them; an empty table gives no row; columns not named are not read
    * texts may have any length: no task holds more than a batch of rows
    """
    own = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    ).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    alike = Window.partitionBy("conv", "gone", "role", "sha").orderBy(F.col("turn").asc_nulls_first())
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(~F.right(body, F.lit(1)).isin(*".!?"), CUT).otherwise(NONE)
    marked = own.repartition("conv").withColumn("again", F.row_number().over(alike)).withColumn("fault", fault)
    ordered = marked.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "sha", "again").select("conv", "turn", "role", "text", "gone", "fault")
    kind = turns.schema[conv].dataType.simpleString()
    schema = pa.schema([pa.field(c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in COLUMNS])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def out() -> pa.RecordBatch:
            ids = pa.array([x for x, _ in done], kind_of[0])
            cols = [pa.array([r[k] for _, r in done], f.type) for k, f in enumerate(schema)]
            return pa.RecordBatch.from_arrays([ids, *cols], names=["conv", *schema.names])

        kind_of: list[pa.DataType] = []
        for batch in slices(batches, "text"):
            kind_of[:] = [batch.schema.field("conv").type]
            for c, t, r, x, g, f in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "gone", "fault"))):
                if state is None or c != now:
                    if state is not None:
                        done.append((now, state.row()))
                    now, state = c, Conversation()
                if not g:
                    state.take(t, r, x, f)
            if done:
                yield out()
                done = []
        if state is not None:
            done = [(now, state.row())]
            yield out()

    found = ordered.mapInArrow(repair, f"conv {kind}, {', '.join(COLUMNS)}")
    return found.withColumnRenamed("conv", conv)


def damaged(turns: DataFrame) -> DataFrame:
    """The registered query's damage, by the remainder of ``crc32(conv_id:turn)`` by 20: 0 drops a row (it stays, marked ``gone``), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's. Nulls count as one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = turns.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = read.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return changed.drop("copy")


def query(spark, sf_dir):
    return repaired(damaged(table(spark, sf_dir, "conversations")), gone="gone")


#: The same by a recursion over positions that carries each state's cost, edits and whole repaired text.
ORACLE = (
    r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, """
    + CRC32_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    + r""" % 20 AS kind FROM conversations
), changed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM changed
), turns AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM turns GROUP BY conv_id
), inserted(st, ins, mid, made) AS (
  VALUES ('0', '', '0', []), ('0', 'I', 'u', ['user:']), ('0', 'II', 'a', ['user:', 'assistant:']), ('s', '', 's', []), ('s', 'I', 'u', ['user:']), ('s', 'II', 'a', ['user:', 'assistant:']),
    ('u', '', 'u', []), ('u', 'I', 'a', ['assistant:']), ('a', '', 'a', []), ('a', 'I', 'u', ['user:'])
), taken(mid, initial, letter, after, more) AS (
  VALUES ('0', 's', 'K', 's', 0), ('0', 'u', 'K', 'u', 0), ('s', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0), ('a', 'u', 'K', 'u', 0),
    ('0', NULL, 'R', 'u', 2), ('s', NULL, 'R', 'u', 2), ('u', NULL, 'R', 'a', 2), ('a', NULL, 'R', 'u', 2), ('0', NULL, 'D', '0', 3), ('s', NULL, 'D', 's', 3), ('u', NULL, 'D', 'u', 3), ('a', NULL, 'D', 'a', 3)
), steps AS (
  SELECT st, initial, ins || letter AS letters, after, 2 * length(ins) + more AS more, made, letter FROM inserted JOIN taken USING (mid)
), survivors(conv_id, pos, st, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, '0', 0::BIGINT, '', []::VARCHAR[] FROM counts
  UNION ALL
  SELECT conv_id, pos, st, best.cost, best.audit, best.lines FROM (
    SELECT v.conv_id, t.pos, s.after AS st, min({'cost': v.cost + s.more + CASE WHEN s.letter <> 'D' AND t.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': v.audit || s.letters,
      'lines': v.lines || s.made || CASE s.letter WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [CASE s.after WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text] END}) AS best
    FROM survivors v JOIN turns t ON t.conv_id IS NOT DISTINCT FROM v.conv_id AND t.pos = v.pos + 1 JOIN steps s ON s.st = v.st
    WHERE (s.initial IS NULL OR s.initial = t.initial) AND (s.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate'))
    GROUP BY v.conv_id, t.pos, s.after)
), closed AS (
  SELECT v.conv_id, min({'cost': v.cost + 2 * length(i.ins), 'audit': v.audit || i.ins, 'lines': v.lines || i.made}) AS best
  FROM survivors v JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id AND c.n = v.pos JOIN inserted i ON i.st = v.st
  WHERE i.mid = 'a' OR (v.st = '0' AND i.ins = '') GROUP BY v.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN closed d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
)
