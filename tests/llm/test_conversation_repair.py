"""Repair of conversations against an exhaustive search, on long undecided stretches and on odd tables."""

import hashlib
import random
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from docrec.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(turns):
    """The least cost, and of its edit strings the least, by trying all: ``turns`` are (role, text, fault)."""
    best = None
    for edits in product("KRD", repeat=len(turns)):
        for gaps in product(("", "I", "II"), repeat=len(turns) + 1):
            cost, state, lines, audit = 0, "0", [], ""
            for k in range(len(turns) + 1):
                for _ in gaps[k]:
                    state, cost = cr.NEXT[state], cost + 2
                    lines.append(cr.ROLES[state] + ":")
                audit += gaps[k]
                if k == len(turns):
                    break
                role, text, fault = turns[k]
                audit += edits[k]
                if edits[k] == "D":
                    cost += 3
                    continue
                if fault in (cr.BLANK, cr.DUPLICATE) or (edits[k] == "K" and role[:1] != cr.NEXT[state] and not (role[:1] == "s" and state == "0")):
                    cost = None
                    break
                cost += (fault == cr.CUT) + 2 * (edits[k] == "R")
                state = role[:1] if edits[k] == "K" else cr.NEXT[state]
                lines.append(f"{role if edits[k] == 'K' else cr.ROLES[state]}:{text}")
            if cost is not None and state in "0a":
                found = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
                best = min(best or found, found)
    return best


def test_repair_equals_an_exhaustive_search():
    rng = random.Random(5)
    for _ in range(150):
        turns = [(rng.choice(["system", "user", "assistant", "tool", " ", ""]), f"t{k}", rng.choice([0, 0, 0, 1, 2, 3])) for k in range(rng.randint(0, 3))]
        r = cr.Repair()
        for t in turns:
            r.turn(*t)
        assert r.end() == exhaustive(turns), turns


def stepwise(turns):
    """Viterbi that carries whole edit strings and texts."""
    at = {"0": (0, "", ())}
    for role, text, fault in turns:
        then = {}
        for state, letters, to, cost in cr.moves(role[:1] if role[:1] in ("s", "u", "a") else "", fault):
            if state in at:
                lines, here = list(at[state][2]), state
                for x in letters:
                    if x == "K":
                        lines, here = [*lines, f"{role}:{text}"], role[:1]
                    elif x != "D":
                        here = cr.NEXT[here]
                        lines.append(f"{cr.ROLES[here]}:{text if x == 'R' else ''}")
                found = (at[state][0] + cost, at[state][1] + letters, tuple(lines))
                then[to] = min(then.get(to, found), found)
        at = then
    return min((c + 2 * len(cr.CLOSING[s]), a + cr.CLOSING[s]) for s, (c, a, _) in at.items())


@pytest.mark.parametrize("roles", ["su", "uat", "t", "s", "ua", "sua t"])
def test_long_conversations_keep_every_tie(roles):
    rng = random.Random(len(roles))
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool", " ": " "}
    for n in (63, 64, 65, 300, 701):
        turns = [(names[rng.choice(roles)], "x.", rng.choice([0, 0, 1, 3])) for _ in range(n)]
        r = cr.Repair()
        for t in turns:
            r.turn(*t)
        assert r.end()[:2] == stepwise(turns)


def test_what_is_decided_leaves_the_tree():
    r, most = cr.Repair(), 0
    for k in range(20_000):
        r.turn("user" if k % 2 == 0 else "assistant", "fine.", cr.NONE if k % 97 else cr.CUT)
        most = max(most, r.held())
    assert most < 300  # letters
    late = cr.Repair()  # only the last turn says which of two readings is right: both stay, a letter a turn
    for _ in range(20_000):
        late.turn("tool", "fine.", cr.NONE)
    assert late.held() <= 2 * 20_000 + 200 and late._length(next(iter(late.alive.values())).node) < 200
    cost, audit, _ = late.end()
    assert (cost, audit) == (40_000, "R" * 20_000)


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, None, "system", "Be kind."), (2, None, None, None), (2, None, "user", ""),
        (None, 3, "user", "Alone"), (None, 5, "assistant", "Yes!\n"), (3, 7, "User", "Big."), (3, 9, "assistant", "\u00a0"), (4, 0, "user", "long " * 200_000 + "."), (4, 1, "assistant", "ok."),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("conv", "sha", "again", "fault", "gone", "cost", "audit")})
    got = {r["conv_id"]: r for r in cr.repaired(df).collect()}
    assert len(got) == 5
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert tuple(got[1])[1:] == (0, 0, 1, 0, 1, 3, "KKKD", sha("system:Be kind.\nuser:Hi.\nassistant:Hello."))
    assert tuple(got[2])[1:] == (0, 2, 0, 0, 1, 6, "DD", sha(""))
    assert tuple(got[None])[1:] == (1, 0, 0, 1, 0, 1, "KK", sha("user:Alone\nassistant:Yes!\n"))
    assert got[3]["audit"] == "RK" and got[3]["truncated"] == 1 and got[3]["illegal"] == 1  # a no-break space is a character like any other
    assert got[4]["audit"] == "KK" and got[4]["repaired_sha256"] == sha("user:" + "long " * 200_000 + ".\nassistant:ok.")
    assert cr.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage_and_conversations_that_lose_all_rows(spark):
    rows = [(c, t, r, f"Text {c} {t}!") for c in range(200) for t, r in enumerate(["user"])] + [(None, None, None, None)]
    kinds = {(c, t): zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows}
    got = {r["conv_id"]: r for r in cr.repaired(cr.damaged(spark.createDataFrame(rows, SCHEMA)), gone="gone").collect()}
    assert set(got) == {c for c, *_ in rows}
    for (c, _t), kind in kinds.items():
        want = {0: "", 1: "D", 2: "D", 3: "KDI"}.get(kind, "D" if c is None else "KI")
        assert got[c]["audit"] == want, (c, kind)
        assert got[c]["truncated"] == (kind == 2 and c is not None)
    gone = [got[c] for (c, _), k in kinds.items() if k == 0]
    assert gone and all(tuple(g)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for g in gone)
