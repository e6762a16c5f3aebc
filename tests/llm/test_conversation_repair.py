"""Conversation repair against an exhaustive search in plain Python."""

import hashlib
import itertools
import random
import re
import zlib

from heliograph.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, cost int, fault string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
BLANK = " \t\n\x0b\x0c\r"


def after(rows):
    """Rows after damage, and every conv_id."""
    out = []
    for conv, turn, role, text in rows:
        sign = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{sign(conv)}:{sign(turn)}".encode()) % 20
        role, text = sign(role), sign(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [] if kind == 0 else [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """Least (cost, audit) with the roles it leaves, by growing tables over all turns: (state) -> best."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, rows) in list(best.items()):
                for i, to in moves[state].items():
                    if i in full:
                        new = (cost + 3, audit + "I", rows + ((full[i], ""),))
                        best[to] = min(best.get(to, new), new)
        return best

    best = inserted({0: (0, "", ())})
    for role, text, fault in turns:
        then = {}
        for state, (cost, audit, rows) in best.items():
            found = [(state, (cost + 4, audit + "D", rows))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in moves[state]:
                    found.append((moves[state][role[:1]], (cost + more, audit + "K", rows + ((role, text),))))
                found += [(to, (cost + 3 + more, audit + "R", rows + ((full[i], text),))) for i, to in moves[state].items() if i in full]
            for to, new in found:
                then[to] = min(then.get(to, new), new)
        best = inserted(then)
    return min(best[s] for s in (0, 3) if s in best)


def plain(rows):
    left, out = after(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r, x) for c, t, r, x in left if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns = set(), []
        for _, role, text in own:
            solid = text.strip(BLANK)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = lambda f: sum(t[2] == f for t in turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, kept = cheapest(turns)
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA).repartition(3)
    found = C.repair_conversations(C.damaged(df))
    assert found.columns == NAMES
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_random_conversations(spark):
    rng = random.Random(3)
    text = lambda: rng.choice(["Yes.", "No!", "Well", "", " \t", None, "Why? ", "a.\n", "日本。", "end ", "Yes.", "x"])
    rows = []
    for conv in [*range(150), None]:
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["tool", "user", None, "", "assistant"]])
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(roles), text()))
    rows += rows[:7]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    assert {r[7] for r in plain(rows) if len(r[7]) > 3}


def test_all_rows_dropped(spark):
    turns = [t for t in range(2000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0]
    rows = [(1, t, "user", "Hello.") for t in turns]
    assert got(spark, rows) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] == plain(rows)


def test_long_conversation():
    """Audits of several links: long ones compare as their strings do."""
    rng = random.Random(5)
    turns = [(rng.choice(["user", "assistant", "assistant", "system"]), f"t{i}", rng.choice(["", "", "blank", "truncated"])) for i in range(900)]
    number = {"": C.FINE, "blank": C.BLANK, "truncated": C.CUT}
    cost, audit, edits = C.cheapest([C.Turn(r, t, number[f]) for r, t, f in turns])
    want = cheapest(turns)
    assert (cost, audit) == want[:2]
    assert [(role, turns[t][1] if t >= 0 else "") for name, t, role in edits if name != "D"] == list(want[2])


def test_audits_compare_as_strings():
    rng, made = random.Random(2), {"": C.Audit()}
    for _ in range(3000):
        s = rng.choice(list(made)[-40:])
        for c in rng.sample("DIKR", 2):
            made.setdefault(s + c, made[s].plus(c))
    keys = list(made)
    assert max(map(len, keys)) > 2 * C.LINK or len(keys) > 1000
    for _ in range(20000):
        a, b = rng.sample(keys, 2)
        assert (made[a] < made[b]) == (a < b) and str(made[a]) == a


def test_whole_table(spark):
    from heliograph.llm.queries import op13_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()), key=repr) == plain(rows)
