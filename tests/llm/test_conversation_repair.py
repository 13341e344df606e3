import hashlib
import itertools
import random
import re
import zlib

import pytest

from moodlake.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, seq string, edit int"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def faults(rows):
    """(role, text, fault) of ordered rows."""
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by keeping, for each grammar state, the least (cost, audit) of all edits: insertions are
    tried before every row and at the end, one after the other."""
    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, done) in list(best.items()):
                for c in "ua":
                    if c in NEXT[s]:
                        new = (cost + 5, audit + "I", done + [(cr.ROLES[c], "")])
                        if NEXT[s][c] not in best or new[:2] < best[NEXT[s][c]][:2]:
                            best[NEXT[s][c]] = new
        return best

    best = inserted({0: (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, done) in best.items():
            ways = [(s, cost + 2, audit + "D", done)]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in NEXT[s]:
                    ways.append((NEXT[s][role[:1]], cost + extra, audit + "K", done + [(role, text)]))
                ways += [(NEXT[s][c], cost + extra + 1, audit + "R", done + [(cr.ROLES[c], text)]) for c in "ua" if c in NEXT[s]]
            for t, *way in ways:
                if t not in new or tuple(way[:2]) < new[t][:2]:
                    new[t] = tuple(way)
        best = inserted(new)
    return min(x for s, x in best.items() if s in (0, 3))


def by_enumeration(rows):
    """All sequences of edits, with up to two insertions at each place."""
    places = [["", "I", "II"]]
    for _, _, fault in rows:
        places += [["D"] if fault in ("blank", "duplicate") else ["D", "K", "R"], ["", "I", "II"]]
    found = []
    for way in itertools.product(*places):
        state, cost = 0, 0
        for k, edits in enumerate(way):
            for e in edits:
                role, _, fault = rows[k // 2] if k % 2 else (None, None, None)
                if e == "D":
                    cost += 2
                    continue
                cost += 5 * (fault == "truncated") + (5 if e == "I" else e == "R")
                if e == "K":
                    state = NEXT[state].get(role[:1], -1)
                else:
                    state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                if state < 0:
                    break
            if state < 0:
                break
        if state in (0, 3):
            found.append((cost, "".join(way)))
    return min(found)


def expected(original, rows):
    """What ``report`` gives, by conversation, for rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in original}:
        own = sorted(((t is not None, t or 0), r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv)
        turns = {t[1] for t, _, _ in own if t[0]}
        judged = faults([x[1:] for x in own])
        cost, audit, done = cheapest(judged)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
        counts = [sum(x[2] == f for x in judged) for f in cr.FAULTS]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts,
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def random_rows(rng, n, roles="sua", faulty=0.3):
    out = []
    for k in range(n):
        role = rng.choice(roles)
        fault = rng.choice([None, "blank", "duplicate", "truncated"]) if rng.random() < faulty else None
        out.append((role, {None: f"t{k}.", "blank": " ", "duplicate": f"t{k}.", "truncated": f"t{k}"}[fault], fault))
    return out


def walked(rows, look, monkeypatch):
    monkeypatch.setattr(cr, "_LOOK", look)
    walk, found = cr.Walk(), []
    most = 0
    for k, (role, _, fault) in enumerate(rows):
        found += walk.step(k, cr._INITIALS.find(role[:1]) + 1 if role else 0, cr.FAULTS.index(fault) + 1 if fault else 0)
        most = max(most, walk.pending)
    rest, behind = walk.end()
    found += rest
    assert [x[0] for x in found] == list(range(len(rows)))
    done = []
    for k, before, edit, role in found:
        done += [(cr.ROLES[c], "") for c in before]
        if edit != "D":
            done.append((role or rows[k][0], rows[k][1]))
    return walk.cost, "".join(walk.audit), done + [(cr.ROLES[c], "") for c in behind], most


def test_search_equals_enumeration():
    rng = random.Random(1)
    for _ in range(150):
        rows = random_rows(rng, rng.randrange(0, 6), "suax")
        assert cheapest(rows)[:2] == by_enumeration(rows)


@pytest.mark.parametrize("look", [1, 3, 64])
def test_walk_equals_search(monkeypatch, look):
    rng = random.Random(2)
    for n in range(1500):
        rows = random_rows(rng, rng.randrange(0, 40), rng.choice(["sua", "ua", "uuuua", "ssua", "suax", "u", "s", "a", "aauu"]), rng.choice([0, 0.2, 0.6, 1]))
        role_names = [(r, t, f) for r, t, f in rows]
        assert walked(role_names, look, monkeypatch)[:3] == cheapest(rows), rows


def test_edits_leave_as_survivors_coalesce(monkeypatch):
    rng = random.Random(3)
    rows = [("user" if k % 2 == 0 else "assistant", f"t{k}.", None) if rng.random() < 0.9 else (rng.choice("sua"), f"t{k}", "truncated")
            for k in range(20_000)]
    *_, most = walked(rows, 64, monkeypatch)
    assert most <= 128


def test_unresolved_ties_are_compared_whole(monkeypatch):
    """Two phases cost the same as long as this goes on: nothing coalesces before the end."""
    rows = [(r, f"t{k}.", None) for k, r in enumerate(["u", "u", "a", "a"] * 60)]
    assert walked(rows, 64, monkeypatch)[:3] == cheapest(rows)
    assert walked(rows + [("a", "x.", None)], 64, monkeypatch)[:3] == cheapest(rows + [("a", "x.", None)])


def odd_conversations():
    rng = random.Random(4)
    long = "very long text " * 20_000
    rows = [(1, 0, "system", "Be nice."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."),
            (2, None, "user", "No turn."), (2, None, None, "No role."), (2, 7, "assistant", None),
            (3, 5, "user", ""), (3, 6, "assistant", " \n\t"), (4, 1, "tool", "x."), (4, 1, "", "No name."), (4, 9, "umpire", "Fine."),
            (None, 1, "user", "No id?"), (None, 4, "assistant", "None."), (5, 1, "user", long + "."), (5, 2, "assistant", long),
            (6, 0, "user", "a."), (6, 0, "assistant", "b."), (6, 0, "user", "c."), (7, None, None, None), (8, 2 ** 40, "user", "z."), (8, -3, "assistant", "y.")]
    rows += [(9, k, "user", "Again.") for k in range(30)] + [(9, 3, "user", "Again.")] * 20
    for conv in range(20, 60):
        rows += [(conv, rng.choice([k, k, None]), rng.choice(["system", "user", "assistant", "user", "assistant"]),
                  rng.choice(["Yes.", "No", "", f"Number {k}!", "What?"])) for k in range(rng.randrange(1, 25))]
    return rows + rows[:3]


def test_report_equals_brute_force(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    assert got(cr.report(df, df)) == expected(rows, rows)
    assert got(cr.report(df, cr.damage(df))) == expected(rows, damaged(rows))


def test_repaired_rows_are_legal(spark):
    rows = odd_conversations()
    done = cr.repair(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA))
    by_conv = {}
    for r in done.repaired.orderBy("conv", "seq", "at").collect():
        by_conv.setdefault(r["conv"], []).append(r["role"][:1])
    assert by_conv and all(re.fullmatch("s?(ua)+", "".join(x)) for x in by_conv.values())
    judged = done.rows.collect()
    assert sum(r["copies"] for r in judged) == len(rows) and {r["edit"] for r in judged} <= set("KRD")


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cr.report(df, cr.damage(df)).count() == 0 and cr.repair(df).rows.count() == 0


def test_conversation_that_lost_all_its_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "x.", "", 0)], SCHEMA)
    assert got(cr.report(df, df.filter("turn < 0"))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_sf001_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert got(cr.report(df, cr.damage(df))) == expected(rows, damaged(rows))
