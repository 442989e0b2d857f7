"""Repairs against a full dynamic program over the lattice, on random and on long conversations."""

import hashlib
import random
import zlib

import pytest

from molspark.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, cost int, part int, digest string"


def by_table(rows):
    """(cost, letters, repaired rows) by filling the whole table, front to back."""
    states = {"": (0, "", ())}
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def insert(states):
        for _ in range(3):
            for q, (c, s, t) in list(states.items()):
                to = turn[q]
                states[to] = min(states.get(to, (10**9,)), (c + 2, s + "I", t + (name[to] + ":",)))
        return states

    states = insert(states)
    for role, text, fault in rows:
        new = {}

        def offer(q, way, new=new):
            new[q] = min(new.get(q, (10**9,)), way)

        for q, (c, s, t) in states.items():
            offer(q, (c + 3, s + "D", t))
            if fault != "x":
                more = fault == "t"
                offer(turn[q], (c + 2 + more, s + "R", (*t, f"{name[turn[q]]}:{text}")))
                first = role[:1]
                if first == "s" and q == "" or first == "u" and q != "u" or first == "a" and q == "u":
                    offer(first, (c + more, s + "K", (*t, f"{role}:{text}")))
        states = insert(new)
    return min(states[q] for q in ("", "a") if q in states)


def expected(rows):
    """(conv_id, turn, role, text) rows, copies expanded and in order, as the operator's row."""
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for turn, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if kind:
            counts[kind] += 1
        judged.append((role, text, {"blank": "x", "duplicate": "x", "truncated": "t"}.get(kind, "")))
    cost, audit, repaired = by_table(judged)
    turns = [t for t, _, _ in rows if t is not None]
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def some_rows(rng, n):
    texts = ["Yes.", "No", "Why?", "", " ", "a b", "Go!", "\t\n", "Yes. ", "x" * 40]
    return [(rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", "tool", "", "u"]), rng.choice(texts) + rng.choice(["", "", str(rng.random())])) for _ in range(n)]


def test_search_equals_the_full_table():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice("suatx"), rng.choice(["", "", "", "t", "x"])) for _ in range(rng.randrange(12))]
        cost, letters = cr.cheapest(rows)
        want = by_table([(role, "m", fault) for role, fault in rows])
        assert (cost, letters) == want[:2]
        assert tuple(cr.carry_out(letters, [r for r, _ in rows], ["m"] * len(rows))) == want[2]


def test_initials_of_a_repair_fit_the_grammar():
    import re

    rng = random.Random(6)
    for _ in range(300):
        rows = [(rng.choice("suat"), rng.choice(["", "t", "x"])) for _ in range(rng.randrange(30))]
        lines = cr.carry_out(cr.cheapest(rows)[1], [r for r, _ in rows], ["m"] * len(rows))
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_pieces_meet_in_the_same_repair():
    """Ways between states, chosen backwards and forwards, equal the search over all rows."""
    import pyarrow as pa

    rng = random.Random(7)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.choice(["", "", "t", "x"])) for _ in range(rng.randrange(1, 40))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(5))})
        pieces = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        ways = [{"conv": 1, "part": 0, "seq": i, "costs": c, "ranks": r} for i, (c, r) in enumerate(map(cr.between_states, pieces))]
        back = [b for batch in (ways[::-1],) for b in cr._choose_backwards([pa.RecordBatch.from_pylist(batch)])]
        rows_back = sorted((r for b in back for r in b.to_pylist()), key=lambda r: r["seq"])
        states = [r for b in cr._choose_forwards([pa.RecordBatch.from_pylist(rows_back)]) for r in b.to_pylist()]
        parts = [cr.cheapest(p, s["entry"], (s["exit"],), last=False) for p, s in zip(pieces, states)]
        cost, letters = cr._CLOSE[states[-1]["exit"]]
        assert (sum(c for c, _ in parts) + cost, "".join(s for _, s in parts) + letters) == cr.cheapest(rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_random_conversations(spark, parts):
    rng = random.Random(parts)
    convs = {c: some_rows(rng, rng.randrange(1, 9)) for c in [None, *range(60)]}
    data = [(c, t, r, x, 9, 9, "clash") for c, rows in convs.items() for t, r, x in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = found(cr.repair(spark.createDataFrame(data, SCHEMA).repartition(3)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {c: expected(in_order(rows)) for c, rows in convs.items()}


def test_a_conversation_longer_than_a_task(spark):
    rng = random.Random(9)
    rows = [(t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Fine.", f"No {t}", f"Yes {t}."])) for t in range(2500)]
    rows += [(700, "user", "again and again.")] * 900 + [(None, "user", "z.")] * 3
    few = {c: some_rows(rng, 4) for c in range(100, 140)}
    data = [(1, *r, 0, 0, "") for r in rows] + [(c, *r, 0, 0, "") for c, kept in few.items() for r in kept]
    got = found(cr.repair(spark.createDataFrame(data, SCHEMA).repartition(5)))
    assert got == {1: expected(in_order(rows))} | {c: expected(in_order(kept)) for c, kept in few.items()}


def test_damage_nulls_and_dropped_conversations(spark):
    rng = random.Random(11)
    data = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["Hm. So!", None, "Well"]), 0, 0, "") for c in range(40) for t in (None, 1, 2)]
    data += [(c, 0, "user", "Alone.", 0, 0, "") for c in range(100, 180)] + [(None, None, None, None, None, None, None)]
    want = {}
    for c, t, role, text, *_ in data:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault, role, text = zlib.crc32(key.encode()) % 20, role or " ", " " if text is None else text
        rows = want.setdefault(c, [])
        text = "" if fault == 1 else text.translate({ord(x): None for x in ".!?"}) if fault == 2 else text
        rows += [(t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert any(not rows for rows in want.values())
    got = found(cr.repair(cr.damage(spark.createDataFrame(data, SCHEMA)), "copies"))
    assert got == {c: expected(in_order(rows)) for c, rows in want.items()}


def test_no_rows(spark):
    assert cr.repair(cr.damage(spark.createDataFrame([], SCHEMA)), "copies").count() == 0
