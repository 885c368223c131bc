"""Conversation repair against all edits, tried from every row on."""

import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from tallymill.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    """Faults, cost, audit and hash of one conversation's rows (turn, role, text) in order."""
    seen, faults, pairs = set(), [], 0
    for k, (_, role, text) in enumerate(rows):
        filled = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else "")
        seen.add((role, text))
        pairs += k > 0 and (rows[k - 1][1][:1] + role[:1]) not in ("su", "ua", "au")
    lawful, begun = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")
    limit, found = 2 * len(rows), []

    def go(k, said, cost, audit, lines):
        if cost > limit or not begun.fullmatch(said):
            return
        if k == len(rows) and lawful.fullmatch(said):
            found.append((cost, audit, lines))
        for role in ("user", "assistant"):
            go(k, said + role[0], cost + 5, audit + "I", (*lines, role + ":"))
        if k < len(rows):
            _, role, text = rows[k]
            go(k + 1, said, cost + 2, audit + "D", lines)
            if faults[k] not in ("blank", "duplicate"):
                extra = 5 if faults[k] == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go(k + 1, said + role[0], cost + extra, audit + "K", (*lines, f"{role}:{text}"))
                for new in ("user", "assistant"):
                    go(k + 1, said + new[0], cost + extra + 1, audit + "R", (*lines, f"{new}:{text}"))

    go(0, "", 0, "", ())
    cost, audit, lines = min(found)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, conversations=60):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u2", None])
            text = rng.choice(["Yes.", "No!", "and then", "", " \t", "Why? ", "é.", "Yes.", None, "a. b"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows


def in_order(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in found.items()}


@pytest.mark.parametrize("seed, chunk", [(1, 4096), (2, 2)])
def test_repair_equals_all_edits(spark, seed, chunk):
    rows = made(seed)
    want = {c: by_hand(r) for c, r in in_order(rows).items()}
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("fault", F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(docs, chunk).collect()}
    assert got == want


def test_the_rows_of_a_repair(spark):
    rows = made(4, 12)
    docs = spark.createDataFrame(rows, SCHEMA)
    hashes = {r.conv_id: r.repaired_sha256 for r in C.repair(docs).collect()}
    kept = {c: [] for c in hashes}
    for r in sorted(C.repaired_rows(docs).collect(), key=lambda r: r.place):
        kept[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(k).encode()).hexdigest() for c, k in kept.items()} == hashes


def test_insertions_are_taken_where_they_are_cheapest(monkeypatch):
    monkeypatch.setattr(C, "INSERT", 1)
    monkeypatch.setattr(C, "DELETE", 9)
    C._choices.cache_clear()
    end = C._with_inserts([0, C._FAR, C._FAR, 0])
    costs = C.backward("g", end)  # one assistant row: a user must come before it
    assert costs[0][0] == 1 and [x[0] for x in C.steps("g", 0, costs[0], costs[1])] == ["I", "K"]
    assert list(C.endings(1)) == [2, 3] and list(C.endings(2)) == [3] and list(C.endings(0)) == []
    C._choices.cache_clear()


def test_a_long_conversation_over_many_parts_and_chunks(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"t{rng.randrange(600)}{rng.choice(['.', '', '!'])}") for k in range(900)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hello.")]
    got = {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), 50).collect()}
    # one task that sees the whole conversation at once
    ordered = [r[1:] for r in rows if r[0] == 1]
    seen, codes = set(), ""
    for _, role, text in ordered:
        kind = 1 if (role, text) in seen else 0 if text[-1] in ".!" else 2
        seen.add((role, text))
        codes += chr(97 + "sua".index(role[0]) * 3 + kind)
    costs = C.backward(codes, C.END)
    state, audit = 0, ""
    for k, symbol in enumerate(codes):
        for name, _, state in C.steps(symbol, state, costs[k], costs[k + 1]):
            audit += name
    audit += "I" * len(list(C.endings(state)))
    assert (got[1].cost, got[1].audit, got[2].audit) == (costs[0][0], audit, "KK")
    assert got[1].duplicate == codes.translate(str.maketrans("behk", "bbbb")).count("b")


def test_chunks_from_any_start_agree_up_to_a_constant():
    rng = random.Random(1)
    for _ in range(40):
        codes = "".join(rng.choice("acdfgi") for _ in range(60))
        ends = {tuple(C._level(C.backward(codes, right)[0])) for right in product([0, 3], repeat=4)}
        assert len(ends) == 1


def test_damage(spark):
    rows = made(5, 80)
    got = sorted(map(tuple, C.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    import zlib

    want = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        want += [(conv, turn, "user" if fate == 4 else role, text, fate != 0)] * (2 if fate == 3 else 1)
    assert got == sorted(want, key=str)


def test_conversations_without_rows_and_empty(spark):
    gone = spark.createDataFrame([(5, 1, "user", "Hi.", False), (6, 1, "user", "Hi", True)], SCHEMA + ", present boolean")
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(gone).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == {5: (0, 0, 0, 0, 0, 0, "", nothing), 6: (0, 0, 0, 1, 0, 2, "D", nothing)}
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
