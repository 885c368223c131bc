"""Proportionate-fair mixing: windows of blocks, deviation, all rows once."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from corpora import SCHEMA, documents, with_clashes

from tallymill.llm import mixing


def shares(blocks, weights):
    """Exact shares of the sources that are active while ``blocks`` are left."""
    active = {s: Fraction(weights.get(s, 0)) for s in blocks if weights.get(s, 0) > 0} or dict.fromkeys(blocks, Fraction(1))
    return {s: w / sum(active.values()) for s, w in active.items()}


def check_windows(blocks, weights, slots):
    """Every block once, in its exact window; at any slot, each source's deviation from its true share is below one."""
    left, at, k = {s: n for s, n in blocks.items() if n}, Counter(), 0
    assert [r[2] for r in slots] == list(range(sum(left.values())))
    while left:
        share, ran, t = shares(left, weights), Counter(), 0
        while all(left[s] > ran[s] for s in share):
            source, block, slot, _ = slots[k]
            assert block == at[source] and math.floor(ran[source] / share[source]) <= t < math.ceil((ran[source] + 1) / share[source])
            at[source] += 1
            ran[source] += 1
            t, k = t + 1, k + 1
        for s, w in share.items():
            assert abs(ran[s] - w * t) < 1
        left = {s: n - ran[s] for s, n in left.items() if n > ran[s]}
    assert k == len(slots)


@pytest.mark.parametrize("seed", range(8))
def test_schedule_keeps_every_window(seed):
    rng = random.Random(seed)
    weights = {f"s{k}": rng.random() ** 3 for k in range(rng.randrange(1, 30))}
    blocks = {s: rng.randrange(0, 300) for s in weights} | {"none": 7}
    check_windows(blocks, weights | {"less": 0.5, "none": -1}, mixing.schedule(blocks, weights | {"less": 0.5, "none": -1}))


def test_deviation_from_true_weights_after_a_million_slots():
    weights = {"a": 1 / 3, "b": 1 / 3, "c": 0.3332, "d": 0.0001}
    blocks = {"a": 340_000, "b": 340_000, "c": 339_000, "d": 200}
    slots = mixing.schedule(blocks, weights)
    total = sum(map(Fraction, weights.values()))
    shares_ = {s: Fraction(w) / total for s, w in weights.items()}
    done, first = Counter(), [r for r in slots if r[3] == 0]
    assert len(first) > 1_000_000
    for source, _, slot, _ in first:
        done[source] += 1
        if slot % 997 == 0:
            assert all(abs(done[s] - w * (slot + 1)) < 1 for s, w in shares_.items())


def test_two_thousand_sources():
    rng = random.Random(1)
    blocks = {f"s{k:04d}": rng.randrange(1, 40) for k in range(2000)}
    weights = {s: n**0.5 for s, n in blocks.items()}
    slots = mixing.schedule(blocks, weights)
    assert Counter(s for s, *_ in slots) == blocks and [r[2] for r in slots] == list(range(len(slots)))


def test_blocks_grow_with_the_table():
    assert [mixing.block_rows(n, 16, 1000) for n in (0, 16_000, 16_001, 10**6)] == [16, 16, 17, 1000]


def by_hand(blocks, weights):
    """Slot by slot: of the released blocks the one with the earliest deadline."""
    left, out, done = {s: n for s, n in blocks.items() if n}, [], Counter()
    while left:
        share, ran, t = shares(left, weights), Counter(), 0
        while all(left[s] > ran[s] for s in share):
            released = [s for s in share if math.floor(ran[s] / share[s]) <= t]
            source = min(released, key=lambda s: (math.ceil((ran[s] + 1) / share[s]), str(s)))
            out.append((source, done[source]))
            done[source] += 1
            ran[source] += 1
            t += 1
        left = {s: n - ran[s] for s, n in left.items() if n > ran[s]}
    return out


@pytest.mark.parametrize("weights", [None, {"src0": 1, "src1": 5}, {"src2": 1.0, "src0": 0.1, "src1": 0.01, "none": 3}])
@pytest.mark.parametrize("broadcast", [1 << 18, 0])
def test_mix(spark, weights, broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    rows = [(k, f"t{k}", "en", rng.choice(["src0"] * 6 + ["src1", "src2", None]), 0) for k in range(900)]
    rows += [(None, None, None, "src1", None), rows[0], rows[0]]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA), "slot", "block", "row", "phase", "units", "k", "number")
    got = mixing.mix(docs, weights, block=4).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    sizes = Counter(r[3] for r in rows)
    goals = {s: n**0.5 for s, n in sizes.items()} if weights is None else weights
    order = by_hand({s: -(-n // 4) for s, n in sizes.items()}, goals)
    places = {}
    for r in got:
        places.setdefault(r.slot, []).append(r)
    assert sorted(places) == list(range(len(order)))
    for slot, (source, block) in enumerate(order):
        own = sorted(places[slot], key=lambda r: r.place)
        assert {(r.row.source, r.block) for r in own} == {(source, block)}
        assert [r.place for r in own] == list(range(len(own))) and len(own) == min(4, sizes[source] - 4 * block)


def test_stored_order(spark, tmp_path):
    docs = documents(spark)
    path = str(tmp_path / "mixed")
    mixing.in_mixed_order(docs, block=2).write.parquet(path)
    placed = [r.row.doc_id for r in sorted(mixing.mix(docs, block=2).collect(), key=lambda r: (r.slot, r.place))]
    read = spark.read.parquet(path)
    assert read.columns == docs.columns
    name, row = mixing.stored_order()
    assert [r.doc_id for r in read.orderBy(name, row).select("doc_id").collect()] == placed


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
