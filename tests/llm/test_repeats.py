"""Removal of repeated byte strings against a direct count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpora import SCHEMA, with_clashes

from tallymill.llm import repeats
from tallymill.llm.bwt import repeated_starts


def by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + (gone[0] if len(gone) else 0))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a"])
@pytest.mark.parametrize("length", [1, 4, 9])
def test_interval_expansion(letters, length):
    rng = random.Random(len(letters) * 10 + length)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randrange(length, 60))).encode() for _ in range(12)]
    weights = np.array([rng.choice([1, 1, 2]) for _ in pieces])
    counts = Counter()
    for p, w in zip(pieces, weights):
        for k in range(len(p) - length + 1):
            counts[p[k : k + length]] += int(w)
    marked, piece, start, twice = repeated_starts(pieces, weights, length)
    for p, m in zip(pieces, marked):
        assert m.tolist() == [k for k in range(len(p) - length + 1) if counts[p[k : k + length]] > 1]
    strings = [pieces[k][a : a + length] for k, a in zip(piece, start)]
    assert sorted(strings) == sorted(counts) and all(t == (counts[s] > 1) for s, t in zip(strings, twice))


def corpus(seed):
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(90))
    other = "".join(rng.choice("abcdefghij é") for _ in range(50))
    texts = []
    for k in range(40):
        text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(0, 200)))
        if k % 3 == 0:
            text += passage[rng.randrange(20) : 90 - rng.randrange(20)] + text[:30]
        if k % 4 == 0:
            text = other + text + other
        texts.append(text)
    return [*texts, texts[3], texts[5][:100] + "#" + texts[5][100:], None, "", "z" * 150, "xy" * 80, texts[7] + texts[7]]


@pytest.mark.parametrize("spread, block", [(1000, 1 << 20), (3, 200)])
def test_removal(spark, spread, block):
    """The second case deals every frequent gram over several tiny blocks."""
    texts = corpus(3)
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, "q" * 10 + texts[0], "en", "s", 0)]
    rows += [rows[1]] * 2
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA), "gram", "content", "ranges", "text_hash", "low", "of_doc")
    got = repeats.remove_repeats(docs, length=24, gram=9, spread=spread, block=block, chunk=120).drop("kept").collect()
    want = [(r[0], *w) for r, w in zip(rows, by_hand([r[1] for r in rows], 24))]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
