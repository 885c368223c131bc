"""MinHash links against all pairs."""

import random
import re

import numpy as np
import pytest
from corpora import documents, words, with_clashes

from tallymill.llm import minhash as M


def by_hand(text, size=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    size = min(size, len(found))
    return frozenset(" ".join(found[k : k + size]) for k in range(len(found) - size + 1))


def expected(rows, percent=85):
    sets = [by_hand(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = {}
    for k, (doc_id, _) in enumerate(rows):
        members.setdefault(find(k), []).append(doc_id)
    least = {r: min((m for m in ids if m is not None), default=None) for r, ids in members.items()}
    return sorted(((d, len(sets[k]), least[find(k)]) for k, (d, _) in enumerate(rows)), key=str)


def found(docs, **parameters):
    got = M.near_duplicates(docs, **parameters).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("text", ["", " \t", "One", "one TWO", "a b c", "É x y z \x0b q", "a b c d a b c d a b c"])
def test_set_sizes(text):
    assert len(M.shingle_set(text.encode())) == len(by_hand(text))


def test_case_of_ascii_only_and_length_matter():
    same = lambda a, b: np.array_equal(M.shingle_set(a.encode()), M.shingle_set(b.encode()))
    assert same("A b\tC", "a B c") and not same("É b c", "é b c") and not same("a b", "b a") and not same("a a", "a a a")


def test_one_wrong_symbol_in_a_chunk_keeps_a_common_key():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << 16, M.POSITIONS).astype("<u2")
    for wrong in range(M.GUARANTEED + 1):
        other = own.copy()
        # the worst placing: chunks filled evenly
        places = [(k % M.CHUNKS) * M.CHUNK + k // M.CHUNKS for k in range(wrong)]
        other[places] ^= 1
        keys = M.chunk_keys(np.stack([own, other]))
        assert (keys[0] == keys[1]).any()


def test_counts_of_common_values():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(300) for _ in range(rng.randrange(1, 90))], dtype=np.uint64)) for _ in range(9)]
    got = M.common_counts(sets[:4], sets[4:], width=16)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[4:]] for a in sets[:4]]


def near_copies(seed, groups=14):
    """Groups whose members lie on both sides of the threshold from each other, chains among them."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = words(rng, rng.randrange(4, 120), 4000).split()
        for _ in range(rng.randrange(1, 9)):
            if rng.random() < 0.5:
                base = list(base)
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = copy
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 2)])
def test_components_are_those_of_all_pairs(spark, seed, block):
    rows = near_copies(seed)
    want = expected(rows)
    assert len({c for _, _, c in want}) < len(rows)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs, block=block) == want


def test_odd_documents(spark):
    docs = with_clashes(documents(spark), "node", "label", "leader", "digest", "members", "root", "first", "text_hash", "row_id")
    assert found(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert found(documents(spark, [])) == []
