"""The recurrent model: gradients, normalisation, whole-text scores; base scores by hand; held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpora import SCHEMA, documents, with_clashes

from tallymill.llm import language_model, recurrent


def small(seed=3):
    w = recurrent.start(np.array([5.0, 3, 2, 1]), np.array([[2.0, 2, 1], [1, 1, 1]]), 4, seed)
    return w.like(w.flat() + np.random.default_rng(seed).normal(0, 0.3, w.flat().shape))


def test_probabilities_sum_to_one():
    w = small()
    states = np.random.default_rng(1).normal(0, 1, (7, 4)).astype(np.float32)
    symbols = 2 * 3 + 2  # words of two frequent classes, and two other classes
    total = sum(np.exp(recurrent.log_probabilities(w, states, np.full(7, s))) for s in range(symbols))
    assert np.allclose(total, 1, atol=1e-5)


def test_gradient():
    w = small()
    rng = np.random.default_rng(2)
    inputs, targets = rng.integers(0, 8, (3, 5)), rng.integers(0, 8, (3, 5))
    live = np.arange(5) < np.array([5, 3, 0])[:, None]
    state = rng.normal(0, 1, (3, 4)).astype(np.float32)

    def loss(values):
        v, now, total = w.like(values), state, 0.0
        for t in range(5):
            new, _ = recurrent._step(v, inputs[:, t], now)
            now = np.where(live[:, t, None], new, now)
            total -= (recurrent.log_probabilities(v, new, targets[:, t]) * live[:, t]).sum()
        return total / live.sum()

    flat, got = w.flat(), recurrent.gradient(w, inputs, targets, live, state)[0].flat()
    for k in rng.choice(len(flat), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - got[k]) < 2e-3


def test_state_is_carried_across_windows():
    w = small()
    texts = [np.random.default_rng(k).integers(0, 8, n) for k, n in enumerate([1, 40, 7, 0, 129])]
    want = []
    for t in texts:
        state, before, total = np.zeros((1, 4), dtype=np.float32), len(w.table) - 1, 0.0
        for s in t:
            state, _ = recurrent._step(w, np.array([before]), state)
            total += recurrent.log_probabilities(w, state, np.array([s]))[0]
            before = s
        want.append(total)
    for window in (3, 64):
        assert np.allclose(recurrent.score(w, texts, window), want, atol=1e-3)


def by_hand(rows):
    split = []
    for r in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        split.append(re.findall(r"[^\x20\x09-\x0D]+", lower) + [None])
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2 for r in rows]
    counts = Counter(w for s, h in zip(split, held) if not h for w in s)
    total = sum(counts.values())
    per = [sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in s) for s in split]
    return [(r[0], h, len(s), sum(w in counts for w in s), total, p) for r, h, s, p in zip(rows, held, split, per)]


def test_base_and_counts(spark):
    docs = with_clashes(documents(spark), "word", "n", "row", "score", "held_out", "n_known", "rest")
    rows = [tuple(r)[:2] for r in docs.collect()]
    # few remembered words, so that the join with rare words takes part
    got = language_model.score_documents(docs, heads=2, size=4, tails=4, remembered=20, rounds=1, share=1.0).collect()
    want = sorted(by_hand(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted((tuple(r) for r in got), key=str), want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] < 0


def test_scores_are_probabilities_of_texts(spark):
    """Over all one-word texts, an unknown word per class included, the probabilities of word and end sum to one."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "dd", "ee", "ff"]) for _ in range(5)), "en", "s", 0) for k in range(40)]
    rows += [(k + 1000, w, "en", "s", 0) for k, w in enumerate(["", "a", "b", "c", "dd", "ee", "ff"])]
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    docs = spark.createDataFrame(kept, SCHEMA)
    got = {r.doc_id: r for r in language_model.score_documents(docs, heads=1, size=4, tails=2, remembered=4, rounds=1).collect()}
    first = {}
    for r in kept[-7:]:
        if r[0] in got:
            first[r[1]] = 10 ** got[r[0]].score
    assert 0 < sum(first.values()) < 1


def test_learns_two_languages(spark):
    """On held-out texts the model beats the counts by far when words come in two kinds of text."""
    rng = random.Random(2)
    rows = []
    for k in range(1200):
        kind = rng.randrange(2)
        rows.append((k, " ".join(f"{'xy'[kind]}{rng.randrange(12)}" for _ in range(30)), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = language_model.score_documents(docs, heads=8, size=4, rounds=3, share=1.0).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.15  # half of the words are out of the question: at most log10(2) = 0.30


def test_every_training_document_is_learnt_from(spark):
    """Each text has a word of its own, so that word's weights move only if the network reads the text."""
    own = [b"w%d" % k for k in range(31)]
    vocabulary = language_model.Vocabulary([(language_model.END, 31)] + [(w, 3) for w in own], 4, 8, 2, {})
    texts = spark.createDataFrame([(k, f"w{k} w{k} w{k}") for k in range(31)], "doc_id long, text string").repartition(2)
    began = recurrent.start(vocabulary.class_counts, vocabulary.word_counts, 4)
    for rounds in (1, 3):
        moved = np.abs(language_model.train(texts, vocabulary, hidden=4, rounds=rounds).table - began.table).max(axis=1)
        assert all(moved[vocabulary.symbols[w]] > 1e-4 for w in own)


def test_empty(spark):
    assert language_model.score_documents(documents(spark, []), heads=2, size=2, remembered=10).count() == 0


def test_classes_are_worked_out_once_for_equal_first_bytes(monkeypatch):
    vocabulary = language_model.Vocabulary([(b"a", 5), (b"b", 4), (language_model.END, 3), (b"rare", 2), (b"c", 1)], 1, 3, 4, {})
    called = []
    plain = language_model.tail_class
    monkeypatch.setattr(language_model, "tail_class", lambda word, tails: called.append(word) or plain(word, tails))
    ranks = language_model._Ranks(vocabulary)
    rank, symbols = ranks.symbols(language_model._tokens(b"A rare newer newest b c"))
    new = plain(b"new", 4)
    assert rank.tolist() == [0, 3, -1 - new, -1 - new, 1, 4, 2] and called == [b"newer"]
    assert symbols.tolist() == [0, 3 + plain(b"rare", 4), 3 + new, 3 + new, 1, 3 + plain(b"c", 4), 2]


def test_trainer_follows_the_plain_rule():
    """Texts of several lengths, windows with ended rows: the weights, one array changed in place, follow Adam's rule."""
    rng = np.random.default_rng(5)
    trainer = recurrent.Trainer(small(), rate=0.05, rows=3, window=4)
    flat, views = trainer.flat, trainer.w
    trainer.add([rng.integers(0, 8, n) for n in (1, 9, 4, 13, 2, 30, 0, 5)])
    trainer.finish()
    assert trainer.seen == 64 and trainer.w is views and np.shares_memory(views.table, flat)

    rng = np.random.default_rng(5)
    w, opening = small(), len(small().table) - 1
    waiting = [np.append(opening, t) for t in (rng.integers(0, 8, n) for n in (1, 9, 4, 13, 2, 30, 0, 5)) if len(t)]
    rows, state, steps = [np.zeros(0, dtype=np.int64)] * 3, np.zeros((3, 4), dtype=np.float32), 0
    mean = square = np.zeros(len(flat))
    while waiting or any(len(r) > 1 for r in rows):
        inputs, targets, live = np.zeros((3, 4), dtype=np.int64), np.zeros((3, 4), dtype=np.int64), np.zeros((3, 4), dtype=bool)
        for k in range(3):
            if len(rows[k]) < 2 and waiting:
                rows[k], state[k] = waiting.pop(), 0
            n = max(min(len(rows[k]) - 1, 4), 0)
            inputs[k, :n], targets[k, :n], live[k, :n] = rows[k][:n], rows[k][1 : n + 1], True
            rows[k] = rows[k][4:]
        g, state = recurrent.gradient(w, inputs, targets, live, state)
        steps += 1
        found = np.clip(g.flat(), -1, 1).astype(float)
        mean, square = 0.9 * mean + 0.1 * found, 0.99 * square + 0.01 * found**2
        w = w.like(w.flat() - 0.05 * (mean / (1 - 0.9**steps)) / (np.sqrt(square / (1 - 0.99**steps)) + 1e-6))
    assert np.allclose(flat, w.flat(), atol=1e-3)


def test_different_words_of_a_batch_are_looked_up_once(monkeypatch):
    """Counts and training number the words of a batch; tokens are those of the texts one by one."""
    texts = ["B a  b A\x0b", "", " \t", "Ä a\x1cb É\u00a0x", " lead B b"]
    column = pa.array(["not read", *texts])[1:]
    words, number, ends = language_model._numbered(column)
    listed = language_model._listed(words)
    got = [[listed[k] for k in part] for part in np.split(number, ends[:-1])]
    want = [language_model._tokens(t.encode()) for t in texts]
    assert got == want and len(set(listed)) == len(listed)
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    counted = [x for b in language_model._count([batch]) for x in zip(b["word"].to_pylist(), b["n"].to_pylist())]
    assert dict(counted) == Counter(w for t in want for w in t) and len(counted) == len(dict(counted))

    class Sent:
        value = language_model.Vocabulary([(b"b", 5), (language_model.END, 4), (b"a", 2)], 1, 2, 2, {})

    asked, plain = [], language_model._Ranks.symbols
    monkeypatch.setattr(language_model._Ranks, "symbols", lambda self, tokens: asked.append(list(tokens)) or plain(self, tokens))

    class Start:
        value = recurrent.start(Sent.value.class_counts, Sent.value.word_counts, 4)

    trained = list(language_model._train([batch], Sent, Start, {"rows": 2, "window": 4}))
    assert [x.to_pylist()[0]["seen"] for x in trained] == [sum(map(len, want))]
    assert len(asked) == 1 and sorted(asked[0]) == sorted(set(listed))


def test_fewer_remembered_words_than_classes(spark):
    """Only held-out documents, hence no counts, and then a training document of two words."""
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    taught = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2)
    for rows in ([(k, "some unknown words") for k in held], [*((k, "some unknown words") for k in held), (taught, "some words")]):
        docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
        got = sorted(tuple(r) for r in language_model.score_documents(docs, remembered=1024, rounds=1).collect())
        for g, w in zip(got, sorted(by_hand(rows))):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and np.isfinite(g[6])
