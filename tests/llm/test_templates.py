"""Template matches: exact, re-parameterised and inconsistent questions, clean texts, odd cases."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from corpora import SCHEMA, with_clashes, words

from tallymill.llm import templates

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and another train leaves Denver at 45 km per hour; after how long are the two trains 300 km apart on the line?"),
    (2, "Each of the children in the class of Maria has 12 red marbles and 7 blue marbles, so how many marbles do Maria and the 5 children have together in all?"),
    (3, "what is the capital city"),
    (4, None),
    (5, "1 2 3 4 5 6 7 8 9 10"),
    (None, "words without any number that nobody should ever be matched with at all here"),
]


def tokens(text):
    return templates.canonical(text, templates._Forms())[0].tolist()


def test_placeholders():
    got = tokens("He paid Anna Smith $5,000 for 12 kg and 3km. The END of it")
    kinds = [t if t < 4 else "w" for t in got]
    assert kinds == ["w", "w", 2, 1, "w", 1, 3, "w", 1, "w", "w", "w", "w"]
    assert tokens("the cat, sat") == tokens("The (cat) sat!") and tokens("") == [] and tokens(" ... -- ") == []


def corpus():
    rng = random.Random(7)
    q1, q2 = ITEMS[0][1], ITEMS[1][1]
    other = q1.replace("Boston", "Oslo").replace("Denver", "Rome").replace("60", "72").replace("45", "31").replace("300", "515")
    # one value of the item (12 and 7 are different) maps to one value; here equal values of the item differ
    docs = {
        10: words(rng, 40) + "\n" + q1 + "\n" + words(rng, 40),
        11: words(rng, 30) + ". " + other + " " + words(rng, 30),
        12: q2.replace("Maria", "Paul Meyer").replace("12", "99"),
        13: words(rng, 200),
        14: "We ask: what is the capital city of it",
        15: "1 2 3 4 5 6 7 8 9 10 11 12",
        16: " ".join(q1.split()[:9]),
        17: None,
        18: "",
        19: words(rng, 20) + " " + " ".join(q2.split()[4:20]) + " " + words(rng, 20),
        20: "words without any number that nobody should ever be matched with at all here",
        21: q1.upper(),
        22: q1 + " " + q2,
    }
    found = {10: [1], 11: [1], 12: [2], 14: [3], 19: [2], 22: [1, 2]}
    return docs, found


@pytest.mark.parametrize("vocabulary", [1 << 20, 0])
def test_matches(spark, vocabulary):
    docs, found = corpus()
    rows = [(k, t, "en", "s", 0) for k, t in docs.items()] + [(10, docs[10], "en", "s", 0), (None, docs[11], "en", "s", 0)]
    table = with_clashes(spark.createDataFrame(rows, SCHEMA), "window", "place", "slots", "item_id", "items", "coverage", "windows", "size")
    items = with_clashes(spark.createDataFrame(ITEMS, "item_id long, text string"), "doc_id", "window", "token")
    got = templates.decontaminate(table, items, vocabulary_bytes=vocabulary).collect()
    assert len(got) == len(rows)
    for r in got:
        want = found.get(11 if r.doc_id is None else r.doc_id, [])
        if r.doc_id != 21:  # all capitals: no names, other windows still match
            assert r["items"] == want and r.contaminated == bool(want), r
        assert 0 <= r.coverage <= 1


def test_values_must_map_one_to_one(spark):
    item = "the sum of 5 apples and 5 pears and 5 plums and 5 nuts in the old box of the farm is how much"
    same = item.replace("5", "8")
    mixed = "the sum of 1 apples and 2 pears and 3 plums and 4 nuts in the old box of the farm is how much"
    docs = spark.createDataFrame([(1, same, "en", "s", 0), (2, mixed, "en", "s", 0)], SCHEMA)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.consistency for r in templates.matches(docs, items, consistent=0.0).collect()}
    assert got == {1: 1.0, 2: 0.25}
    assert [r.doc_id for r in templates.matches(docs, items).collect()] == [1]


def test_dense_items_are_found(spark):
    named = "Tom has 5 apples. Ann has 7 apples. Bob has 9 apples. How many apples do they have?"
    dense = "On 3 May 2019 Anna Smith paid Paul Meyer 40 euros, and on 7 June 2020 Paul Meyer paid 12 euros"
    few = "12 15 Anna 7 9 Paul 4 8 what is the sum of all of 3 4 Maria 6 7 Otto 9 2 Emil"
    items = spark.createDataFrame([(1, named), (2, dense), (3, few), (4, "What is 5 + 7?")], "item_id long, text string")
    other = named.replace("Tom", "Eva").replace("Ann", "Max").replace("Bob", "Kim").replace("5", "6").replace("9", "8")
    texts = {
        1: named, 2: "We read this. " + other + " So it ends.", 3: dense, 4: "He said: " + dense + ".", 5: few,
        6: dense.replace("40", "41"), 7: "So what is 5 + 7? It is 12.", 8: "what is 5 + 8",
    }
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], SCHEMA)
    for vocabulary in (1 << 20, 0):
        got = {(r.doc_id, r.item_id) for r in templates.matches(docs, items, vocabulary_bytes=vocabulary).collect()}
        assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (7, 4)}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 0)], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert templates.decontaminate(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in templates.decontaminate(docs, items.limit(0)).collect()] == [False]


def test_window_hashes_tell_order():
    a = templates._hashes(np.array([5, 6, 7, 8]), 3)
    assert len(set(a.tolist()) | set(templates._hashes(np.array([6, 5, 7]), 3).tolist())) == 3


def test_plain_words_need_no_patterns(monkeypatch):
    """Letters with at most one mark take their form without the patterns, which would give the same."""
    plain = "Paris paris. twelve, Km! you? été; Ünit: A ªº İx".split()
    want = []
    for w in plain:  # a second mark is for the patterns
        token, flags, bare = templates._form(w + "'")
        want.append((token, flags, bare))
    monkeypatch.setattr(templates, "_EDGE", None)
    monkeypatch.setattr(templates, "_NUMBER", None)
    monkeypatch.setattr(templates, "_ENDS", None)
    assert [templates._form(w) for w in plain] == want


def test_forgotten_words_get_their_form_again(monkeypatch):
    texts = ["The train to Paris takes 12 hours.", "", "In Paris the 5 trains take hours, he said"] * 3
    want = [templates._words_of(t, templates._Forms())[1].tolist() for t in texts]
    monkeypatch.setattr(templates, "REMEMBERED", 5)
    forms = templates._Forms()
    assert [templates._words_of(t, forms)[1].tolist() for t in texts] == want
    assert len(forms) <= 5 + 9


def test_windows_of_many_texts_are_cut_at_once(monkeypatch):
    """Texts of a batch share one pass; what one says of its ends, names and numbers does not reach the next."""
    rng = random.Random(5)
    some = ["The", "John", "Smith", "3", "5.", "km", "--", ".", "dog", "Ann,", "x", "\n", "$5"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(200)]
    lengths = SimpleNamespace(value={templates.INNER: [3, 1], templates.OPENING: [3], templates.PLAIN: [2]})

    def cut(ids, of):
        batch = pa.record_batch({"doc_id": ids, "text": of})
        found = templates._windows([batch], 3, 1, ("doc_id",), None, lengths)
        return sorted(str(row) for b in found for row in b.to_pylist())

    alone = sorted(row for k, t in enumerate(texts) for row in cut([k], [t]))
    passes, usable = [], templates._usable
    monkeypatch.setattr(templates, "_usable", lambda *a: passes.append(1) or usable(*a))
    assert cut(list(range(200)), texts) == alone and len(alone) > 1000
    assert len(passes) == 4
