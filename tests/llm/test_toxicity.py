"""Toxicity: accuracy on held-out rows, defined cases."""

import os
import random
import zlib

import pytest
from corpora import SCHEMA, words, with_clashes

from tallymill.llm import toxicity

SMALL = "/root/testdata/sf0.1"


def corpus(n=500):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        text = words(rng, rng.randrange(20, 120)).split()
        toxic = k % 5 == 0
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grimble", "Slorch!", "vorkish", "grimbling"]))
        docs.append((k, " ".join(text), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "grimble slorch vorkish the", "en", "s", 0), docs[0], docs[1]]
    labels += [(n, 1, None), (None, 1, 1), (3, 1, 0), (10**6, 0, 1)]
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = corpus()
    table = with_clashes(spark.createDataFrame(docs, SCHEMA), "score", "toxic", "held_out", "predicted", "of_doc")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(table, toxicity.fit(table, marks)).collect()
    assert len(got) == len(docs)
    truth = {d: t for d, _, t in labels if t is not None and d is not None}
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    tested = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in tested) / len(tested) > 0.97


def test_without_labels(spark):
    docs, _ = corpus(30)
    table = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(table, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.score_documents(table, model).collect()} == {0.0}
    assert toxicity.score_documents(table.limit(0), model).count() == 0
    assert toxicity.keep_clean(table, model).count() == len(docs)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = toxicity.score_documents(some, toxicity.fit(some, labels)).where("held_out").join(labels, "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    right = counts.get((1, 1), 0)
    # measured: recall 0.83, precision 0.94; some toxic labels of this table stand at texts without any such word
    assert right / (right + counts.get((1, 0), 0)) > 0.8 and right / (right + counts.get((0, 1), 0)) > 0.9
