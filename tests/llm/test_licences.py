"""Licence scans: known notices, excerpts, look-alikes, no Python on the executors."""

import random

from corpora import SCHEMA, with_clashes, words

from tallymill.llm import licences


def test_scan(spark):
    rng = random.Random(9)
    plain = [words(rng, 60) + "\n" + words(rng, 80) for _ in range(60)]
    apache = licences.TEMPLATES["Apache"].strip().split("\n")[3]
    cases = {
        100: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
        101: ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
        102: ("Licensed under the Apache License, Version 2.0.", "Apache"),
        103: ("Released under the MIT License.", "MIT"),
        104: (plain[0] + "\n" + apache[: len(apache) * 3 // 4] + "\n" + plain[1], "Apache"),
        105: ("Released under the MIT License.\nx\nLicensed under the Mozilla Public License, Version 2.0.", "MIT,MPL"),
        106: ("Permission was given by the mother of the child to play in the garden", ""),
        107: ("He had a license to drive and a copy of the book, the general said to the public", ""),
        108: (None, ""),
        109: ("", ""),
    }
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(plain)] + [(k, t, "en", "s", 0) for k, (t, _) in cases.items()]
    rows += [(None, cases[103][0], "en", "s", 0), rows[-7], rows[-7]]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA), "family", "terms", "number", "words", "line", "label", "probability")
    found = licences.scan(docs)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        want = "MIT" if r.doc_id is None else cases.get(r.doc_id, (None, ""))[1]
        assert r.families == want, (r, want)
        assert all(licences.LEAST_PROBABILITY <= x.probability <= 1 for x in r.licences)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_every_ordinary_paragraph_is_learnt(spark):
    """Training counts all paragraphs of all documents, more than a sample of 2,000 documents would hold."""
    rng = random.Random(5)
    rows = [(k, f"the software number {words(rng, 2)}\n{words(rng, 4)}\n\nMIT License\nReleased under CC0 1.0 Universal.", "en", "s", 0) for k in range(6000)]
    known = licences.templates(spark)
    judged, plain = licences.featured(spark.createDataFrame(rows, SCHEMA), licences.vocabulary_of(known))
    sets = licences.ordinary_sets(judged, known).collect()
    # the third line is marked by its words, the fourth is a template
    assert {tuple(r.terms) for r in sets} == {("software", "the software")}
    assert sum(r.learnt + r.kept_back for r in sets) == 6000
    assert judged.count() == 18000
    assert 4000 < plain < 5000 and 4000 < sum(r.learnt for r in sets) < 5000


def test_empty(spark):
    assert licences.scan(spark.createDataFrame([], SCHEMA)).count() == 0
