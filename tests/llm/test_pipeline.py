"""The pipeline against the same steps by hand, on the smallest given tables."""

import os
import zlib

import numpy as np
import pytest
from corpora import with_clashes
from test_token_files import whole
from test_wide_simhash import classes_by_hand, shingles

import corpus_pipeline
from tallymill.llm import mixing, toxicity

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    scores = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    clean = sorted(r.doc_id for r in scores if r.predicted == 0)
    of = classes_by_hand([rows[d].text for d in clean])
    empty = [k for k, d in enumerate(clean) if not shingles(rows[d].text)]
    single = [d for k, d in enumerate(clean) if of[k] == k and k not in empty[1:]]

    def plain(text):
        return " ".join(text.lower().split())

    kept = [d for d in single if not any(plain(i) in plain(rows[d].text or "") for i in items)]
    mixed = sorted(mixing.mix(docs.where(docs.doc_id.isin(kept))).collect(), key=lambda r: (r.slot, r.place))
    start, want = 0, []
    for r in mixed:
        ids = whole(r.row.text or "") + [1]
        want.append((r.row.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    empty = [spark.createDataFrame([], s) for s in ("doc_id long, quality int, toxic int", "item_id long, text string")]
    import tempfile

    folder = tempfile.mkdtemp()
    empty[0].write.parquet(f"{folder}/labels.parquet")
    empty[1].write.parquet(f"{folder}/benchmark.parquet")
    docs = with_clashes(docs, "row", "copy", "__id", "component", "slot", "place", "first")
    columns = docs.columns
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == [4, 2, 2, 2]
