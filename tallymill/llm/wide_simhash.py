"""Near duplicates of a stated shingle similarity, by wide SimHash fingerprints.

The 64 bits of ``simhash`` separate exact from slightly changed copies. Two sets of similarity 0.8 differ in some 15 %
of a fingerprint's bits, which takes more of them: here every distinct shingle's hash is spread to ``BITS`` bits, and a
bit is set if over half of the shingles have it. Fingerprints that differ in ``most_bits`` or fewer bits are candidates,
confirmed on their full sets, so nothing below the asked similarity links.

Multi-index hashing: the fingerprint is cut into segments of 32 bits, and each is stored under all values of the Hamming
ball of radius one around it. Two fingerprints thus meet if some segment differs in at most two bits: always up to 23
differing bits (a similarity of about 0.92), with probability 0.96 at a similarity of 0.9 and 0.65 at 0.8 (chains of
copies reach further). Whole distances are verified for all that meet, before any text is read again.

Equal fingerprints are one node. Each value's bucket forms a star around its least node, first those of whole segments
(8 a node), then those of the balls, where only nodes of another component than the leader's are compared; what is left
are pairs of one bucket in different components so far, which go through blocks of bounded size. So a group of near
copies costs its nodes, not its pairs. At N nodes a bucket holds N * 264 / 2^35 unrelated nodes: under eight up to a thousand million.

Defined cases: a null text is empty; texts without words have no fingerprint and no class; repeated rows each get
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.components import components
from tallymill.llm.frames import documents, pieces, strings
from tallymill.llm.minhash import BLOCK, _around_leader, _blocks, _bridges, _cross, _known, _sets_of, _spread, shingle_set
from tallymill.sources.work import settle

WORDS = 4
BITS = 64 * WORDS
SEGMENTS = BITS // 32
#: Keys of one task, about.
KEYS = 1 << 20
_random = np.random.default_rng(20240917)
_FACTORS = _random.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def most_bits(percent: int) -> int:
    """Differing bits beyond which two sets of equal size hardly have this similarity: their angle's share of BITS, which
    is the average, and two standard deviations."""
    similarity = percent / 100
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(BITS * share + 2 * math.sqrt(BITS * share * (1 - share)))


def fingerprint(text: bytes, size: int = 5) -> bytes | None:
    """The fingerprint of a UTF-8 text; none without words."""
    values = shingle_set(text, size)
    if not len(values):
        return None
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(values), 8192):
        spread = _spread(values[at : at + 8192, None] * _FACTORS[None, :])
        counts += np.unpackbits(spread.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(values), bitorder="little").tobytes()


def _fingerprints(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = pa.array([fingerprint(t, size) for t in strings(batch.column("text"))], type=pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), found], names=["doc_id", "text_hash", "fp"])
    _known.clear()  # workers live on; later stages need the memory


def fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` of every document."""
    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(partial(_fingerprints, size=size), "doc_id long, text_hash long, fp binary")


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, WORDS)


def _stored(nodes: DataFrame, balls: bool) -> DataFrame:
    """``key`` and the columns of ``nodes`` but ``fp``: each node under its segments' values, or every value of their
    balls; the segment's number stands above it."""
    own = [c for c in nodes.columns if c != "fp"]
    value = lambda k: F.conv(F.hex(F.substring("fp", 4 * k + 1, 4)), 16, 10).cast("long")
    segments = F.explode(F.array(*[value(k) + F.lit(k << 32) for k in range(SEGMENTS)]))
    if not balls:
        return nodes.select(segments.alias("key"), *own)
    flips = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)]))
    return nodes.select(*own, segments.alias("segment")).select(*own, "segment", flips.alias("flip")).select(
        F.col("segment").bitwiseXOR(F.col("flip")).alias("key"), *own
    )


def met_in_buckets(nodes: DataFrame, balls: bool = True) -> DataFrame:
    """``leader`` and ``node`` of all nodes that share a bucket with a lesser one, its least node being the leader; if
    ``nodes`` have a ``label``, ``leader_label`` and ``label`` too.

    A node gives 264 keys, so tasks are cut by the number of keys, not by the few bytes of the nodes; the keys are
    shuffled once and sorted, as nearly all stand alone and an aggregate would only hold them in memory. A large group's
    keys are as many as any node's, so they lie on many tasks.
    """
    parts = max(1, -(-nodes.count() * SEGMENTS * (33 if balls else 1) // KEYS))
    nodes = nodes.select("node", "fp", *[c for c in nodes.columns if c == "label"])
    stored = _stored(nodes.repartition(parts, "node"), balls).repartition(parts, "key")
    up_to_here = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = {"node": "leader", "label": "leader_label"}
    own = [x for c in stored.columns if c != "key" for x in (F.first(c).over(up_to_here).alias(first[c]), F.col(c))]
    return stored.select(*own).where("node > leader").distinct()


def _near(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, rows=20_000):
        differ = np.bitwise_count(_words(batch.column("own")) ^ _words(batch.column("theirs"))).sum(axis=1, dtype=np.int64)
        yield batch.select(["leader", "node"]).filter(pa.array(differ <= most))


_LIVE = pa.schema([(c, pa.int64()) for c in ("leader", "node", "label")] + [(c, pa.int32()) for c in ("kind", "i", "j", "side")])


def _live(most: int, table: pa.Table) -> pa.Table:
    """The block's nodes that have a node of another component within ``most`` bits."""
    a, b, _ = _cross(table)
    words, labels = _words(table["fp"]), table["label"].to_numpy()
    differ = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(WORDS):
        differ += np.bitwise_count(words[a, k][:, None] ^ words[b, k][None, :])
    near = (differ <= most) & (labels[a][:, None] != labels[b][None, :])
    keep = np.unique(np.append(a[near.any(axis=1)], b[near.any(axis=0)]))
    return table.take(pa.array(keep, type=pa.int64())).select(_LIVE.names).cast(_LIVE)


def _stars(docs: DataFrame, nodes: DataFrame, met: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """Links of leaders with nodes that are near by distance and similar enough by their full sets."""
    own = nodes.select(F.col("node").alias("leader"), F.col("fp").alias("own"))
    theirs = nodes.select("node", F.col("fp").alias("theirs"))
    fps = met.join(own, "leader").join(theirs, "node").select("leader", "node", "own", "theirs")
    near = settle(fps.mapInArrow(partial(_near, most=most_bits(percent)), "leader long, node long"), "wide-near")
    sets = _sets_of(docs, nodes, near.select("node").union(near.select("leader")).distinct(), size)
    parts = near.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    parts = settle(parts, "wide-parts")
    dealt = near.join(parts, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    heads = parts.select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = dealt.union(heads).join(sets, "node")
    return rows.groupBy("leader", "part").applyInArrow(lambda t: _around_leader(percent, t), "a long, b long")


def classes(docs: DataFrame, nodes: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``node`` and ``root`` (of its component) of every row of ``nodes`` (``node``, ``fp``, ``doc_id``, ``text_hash``)."""
    same = settle(met_in_buckets(nodes, balls=False), "wide-same")
    stars = settle(_stars(docs, nodes, same, size, percent, block), "wide-stars")
    labels = components(stars).withColumnRenamed("root", "label")
    labelled = settle(nodes.join(labels, "node", "left").select("node", "fp", F.coalesce("label", "node").alias("label")), "wide-labelled")
    met = settle(met_in_buckets(labelled), "wide-met")
    apart = met.where("label != leader_label").select("leader", "node")
    more = settle(_stars(docs, nodes, apart, size, percent, block), "wide-more-stars")
    labels = settle(components(stars.union(more)), "wide-labels")

    # leaders that have met nodes of several components: by their labels so far, which are few, not by their nodes
    wider = labels.select(F.col("node").alias("label"), "root")
    roots = met.select("leader", "label").distinct().join(wider, "label", "left").select("leader", F.coalesce("root", "label").alias("root"))
    mixed = roots.groupBy("leader").agg(F.min("root").alias("least"), F.max("root").alias("last")).where("least < last")
    mixed = settle(mixed.select("leader"), "wide-mixed")
    labelled = nodes.join(labels.withColumnRenamed("root", "label"), "node", "left")
    labelled = settle(labelled.select("node", "fp", F.coalesce("label", "node").alias("label")), "wide-labelled")
    named = settle(met.select("leader", "node").join(mixed, "leader", "left_semi").join(labelled, "node", "left"), "wide-named")
    task, most = ["leader", "kind", "i", "j"], most_bits(percent)
    looked = _blocks(named, block, whole=True)
    live = looked.groupBy(*task).applyInArrow(lambda t: _live(most, t), "leader long, node long, label long, kind int, i int, j int, side int")
    live = settle(live, "wide-live")
    sets = _sets_of(docs, nodes, live.select("node").distinct(), size)
    bridges = live.join(sets, "node").groupBy(*task).applyInArrow(lambda t: _bridges(percent, t), "a long, b long")
    wider = components(bridges).select(F.col("node").alias("root"), F.col("root").alias("wider"))

    rooted = nodes.select("node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.join(wider, "root", "left").select("node", F.coalesce("wider", "root").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``component`` (a number of its class, null without words) of every document."""
    rows = settle(fingerprints(docs, size).withColumn("row_id", F.monotonically_increasing_id()), "wide-fingerprints")
    filled = rows.where(F.col("fp").isNotNull())
    heads = filled.groupBy("fp").agg(F.min("row_id").alias("row_id")).select("row_id")
    nodes = filled.join(heads, "row_id", "left_semi").select(F.col("row_id").alias("node"), "doc_id", "text_hash", "fp")
    nodes = settle(nodes, "wide-nodes")
    found = settle(classes(docs, nodes, size, percent, block), "wide-classes")
    named = settle(nodes.join(found, "node").select(F.col("fp").alias("of_fp"), "root"), "wide-named-fingerprints")
    joined = filled.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", "text_hash", F.col("root").alias("component"))
    return joined.union(rows.where(F.col("fp").isNull()).select("doc_id", "text_hash", F.lit(None).cast("long").alias("component")))
