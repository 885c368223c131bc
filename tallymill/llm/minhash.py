"""MinHash near duplicates by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct word shingles. Its signature has ``POSITIONS`` symbols of 16 bits, each a hash of the
set's smallest value under one hash function; two sets of similarity J differ in about (1 - J) of the positions.
Signatures are cut into chunks of ``CHUNK`` symbols. By pigeonhole, of two signatures that differ in at most
``GUARANTEED`` positions (15 of 40) some chunk differs in at most one, so each chunk is stored under every choice of the
one symbol that may err, and equal keys meet. All pairs within that distance are found; a pair of similarity 0.85 is
missed only if all eight chunks err twice (probability 6e-7). Pairs that meet are confirmed on their full sets.

Equal sets are one node. Each key's bucket first forms a star around its least node, confirmed exactly. Nodes that share
a bucket share its leader, so what is left are pairs of one leader's nodes in different components so far: those go
through blocks of bounded size, the rest of a leader's nodes against its largest component and against each other.
A group of near copies thus costs its nodes once, not its pairs, as long as its members resemble the leaders.

Defined cases: a null text is empty; without words the set is empty, linked with nothing, and the component is the
document's own id; repeated rows each get their row; a component whose ids are all null has a null ``component_id`` and
nothing kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.components import components
from tallymill.llm.frames import documents, pieces, strings
from tallymill.sources.work import settle

CHUNKS, CHUNK = 8, 5
POSITIONS = CHUNKS * CHUNK
GUARANTEED = 2 * CHUNKS - 1
#: Signatures further apart than this are no pair: 0.85 lies six standard deviations below.
FAR = 20
#: Nodes of one side of a block.
BLOCK = 256
#: Words whose hash a Python worker remembers; then it forgets all and starts anew.
REMEMBERED = 500_000

_random = np.random.default_rng(20240501)
_FACTORS = _random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_known: dict[bytes, int] = {}


# ---- sets and signatures ----------------------------------------------------


def _spread(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit values so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * _ODD[2]
    x = (x ^ (x >> np.uint64(33))) * _ODD[3]
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, size: int = 3) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's word shingles; fewer words give one of all."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space
    if not words:
        return np.empty(0, dtype=np.uint64)
    new = set(words).difference(_known)
    if len(_known) + len(new) > REMEMBERED:
        _known.clear()
        new = set(words)
    for w in new:
        _known[w] = xxhash.xxh64_intdigest(w)
    hashes = np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        mixed = mixed * _ODD[k & 1] + hashes[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(_spread(mixed))


def signature(values: np.ndarray) -> np.ndarray:
    """The 16-bit symbols of a set that is not empty."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        np.minimum(least, (part[None, :] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1), out=least)
    return (_spread(least) >> np.uint64(48)).astype("<u2")


def _sign(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = [shingle_set(t, size) for t in strings(batch.column("text"))]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        signed = [signature(s).tobytes() if len(s) else None for s in sets]
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(map(len, sets), type=pa.int64())]
        columns += [pa.array(digests, type=pa.binary()), pa.array(signed, type=pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "digest", "signature"])


def signatures(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, and of sets with shingles ``digest`` and ``signature``."""
    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    schema = "doc_id long, text_hash long, n_shingles long, digest binary, signature binary"
    return rows.mapInArrow(partial(_sign, size=size), schema)


# ---- the index --------------------------------------------------------------


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Per signature (a row of symbols) the packed symbols of each chunk without one of them: CHUNKS x CHUNK keys."""
    parts = symbols.astype(np.uint64).reshape(-1, CHUNKS, CHUNK)
    keys = np.empty(parts.shape, dtype=np.uint64)
    for out in range(CHUNK):
        packed = np.zeros(parts.shape[:2], dtype=np.uint64)
        for k in range(CHUNK):
            if k != out:
                packed = (packed << np.uint64(16)) | parts[:, :, k]
        keys[:, :, out] = packed
    return keys.reshape(-1, CHUNKS * CHUNK).view(np.int64)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, POSITIONS)


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = CHUNKS * CHUNK
    for batch in pieces(batches, rows=5000):
        keys = chunk_keys(_symbols(batch.column("signature")))
        places = np.tile(np.arange(n, dtype=np.int32), len(keys))
        nodes = np.repeat(batch.column("node").to_numpy(), n)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(keys.ravel()), pa.array(nodes)], names=["place", "key", "node"])


def attempts(nodes: DataFrame) -> DataFrame:
    """``leader`` and ``node`` of all nodes that share a bucket with a lesser one, its least node being the leader."""
    stored = nodes.select("node", "signature").mapInArrow(_keys, "place int, key long, node long")
    least = stored.groupBy("place", "key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = settle(least, "buckets")
    met = stored.join(least, ["place", "key"]).where("node > leader")
    return met.select("leader", "node").distinct()


# ---- confirming on full sets ------------------------------------------------


def _close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, rows=20_000):
        near = (_symbols(batch.column("own")) != _symbols(batch.column("theirs"))).sum(axis=1) <= FAR
        yield batch.select(["leader", "node"]).filter(pa.array(near))


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = [shingle_set(t, size).tobytes() for t in strings(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, type=pa.binary())], names=["node", "members"])


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node`` and ``members`` (its set) of the wanted nodes, read again from the texts."""
    keys = nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))
    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash"))
    texts = rows.join(keys, same).select("node", "text").dropDuplicates(["node"])
    return settle(texts.mapInArrow(partial(_sets, size=size), "node long, members binary"), "sets")


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def _around_leader(percent: int, table: pa.Table) -> pa.Table:
    """The rows of one leader's share (its own set among them) whose sets are similar enough to the leader's."""
    nodes, sets = table["node"].to_numpy(), _arrays(table["members"])
    leader = table["leader"][0].as_py()
    at = int(np.flatnonzero(nodes == leader)[0])
    own, sizes = sets[at], np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    both = np.add.reduceat(hit, np.append(0, np.cumsum(sizes)[:-1]))
    good = (100 * both >= percent * (sizes + len(own) - both)) & (nodes != leader)
    return pa.table({"a": pa.array(np.full(good.sum(), leader, dtype=np.int64)), "b": pa.array(nodes[good])})


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Intersection sizes of every left with every right set, exact, as products of 0/1 matrices over shared values."""
    flat = [np.concatenate(x) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    shared = np.intersect1d(*[np.unique(f) for f in flat], assume_unique=True)
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(shared):
        return total
    places = []
    for f, r in zip(flat, rows):
        at = np.minimum(np.searchsorted(shared, f), len(shared) - 1)
        known = shared[at] == f
        at, r = at[known], r[known]
        order = np.argsort(at, kind="stable")
        places.append((at[order], r[order]))
    for start in range(0, len(shared), width):
        sides = []
        for (at, r), n in zip(places, (len(left), len(right))):
            a, b = np.searchsorted(at, [start, start + width])
            side = np.zeros((n, width), dtype=np.float32)
            side[r[a:b], at[a:b] - start] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total


def _cross(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of both sides of a block; a block of one part has it on both sides."""
    side = table["side"].to_numpy()
    if table["i"][0].as_py() == table["j"][0].as_py() and table["kind"][0].as_py() == 1:
        every = np.arange(len(side))
        return every, every, True
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


_LIVE = pa.schema([("leader", pa.int64()), ("node", pa.int64()), ("label", pa.int64())])


def _live(table: pa.Table) -> pa.Table:
    """The block's nodes that have a node of another component near in signature."""
    a, b, _ = _cross(table)
    if not len(a) or not len(b):
        return _LIVE.empty_table()
    symbols = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype="<u2").reshape(-1, POSITIONS)
    labels = table["label"].to_numpy()
    differ = np.zeros((len(a), len(b)), dtype=np.uint8)
    for k in range(POSITIONS):
        differ += symbols[a, k][:, None] != symbols[b, k][None, :]
    near = (differ <= FAR) & (labels[a][:, None] != labels[b][None, :])
    keep = np.unique(np.append(a[near.any(axis=1)], b[near.any(axis=0)]))
    return table.take(pa.array(keep)).select(_LIVE.names).cast(_LIVE)


def _bridges(percent: int, table: pa.Table) -> pa.Table:
    """Links between components of the block's nodes, as many as it takes to connect what is linked."""
    a, b, _ = _cross(table)
    found_a, found_b = [], []
    if len(a) and len(b):
        sets, labels = _arrays(table["members"]), table["label"].to_numpy()
        sizes = np.array([len(s) for s in sets], dtype=np.float32)
        both = common_counts([sets[k] for k in a], [sets[k] for k in b])
        good = 100 * both >= percent * (sizes[a][:, None] + sizes[b][None, :] - both)
        good &= labels[a][:, None] != labels[b][None, :]
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(good)):
            x, y = find(int(labels[a[i]])), find(int(labels[b[j]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                found_a.append(int(labels[a[i]]))
                found_b.append(int(labels[b[j]]))
    return pa.table({"a": pa.array(found_a, type=pa.int64()), "b": pa.array(found_b, type=pa.int64())})


def _blocks(members: DataFrame, block: int, whole: bool = False) -> DataFrame:
    """Deals each leader's nodes to blocks that bring every pair of different components together.

    The nodes of a leader's largest component (kind 0, side 0) meet the others (side 1); the others meet each other
    (kind 1). A leader's nodes that all have one label need no block. With ``whole``, up to twice ``block`` nodes, as many
    as two sides have, are one block, all as others.
    """
    shares = members.groupBy("leader", "label").agg(F.count("*").alias("n"))
    of = shares.groupBy("leader").agg(
        F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("total"), F.count("*").alias("labels")
    )
    parts = lambda n: F.ceil(n / F.lit(block)).cast("int")
    alone = F.lit(whole) & (F.col("total") <= 2 * block)
    of = of.where("labels > 1").select(
        "leader",
        F.when(~alone, F.col("main.label")).alias("main"),
        F.when(alone, 0).otherwise(parts(F.col("main.n"))).alias("main_parts"),
        F.when(alone, 1).otherwise(parts(F.col("total") - F.col("main.n"))).alias("rest_parts"),
    )
    placed = members.join(settle(of, "leaders"), "leader")
    of_rest = ~F.col("label").eqNullSafe(F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(of_rest, F.col("rest_parts")).otherwise(F.col("main_parts"))).cast("int")
    placed = placed.withColumn("own", own)
    others = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda kind, i, j, side: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side")
    )
    mine = F.col("own")
    with_main = F.transform(others("main_parts"), lambda k: task(0, k, mine, F.lit(1)))
    with_rest = F.transform(
        others("rest_parts"), lambda k: task(1, F.least(k, mine), F.greatest(k, mine), F.when(mine <= k, 0).otherwise(1))
    )
    with_others = F.transform(others("rest_parts"), lambda k: task(0, mine, k, F.lit(0)))
    tasks = F.when(of_rest, F.concat(with_main, with_rest)).otherwise(with_others)
    return placed.select(*members.columns, F.explode(tasks).alias("t")).select(*members.columns, "t.*")


def _confirmed_stars(docs: DataFrame, nodes: DataFrame, tried: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    own = nodes.select(F.col("node").alias("leader"), F.col("signature").alias("own"))
    theirs = nodes.select("node", F.col("signature").alias("theirs"))
    near = settle(tried.join(own, "leader").join(theirs, "node").mapInArrow(_close, "leader long, node long"), "near")
    sets = _sets_of(docs, nodes, near.select("node").union(near.select("leader")).distinct(), size)
    counts = near.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    counts = settle(counts, "star-parts")
    dealt = near.join(counts, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    heads = counts.select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = dealt.union(heads).join(sets, "node")
    return rows.groupBy("leader", "part").applyInArrow(lambda t: _around_leader(percent, t), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``component_id`` (the smallest id that links reach) of every document.

    Documents link where 100 times the intersection of their sets is at least ``percent`` times the union.
    """
    signed = settle(signatures(docs, size).withColumn("row_id", F.monotonically_increasing_id()), "signatures")
    filled = signed.where(F.col("digest").isNotNull())
    classes = settle(filled.groupBy("digest").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("first")), "classes")
    heads = classes.select(F.col("node").alias("row_id"))
    nodes = filled.join(heads, "row_id", "left_semi").select(F.col("row_id").alias("node"), "doc_id", "text_hash", "signature")
    nodes = settle(nodes, "nodes")
    tried = settle(attempts(nodes), "attempts")

    stars = settle(_confirmed_stars(docs, nodes, tried, size, percent, block), "stars")
    labels = settle(components(stars), "labels")

    named = tried.join(labels.withColumnRenamed("root", "label"), "node", "left")
    named = settle(named.select("leader", "node", F.coalesce("label", "node").alias("label")), "named")
    task = ["leader", "kind", "i", "j"]
    looked = _blocks(named, block).join(nodes.select("node", "signature"), "node")
    live = settle(looked.groupBy(*task).applyInArrow(_live, "leader long, node long, label long").distinct(), "live")
    sets = _sets_of(docs, nodes, live.select("node").distinct(), size)
    blocks = _blocks(live, block).join(sets, "node")
    bridges = blocks.groupBy(*task).applyInArrow(lambda t: _bridges(percent, t), "a long, b long")
    wider = components(bridges).select(F.col("node").alias("root"), F.col("root").alias("wider"))

    roots = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).join(wider, "root", "left")
    roots = settle(roots.select("digest", "first", F.coalesce("wider", "root").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    found = settle(roots.join(least, "root").select("digest", "component_id"), "components")
    # documents without words are spread by their id, not gathered under one null
    joined = filled.join(found, "digest").select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = signed.where(F.col("digest").isNull()).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone)
