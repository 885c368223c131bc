"""Removal of long byte strings that occur more than once in the corpus.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same document or another;
strings never cross documents. The work is dealt by content:

1. Every such string selects one of its grams, the leftmost with the smallest mixed hash. Neighbouring starts that
   select the same gram form a *window*; equal strings have the same gram at the same place in them.
2. One aggregate per gram tells grams met once (nothing repeats), grams whose windows are all equal (all of it
   repeats) and grams with different windows.
3. Different windows of such a gram go, once each with their number, to one block, where interval expansion on the
   block's Burrows-Wheeler transform finds the strings that start twice (``bwt``). Blocks are of bounded size: the
   windows of a frequent gram are dealt over several, each block hands on digests of its different strings, and one
   more aggregate joins them. Only strings of starts whose common core (the bytes that ``CORES`` neighbouring starts
   share) stands in another window too have a digest; that is one aggregate over a few cores per window.
4. The starts found go back to the windows' places, and each document drops what they cover.

Defined cases: a null text is empty and keeps nothing removed; texts shorter than ``length`` stay whole; repeated rows
are copies of each other like any other; null ids are allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.bwt import repeated_starts, runs
from tallymill.llm.frames import documents, pieces, strings
from tallymill.sources.work import settle

LENGTH = 400
#: Bytes of a gram; a window of ``LENGTH`` bytes holds ``LENGTH - GRAM + 1`` of them.
GRAM = 200
#: Bytes hashed at a time, and bytes of windows in one block of the transform.
CHUNK = 2 << 20
BLOCK = 1 << 20
#: Different windows of one gram beyond which they are dealt over several blocks.
SPREAD = 1000
#: Cores of such a window: its starts in this many groups, by their distance to the gram.
CORES = 8

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 2 * LENGTH)
        step = np.full(size, _BASE, dtype=np.uint64)
        step[0] = 1
        back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        back[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(step), np.cumprod(back)
        _powers["bytes"] = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    return _powers["up"], _powers["down"], _powers["bytes"]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at every position, from one running sum (integers wrap at 64 bits)."""
    up, down, values = _tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return _mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima within blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def windows_of(data: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """First start, number of starts, hash and place of the gram of every window in joined texts that end at ``ends``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < length:
        return none, none, none.astype(np.uint64), none
    hashes = gram_hashes(raw, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | place
    chosen = sliding_least(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)
    sizes = np.diff(np.append(0, ends))
    room = np.repeat(ends, sizes)[: len(chosen)] - np.arange(len(chosen))
    starts = np.flatnonzero(room >= length)
    if not len(starts):
        return none, none, none.astype(np.uint64), none
    chosen = chosen[starts].astype(np.int64)
    cuts = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    return starts[cuts], np.diff(np.append(cuts, len(starts))), hashes[chosen[cuts]], chosen[cuts]


def _chunks(texts: list[bytes], length: int, chunk: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, place in the text, bytes) in lists of about ``chunk`` bytes; long texts in parts that share their edges."""
    part, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), chunk):
            cut = text[at : at + chunk + length - 1]
            if size and size + len(cut) > chunk:
                yield part
                part, size = [], 0
            part.append((row, at, cut))
            size += len(cut)
    if part:
        yield part


def _windows(batches: Iterable[pa.RecordBatch], length: int, gram: int, chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        for part in _chunks(strings(batch.column("text")), length, chunk):
            data = b"".join(cut for _, _, cut in part)
            ends = np.cumsum([len(cut) for _, _, cut in part])
            first, count, grams, places = windows_of(data, ends, length, gram)
            if not len(first):
                continue
            last = (first + count + length - 1).tolist()
            content = np.fromiter(
                map(xxhash.xxh3_64_intdigest, map(data.__getitem__, map(slice, first.tolist(), last))),
                dtype=np.uint64,
                count=len(first),
            )
            of = np.searchsorted(ends, first, side="right")
            rows = pa.array(np.array([r for r, _, _ in part])[of])
            shift = np.array([a for _, a, _ in part]) - np.append(0, ends[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams.view(np.int64)),
                    pa.array(content.view(np.int64)),
                    batch.column("doc_id").take(rows),
                    batch.column("text_hash").take(rows),
                    pa.array(first + shift[of]),
                    pa.array(count.astype(np.int32)),
                    pa.array((places - first).astype(np.int32)),
                ],
                names=["gram", "content", "doc_id", "text_hash", "first", "starts", "place"],
            )


def _group_size(length: int, gram: int) -> int:
    """Starts per core, of the ``length - gram + 1`` distances between a start and its gram."""
    return max(1, -(-(length - gram + 1) // CORES))


def _cores(window: dict, data: bytes, length: int, group: int) -> list[dict]:
    """The bytes that all starts of a group share, at the same place relative to the gram in every window."""
    out = []
    place = window["place"]
    for k in range((place - window["starts"] + 1) // group, place // group + 1):
        low = place - group * k
        core = hashlib.blake2b(data[low : low + length - group + 1], digest_size=16, salt=k.to_bytes(4, "little")).digest()
        out.append({"k": k, "core": core})
    return out


def _cut(batches: Iterable[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ("gram", "content", "number", "spread", "place")
    group = _group_size(length, gram)
    for batch in pieces(batches, rows=200):
        found: list[tuple] = []
        for text, windows in zip(strings(batch.column("text")), batch.column("windows").to_pylist()):
            for w in windows:
                data = text[w["first"] : w["first"] + w["starts"] + length - 1]
                found.append((*[w[n] for n in names], data, _cores(w, data, length, group) if w["spread"] > 1 else []))
        columns = list(zip(*found)) if found else [()] * 7
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        cores = pa.list_(pa.struct([("k", pa.int32()), ("core", pa.binary())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (*types, cores))], names=[*names, "data", "cores"]
        )


_CUT = "gram long, content long, number long, spread int, place int, data binary, cores array<struct<k:int,core:binary>>"
_FOUND = "gram long, content long, low int, high int, digest binary, settled boolean"


class _Window(NamedTuple):
    gram: int
    content: int
    number: int
    spread: int
    place: int
    data: bytes
    share: int
    open: list


def _block(rows: list[_Window], length: int, group: int) -> pa.RecordBatch:
    """Starts that repeat in one block; of spread grams also a digest per different string that others may have."""
    marked, piece, start, twice = repeated_starts([r.data for r in rows], np.array([r.number for r in rows]), length)
    out = [(r.gram, r.content, a, b, None, True) for r, m in zip(rows, marked) for a, b in runs(m)]
    groups = [set(r.open or ()) for r in rows]
    for k, at, known in zip(piece.tolist(), start.tolist(), twice.tolist()):
        r = rows[k]
        if (r.place - at) // group in groups[k]:
            digest = hashlib.blake2b(r.data[at : at + length], digest_size=16).digest()
            out.append((r.gram, r.content, at, at, digest, known))
    names = ("gram", "content", "low", "high", "digest", "settled")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
    columns = list(zip(*out)) if out else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def _blocks(batches: Iterable[pa.RecordBatch], length: int, gram: int, block: int) -> Iterator[pa.RecordBatch]:
    """Collects the windows of whole grams (of one share of a spread gram) up to the size of a block."""
    rows: list[_Window] = []
    size, group = 0, _group_size(length, gram)
    for batch in pieces(batches):
        for row in map(_Window._make, zip(*[batch.column(c).to_pylist() for c in _Window._fields])):
            if size >= block and (row.gram, row.share) != (rows[-1].gram, rows[-1].share):
                yield _block(rows, length, group)
                rows, size = [], 0
            rows.append(row)
            size += len(row.data)
    if rows:
        yield _block(rows, length, group)


def _remove(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        spans_of = batch.column("ranges").to_pylist()
        n_bytes, n_removed, n_spans, kept_hash, kept_text = [], [], [], [], []
        for text, ranges in zip(strings(batch.column("text")), spans_of):
            spans: list[list[int]] = []
            for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high + length)
                else:
                    spans.append([low, high + length])
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(left))
            n_spans.append(len(spans))
            kept_hash.append(hashlib.sha256(left).hexdigest())
            kept_text.append(left)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_bytes, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array(kept_hash, pa.string()),
                pa.array(kept_text, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("text_hash", F.xxhash64("text"))


def _same_row(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["of_doc"]) & (left["text_hash"] == right["of_hash"])


def repeated_ranges(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, spread: int = SPREAD, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``low``, ``high``: runs of starts whose strings of ``length`` bytes repeat."""
    rows = _keyed(docs)
    schema = "gram long, content long, doc_id long, text_hash long, first long, starts int, place int"
    windows = settle(rows.mapInArrow(partial(_windows, length=length, gram=gram, chunk=chunk), schema), "windows")
    grams = (
        windows.groupBy("gram")
        .agg(F.count("*").alias("n"), F.min("content").alias("least"), F.max("content").alias("most"))
        .where("n > 1")
        .select(F.col("gram").alias("of_gram"), (F.col("least") != F.col("most")).alias("differ"))
    )
    # written, so that both sides of the join are plain shuffles, whose hot keys can be split; the same below
    grams = settle(grams, "repeated-grams")
    met = settle(windows.join(grams, F.col("gram") == F.col("of_gram")).drop("of_gram"), "met-windows")
    equal = met.where(~F.col("differ")).select(
        "doc_id", "text_hash", F.col("first").alias("low"), (F.col("first") + F.col("starts") - 1).alias("high")
    )

    differing = met.where("differ").drop("differ")
    distinct = differing.groupBy("gram", "content").agg(
        F.count("*").alias("number"),
        *[F.first(c).alias(c) for c in ("doc_id", "text_hash", "first", "starts", "place")],
    )
    distinct = settle(distinct, "different-windows")
    shares = distinct.groupBy(F.col("gram").alias("of_gram")).agg(F.ceil(F.count("*") / spread).cast("int").alias("spread"))
    wanted = (
        distinct.join(shares, F.col("gram") == F.col("of_gram"))
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"))
        .agg(F.collect_list(F.struct("gram", "content", "number", "spread", "first", "starts", "place")).alias("windows"))
    )
    # a row that is there twice is cut once
    sources = rows.join(wanted, _same_row(rows, wanted)).select("text", "windows")
    cut = settle(sources.mapInArrow(partial(_cut, length=length, gram=gram), _CUT), "cut-windows")
    cores = cut.where("spread > 1").select("gram", "content", F.explode("cores").alias("c")).select("gram", "content", "c.k", "c.core")
    shared = cores.groupBy(F.col("core").alias("of_core")).agg(F.count("*").alias("n")).where("n > 1")
    open_ = (
        cores.join(shared, F.col("core") == F.col("of_core"))
        .groupBy(F.col("gram").alias("g"), F.col("content").alias("c"))
        .agg(F.collect_set("k").alias("open"))
    )
    # of a spread gram, windows that occur once and share no core hold no repeat
    spread_windows = cut.where("spread > 1").drop("cores").join(open_, (F.col("gram") == F.col("g")) & (F.col("content") == F.col("c")), "left")
    spread_windows = spread_windows.drop("g", "c").where("open is not null or number > 1")
    alone = cut.where("spread = 1").drop("cores").withColumn("open", F.lit(None).cast("array<int>"))
    dealt = alone.unionByName(spread_windows).withColumn("share", F.pmod(F.col("content"), F.col("spread").cast("long")))
    blocks = dealt.repartition("gram", "share").sortWithinPartitions("gram", "share", "content")
    found = settle(blocks.mapInArrow(partial(_blocks, length=length, gram=gram, block=block), _FOUND), "found")

    digests = found.where("digest is not null")
    again = digests.groupBy(F.col("digest").alias("of_digest")).agg(F.count("*").alias("n")).where("n > 1")
    across = digests.where("not settled").join(again, F.col("digest") == F.col("of_digest"))
    marks = (
        found.where("digest is null").select("gram", "content", "low", "high")
        .union(across.select("gram", "content", "low", "high"))
        .groupBy(F.col("gram").alias("g"), F.col("content").alias("c"))
        .agg(F.collect_set(F.struct("low", "high")).alias("marks"))
    )
    marks = settle(marks, "marks")
    placed = differing.join(marks, (F.col("gram") == F.col("g")) & (F.col("content") == F.col("c"))).select(
        "doc_id", "text_hash", "first", F.explode("marks").alias("mark")
    )
    return equal.union(
        placed.select(
            "doc_id", "text_hash", (F.col("first") + F.col("mark.low")).alias("low"), (F.col("first") + F.col("mark.high")).alias("high")
        )
    )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, spread: int = SPREAD, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the ``kept`` bytes of every document.

    ``spread``: different windows of a gram per block; ``block``: bytes of a block; ``chunk``: bytes hashed at a time."""
    rows = _keyed(docs)
    ranges = (
        repeated_ranges(docs, length, gram, spread, block, chunk)
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"))
        .agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    )
    joined = rows.join(ranges, _same_row(rows, ranges), "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInArrow(partial(_remove, length=length), schema)
