"""Records of large text files whose separators may also stand inside records, read by many tasks per file.

A file is cut at every separator by Spark's text source, in as many byte ranges as it has splits. A range does not know
whether it starts inside a quoted value (or how deep in brackets), so a first pass folds each range's pieces from both
possible states; the small results compose along the file and give every range its true start. A second pass cuts the
records; only what crosses a range's ends is put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.sources.work import settle

#: (text, inside a quoted value) -> (inside at its end, change of depth)
Step = Callable[[str, bool], tuple[bool, int]]

_CSV_REST = re.compile(r'(?:[^"]|"")*"(?!")')
_JSON_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def csv_step(line: str, inside: bool) -> tuple[bool, int]:
    """A quote opens a value only where the value starts; two inside it are one of its characters."""
    at = 0
    if inside:
        rest = _CSV_REST.match(line)
        if rest is None:
            return True, 0
        at = line.find(",", rest.end()) + 1
        if not at:
            return False, 0
    while True:
        start = len(line) - len(line[at:].lstrip(" \t"))
        if line[start : start + 1] == '"':
            rest = _CSV_REST.match(line, start + 1)
            if rest is None:
                return True, 0
            start = rest.end()
        at = line.find(",", start) + 1
        if not at:
            return False, 0


def json_step(piece: str, inside: bool) -> tuple[bool, int]:
    if inside:
        rest = _JSON_REST.match(piece)
        if rest is None:
            return True, 0
        piece = piece[rest.end() :]
    if '"' in piece:
        piece = _JSON_STRING.sub("", piece)
    piece, quote, _ = piece.partition('"')
    return bool(quote), piece.count("[") + piece.count("{") - piece.count("]") - piece.count("}")


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Runs of rows of one byte range, in the order in which a task reads them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("file").to_pylist(), batch.column("range").to_pylist()))
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            yield keys[at], batch.slice(at, end - at)
            at = end


def _folded(batches: Iterable[pa.RecordBatch], step: Step, plain: str | None) -> Iterator[pa.RecordBatch]:
    """Per range its end state and change of depth, from either start state. Pieces without ``plain`` change nothing."""
    own, states = None, None

    def made():
        columns = [[own[0]], [own[1]], *[[x] for state in states for x in state]]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        names = ["file", "range", "after_out", "depth_out", "after_in", "depth_in"]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=names)

    for key, run in _ranges(batches):
        if key != own:
            if own is not None:
                yield made()
            own, states = key, [(False, 0), (True, 0)]
        values = run.column("value")
        if plain is not None:
            values = values.filter(pc.match_substring(values, plain))
        for piece in values.to_pylist():
            ends = [step(piece, False), step(piece, True)]
            states = [(ends[s][0], d + ends[s][1]) for s, d in states]
    if own is not None:
        yield made()


def _starts(folded: DataFrame) -> DataFrame:
    """``inside`` and ``depth`` at the start of every range.

    A range either sets the state whatever it was, or keeps it, or flips it: the state before a range is the last one
    that was set, flipped as often as flips followed.
    """
    order = W.partitionBy("file").orderBy("range")
    sets = F.col("after_out") == F.col("after_in")
    flips = F.when(~sets & F.col("after_out"), 1).otherwise(0)
    counted = folded.withColumn("flips", F.sum(flips).over(order))
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(sets, F.struct("after_out", "flips")), ignorenulls=True).over(earlier)
    known = counted.withColumn("last", last).withColumn("before", F.lag("flips", 1, 0).over(order))
    odd = (F.col("before") - F.coalesce(F.col("last.flips"), F.lit(0))) % 2 == 1
    known = known.withColumn("inside", F.coalesce(F.col("last.after_out"), F.lit(False)) != odd)
    change = F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out"))
    depth = F.coalesce(F.sum(change).over(earlier), F.lit(0))
    return known.select(F.col("file").alias("f"), F.col("range").alias("r"), "inside", depth.alias("depth"))


#: What a row of the second pass is: a whole record, the end of an earlier range's, the begin of one that goes on.
WHOLE, HEAD, TAIL = range(3)


def _cut(batches: Iterable[pa.RecordBatch], step: Step, plain: str | None, separator: str, level: int) -> Iterator[pa.RecordBatch]:
    """Records and what crosses the range's ends. A record ends where no value is open and the depth is ``level`` or less."""
    own, inside, depth, parts, cut_yet, out = None, False, 0, [], True, []

    def close(kind):
        out.append((own[0], own[1], kind, separator.join(parts), depth))
        parts.clear()

    def made():
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["file", "range", "kind", "text", "depth"])
        out.clear()
        return batch

    for key, run in _ranges(batches):
        if key != own:
            if parts:
                close(TAIL if cut_yet else HEAD)
            own = key
            inside, depth = run.column("inside")[0].as_py(), run.column("depth")[0].as_py()
            # a start inside a record: what comes first belongs to it
            cut_yet = not inside and depth <= level
        for piece in run.column("value").to_pylist():
            parts.append(piece)
            if plain is None or plain in piece:
                inside, change = step(piece, inside)
                depth += change
            if not inside and depth <= level:
                close(WHOLE if cut_yet else HEAD)
                cut_yet = True
        yield made()
    if parts:
        close(TAIL if cut_yet else HEAD)
    yield made()


def read_records(spark: SparkSession, path: str, separator: str, step: Step, plain: str | None = None, level: int = 0) -> DataFrame:
    """``file`` (a hash of its path), ``range`` (its first byte), ``text``, the ``depth`` after it and ``place``, which
    orders a range's records."""
    raw = spark.read.option("lineSep", separator).text(path)
    pieces = raw.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value"
    )
    schema = "file long, range long, after_out boolean, depth_out long, after_in boolean, depth_in long"
    folded = settle(pieces.mapInArrow(lambda b: _folded(b, step, plain), schema), "ranges")
    starts = settle(_starts(folded), "range-starts")
    # one row of 25 bytes per byte range of a file: 20 MB for 100 TB in ranges of 128 MB
    here = (F.col("file") == F.col("f")) & (F.col("range") == F.col("r"))
    placed = pieces.join(F.broadcast(starts), here, "left")
    checked = F.when(F.col("f").isNull(), F.raise_error(F.lit("the files' ranges changed between two reads"))).otherwise(F.col("inside"))
    cut = placed.select("file", "range", "value", checked.alias("inside"), "depth").mapInArrow(
        lambda b: _cut(b, step, plain, separator, level), "file long, range long, kind int, text string, depth long"
    )
    cut = settle(cut.withColumn("place", F.monotonically_increasing_id()), "records")
    crossing = cut.filter(F.col("kind") != WHOLE)
    # per file at most two rows of each range; a range's end of an earlier record comes before its own unended one
    order = W.partitionBy("file").orderBy("range", "kind")
    grouped = crossing.withColumn("n", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order))
    lists = F.sort_array(F.collect_list(F.struct("range", "kind", "text", "depth", "place")))
    whole = grouped.groupBy("file", "n").agg(lists.alias("l")).select(
        "file", F.col("l")[0]["range"].alias("range"), F.array_join(F.col("l.text"), separator).alias("text"),
        F.try_element_at("l", F.lit(-1))["depth"].alias("depth"), F.col("l")[0]["place"].alias("place"),
    )
    return cut.filter(F.col("kind") == WHOLE).select(*whole.columns).unionByName(whole)


def first_of_each_file(records: DataFrame) -> DataFrame:
    """``file``, ``range`` and ``place`` of the first record of every file."""
    least = F.min(F.struct("range", "place")).alias("m")
    return records.filter("range = 0").groupBy("file").agg(least).select("file", "m.*")
