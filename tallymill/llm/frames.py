"""Small helpers that all operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package's source to the session's Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns that an operator needs, so that other columns cannot clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into pieces of at most ``rows`` rows and about ``size`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * size / max(batch.nbytes, 1))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def strings(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
