"""A key of document rows that is never null, for joins and windows that share one partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["__id", "__no_id", "__text_hash"]


def with_key(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) beside the key: id, whether it is null, hash of the text."""
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), *key_of(doc_id, F.xxhash64(text)))


def key_of(doc_id, text_hash) -> list:
    return [F.coalesce(doc_id, F.lit(0)).alias(KEY[0]), doc_id.isNull().alias(KEY[1]), text_hash.alias(KEY[2])]


def rows_with(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that have (``left_semi``) or have not (``left_anti``) a key in ``keys``."""
    return with_key(docs).join(keys, KEY, how).select("row.*")
