"""The corpus pipeline: toxic documents go, near duplicates give one document, contaminated documents go, sources are
mixed to target weights, and the rest becomes token files.

Each stage takes ``(spark, docs, folder)`` with the documents that the stage before kept, and returns documents with the
same columns; the last returns the digest of its files.

Defined cases: a null text is empty; an empty text is not toxic and holds no benchmark question; all texts without words
are one group of near duplicates, of which one document stays; of repeated rows one stays; a null id is an id of its own,
after all others; without labels nothing is toxic, without benchmark items nothing is contaminated; a null source is a
source; empty tables give no rows; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.llm import mixing, templates, token_files, toxicity, wide_simhash
from tallymill.llm.frames import ship, table
from tallymill.llm.keys import KEY, key_of, rows_with, with_key
from tallymill.sources.work import new_folder, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8: the one with the smallest id (of equal ids, the
    smallest hash). Texts without words are one group."""
    ship(spark)
    found = wide_simhash.near_duplicates(docs, size=5, percent=80)
    named = found.select(F.coalesce("component", F.lit(-1)).alias("component"), *key_of(F.col("doc_id"), F.col("text_hash")))
    first = F.min(F.struct("__no_id", "__id", "__text_hash")).alias("first")
    kept = named.groupBy("component").agg(first).select("first.*")
    once = Window.partitionBy(*KEY).orderBy(F.lit(1))
    unique = with_key(docs).withColumn("copy", F.row_number().over(once)).where("copy = 1")
    return unique.join(kept, KEY, "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark question."""
    ship(spark)
    found = templates.matches(docs, table(spark, folder, "benchmark"))
    return rows_with(docs, found.select(*key_of(F.col("doc_id"), F.col("text_hash"))).distinct(), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, stored in the mixed order: that of the written files' names and rows."""
    return mixing.in_mixed_order(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token files in the order in which the documents are stored, and their digest."""
    ship(spark)
    path = new_folder(spark, "token-files")
    token_files.write_token_files(docs, path, order=mixing.stored_order())
    return token_files.digest(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
#: Fingerprints' components, trained scores and schedules have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
