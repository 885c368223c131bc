"""First copy per key, and what is already in the ledger.

Copies of a hot key are dropped before the shuffle (see ``pick``). Flagging all rows
joins on (key, sequence), which spreads the copies of one key evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import identity
from tallymill.operators.joins import attach
from tallymill.operators.pick import first_per_key
from tallymill.operators.validate import check_ingest, default_source
from tallymill.functions.period import period_start


def first_copies(df: DataFrame, order: list[str], key: str = "idempotency_key") -> DataFrame:
    """One row per key: the least by ``order``, which must not tie within a key unless the rows are equal."""
    return first_per_key(df, [key], order)


def with_keys(df: DataFrame, batch_key: str | None = None, batch: str = "batch_id", index: str = "seq") -> DataFrame:
    """Resolves ``idempotency_key``: own, else that of the batch, else generated.

    A batch key that several events of the batch would share gets ``:`` and the event's
    index, so it neither drops events nor makes one hot key.
    """
    own = identity.blank_to_null(F.col("idempotency_key"))
    generated = identity.idempotency_key()
    if batch_key is None:
        return df.withColumn("idempotency_key", F.coalesce(own, generated))
    uses = identity.blank_to_null(F.col(batch_key)).isNotNull() & own.isNull()
    sharing = df.groupBy(batch).agg(F.count_if(uses).alias("_sharing"))
    joined = attach(df, sharing, [batch], "left")
    suffixed = F.when(
        F.col("_sharing") > 1, F.concat_ws(":", F.col(batch_key), F.col(index).cast("string"))
    ).otherwise(F.col(batch_key))
    batch_value = F.when(identity.blank_to_null(F.col(batch_key)).isNotNull(), suffixed)
    return joined.withColumn(
        "idempotency_key", identity.resolve_key(F.col("idempotency_key"), batch_value, generated)
    ).drop("_sharing")


def insert_if_absent(
    batch: DataFrame, ledger: DataFrame | None, order: list[str], key: str = "idempotency_key"
) -> DataFrame:
    """The rows of the batch that enter the ledger."""
    first = first_copies(batch, order, key)
    return first if ledger is None else first.join(ledger.select(key), key, "left_anti")


def resolve_duplicates(batch: DataFrame, ledger: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Rows of the batch whose key is stored, with the stored row as ``stored``."""
    stored = ledger.select(key, F.struct(*[c for c in ledger.columns if c != key]).alias("stored"))
    return attach(batch, stored, [key], "inner")


def ingest(
    arrivals: DataFrame,
    now: Column,
    ledger: DataFrame | None = None,
    batch_key: str | None = None,
    order: tuple[str, ...] = ("inserted_at", "seq"),
) -> tuple[DataFrame, DataFrame]:
    """Checks, keys and deduplicates arrivals.

    Returns (accepted ledger rows, one result per arrival). ``seq`` identifies an arrival.
    """
    keyed = default_source(with_keys(check_ingest(arrivals, now), batch_key), "http")
    clean = keyed.filter(F.col("error").isNull())
    accepted = insert_if_absent(clean.drop("error"), ledger, list(order)).withColumn(
        "period_start", period_start(F.col("ts"))
    )
    # the results need the winners' numbers only, so their events are not shuffled a second time
    slim = clean.select("idempotency_key", "seq", *[c for c in order if c != "seq"])
    winners = insert_if_absent(slim, ledger, list(order)).select("idempotency_key", "seq", F.lit(True).alias("_won"))
    results = keyed.join(winners, ["idempotency_key", "seq"], "left").select(
        "seq",
        "tenant_id",
        "metric",
        "idempotency_key",
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("_won"), "accepted")
        .otherwise("duplicate")
        .alias("status"),
        "error",
    )
    return accepted, results


def ingest_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
