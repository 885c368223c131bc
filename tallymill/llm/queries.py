"""The registered queries of the training-data operators.

Each ``opN_<name>`` reads its whole table, applies its operator with production parameters and returns its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import (
    ball_tree,
    conversations,
    html_text,
    language_model,
    licences,
    minhash,
    mixing,
    repeats,
    simhash,
    templates,
    token_alignment,
    token_files,
    toxicity,
)
from tallymill.llm.conversation_sql import REPAIR
from tallymill.llm.frames import ship, table
from tallymill.sources.work import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return build(spark, folder)

    QUERIES[build.__name__] = run
    return build


@query
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path)
    return token_files.digest(spark, path)


@query
def op5_simhash_links(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op1_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = templates.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


@query
def op2_ball_tree_top5(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    vectors = rows.where(F.col("embedding").isNotNull() & finite).select("vec_id", whole.alias("vector"))
    return ball_tree.top_k(vectors, F.col("vec_id") % 50 == 0)


@query
def op4_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, carry=["doc_id", "source"]).select("row.doc_id", "row.source", "block", "slot", "place", "phase")


@query
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query
def op7_recurrent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_documents(table(spark, folder, "documents"))


@query
def op8_toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op9_long_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query
def op10_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


@query
def op11_minhash_links(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, folder, "conversations")))


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.digest(table(spark, folder, "documents"))


ORACLES["op2_ball_tree_top5"] = """
    WITH vectors AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs) WHERE place <= 5
"""

ORACLES["op11_minhash_links"] = r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents
    ), sets AS (
      SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s
      FROM words
    ), classes AS (
      SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY s
    ), shingles AS (SELECT c, n, unnest(s) AS h FROM classes
    ), pairs AS (
      SELECT a.c AS x, b.c AS y FROM shingles a JOIN shingles b ON a.h = b.h AND a.c < b.c
      GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ), edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
    ), reach AS (SELECT c AS x, c AS y FROM classes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
    ), least AS (SELECT r.x AS c, min(first) AS component_id FROM reach r JOIN classes k ON r.y = k.c GROUP BY r.x
    ), found AS (
      SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id
      FROM sets LEFT JOIN (SELECT s, component_id FROM classes JOIN least USING (c)) k ON sets.s = k.s
    )
    SELECT doc_id, n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM found
"""
ORACLES["op12_conversation_repair"] = REPAIR
