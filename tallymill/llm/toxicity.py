"""Toxicity by class-conditional Kneser-Ney models of spelling.

Two models of the letters of words, one per label, discount the counts of their own class and back off to one shared
model of shorter contexts, whose continuation counts come from both classes: a spelling that neither class has shown
often scores nearly the same under both. Words are compared by the difference of their two log-likelihoods, texts by
that difference per word, by their most toxic words and by their length; a logistic fit on labelled rows that the
models have not seen turns this into a score.

Models are fitted on a bounded sample: about ``per_class`` labelled rows of each label at most (all, if fewer), chosen
by hash, one of each text. Scoring covers every whole text.

Defined cases: a null text is empty (no words); a null id counts as the empty text for the held-out remainder and has no
label; several labels of an id count as toxic if one is; null labels are ignored; without usable labels of both
kinds every score is 0; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.frames import documents, pieces, remainder, strings
from tallymill.sources.work import settle

HELD_OUT = (4, 2)
THRESHOLD = 0.3
PER_CLASS = 20_000
ORDER = 5
DISCOUNT = 0.75
EDGES = ".,;:!?\"'()[]"
#: Distinct words a counter holds before it hands them on, and whose differences a worker remembers.
FLUSH = 400_000
CALIBRATION = (5, 0)


def words_of(text: bytes) -> list[str]:
    return [w for w in (t.strip(EDGES) for t in text.decode("utf-8", "replace").lower().split()) if w]


def grams_of(word: str, order: int = ORDER) -> list[str]:
    """A context of up to ``order - 1`` letters and the letter that follows; a space opens and ends the word."""
    padded = f" {word} "
    return [padded[max(0, k - order + 1) : k + 1] for k in range(1, len(padded))]


def _count_grams(batches: Iterable[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Numbers of texts' words per gram and label; a word counts once per text."""
    seen: tuple[Counter, Counter] = Counter(), Counter()

    def flushed():
        totals: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for label, counts in enumerate(seen):
            for word, n in counts.items():
                for gram in grams_of(word, order):
                    totals[gram][label] += n
            counts.clear()
        return pa.RecordBatch.from_pydict(
            {
                "gram": pa.array(list(totals), pa.string()),
                "ordinary": pa.array([v[0] for v in totals.values()], pa.int64()),
                "toxic": pa.array([v[1] for v in totals.values()], pa.int64()),
            }
        )

    for batch in pieces(batches):
        for text, label in zip(strings(batch.column("text")), batch.column("toxic").to_pylist()):
            seen[label].update(set(words_of(text)))
        if len(seen[0]) + len(seen[1]) > FLUSH:
            yield flushed()
    if seen[0] or seen[1]:
        yield flushed()


class Model:
    """Differences of log-likelihood per gram and, for letters that a context has not shown, per context."""

    def __init__(self, grams: list[tuple[str, int, int]], order: int = ORDER):
        self.order = order
        shared = _shared(list({g for g, _, _ in grams}))
        sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
        for gram, *counts in grams:
            of = sums[gram[:-1]]
            for label, n in enumerate(counts):
                of[label] += n
                of[2 + label] += n > 0

        def backoff(of, label):
            return DISCOUNT * of[2 + label] / of[label] if of[label] else 1.0

        self.of_gram: dict[str, float] = {}
        for gram, *counts in grams:
            of, low = sums[gram[:-1]], shared(gram)
            ordinary, toxic = (
                (max(n - DISCOUNT, 0) / of[label] if of[label] else 0.0) + backoff(of, label) * low
                for label, n in enumerate(counts)
            )
            self.of_gram[gram] = math.log(toxic / ordinary)
        self.of_context = {c: math.log(backoff(of, 1) / backoff(of, 0)) for c, of in sums.items()}
        self.weights = np.zeros(5)
        self.usable = False

    def difference(self, word: str) -> float:
        of_gram, of_context = self.of_gram, self.of_context
        total = 0.0
        for gram in grams_of(word, self.order):
            found = of_gram.get(gram)
            total += of_context.get(gram[:-1], 0.0) if found is None else found
        return total

    def features(self, words: list[str], known: dict[str, float]) -> list[float]:
        values = []
        for w in words:
            v = known.get(w)
            if v is None:
                if len(known) > FLUSH:
                    known.clear()
                known[w] = v = self.difference(w)
            values.append(v)
        if not values:
            return [0.0, 0.0, 0.0, 0.0]
        top = sorted(values)[-3:] if len(values) < 4000 else np.sort(np.partition(values, -3)[-3:]).tolist()
        # per word; the most toxic words; the length that the greatest of so many has to be held against
        return [sum(values) / len(values), top[-1], sum(max(t, 0) for t in top) / 3, math.log(len(values))]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(_with_one(features) @ self.weights, -35, 35)))


def _shared(grams: list[str]):
    """Probability of a gram's last letter after its context less one letter: interpolated continuation counts."""
    levels: list[dict[str, int]] = []
    types = set(grams)
    while types:
        follows = Counter(g[1:] for g in types if len(g) > 1)
        levels.append(follows)
        types = set(follows)
    counts: dict[str, int] = {}
    for level in levels:
        for gram, n in level.items():
            if gram:
                counts[gram] = max(counts.get(gram, 0), n)
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for gram, n in counts.items():
        sums[gram[:-1]][0] += n
        sums[gram[:-1]][1] += 1
    letters = len({g[-1] for g in grams}) + 1

    def probability(gram: str) -> float:
        if len(gram) == 1:
            total, kinds = sums.get("", (0, 0))
            base = 1 / letters
            return (max(counts.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * kinds * base) / total if total else base
        low = probability(gram[1:])
        total, kinds = sums.get(gram[:-1], (0, 0))
        return (max(counts.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * kinds * low) / total if total else low

    return lambda gram: probability(gram[1:] if len(gram) > 1 else gram)


def _with_one(features: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), features])


def _logistic(features: np.ndarray, labels: np.ndarray, steps: int = 40) -> np.ndarray:
    """Regularised logistic regression by Newton steps."""
    x = _with_one(features)
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], deviation[0] = 0, 1
    z = (x - mean) / deviation
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 0.1)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        slope = z.T @ (p - labels) + ridge * w
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    w = w / deviation
    w[0] -= float(w[1:] @ mean[1:])
    return w


def _measure(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in pieces(batches):
        found = [model.value.features(words_of(t), known) for t in strings(batch.column("text"))]
        yield pa.RecordBatch.from_pydict(
            {"features": pa.array(found, pa.list_(pa.float64())), "toxic": batch.column("toxic")}
        )


def _score(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in pieces(batches):
        found = np.array([model.value.features(words_of(t), known) for t in strings(batch.column("text"))])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.score(found))],
            names=["doc_id", "held_out", "score"],
        )


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, order: int = ORDER) -> Model:
    """The models and their calibration, from labelled rows outside the held-out remainder."""
    modulus, held = HELD_OUT
    marks = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("of_doc"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(remainder(F.col("of_doc"), modulus) != held)
    )
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 30
    place = F.pmod(F.xxhash64("of_doc"), F.lit(parts))
    keep = [int(min(1.0, per_class / max(sizes.get(k, 0), 1)) * parts) for k in (0, 1)]
    chosen = marks.where(place < F.when(F.col("toxic") == 1, keep[1]).otherwise(keep[0]))
    rows = documents(docs)
    # about twice ``per_class`` ids: with them beside the scan, no text but the sample's is shuffled
    sample = (
        rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("of_doc"))
        .groupBy(F.xxhash64("text").alias("text_hash"))
        .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    )
    sample = settle(sample.withColumn("cell", F.pmod("text_hash", F.lit(CALIBRATION[0]))), "toxicity-sample")
    learnt = sample.where(F.col("cell") != CALIBRATION[1]).select("text", "toxic")
    grams = (
        learnt.mapInArrow(partial(_count_grams, order=order), "gram string, ordinary long, toxic long")
        .groupBy("gram")
        .agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    )
    # grams of a bounded sample
    model = Model([(r[0], r[1], r[2]) for r in grams.orderBy("gram").collect()], order)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    measured = (
        sample.where(F.col("cell") == CALIBRATION[1]).select("text", "toxic")
        .mapInArrow(partial(_measure, model=sent), "features array<double>, toxic int").collect()
    )
    labels_seen = np.array([r["toxic"] for r in measured], dtype=float)
    if len(set(labels_seen.tolist())) == 2:
        model.weights = _logistic(np.array([r["features"] for r in measured]), labels_seen)
        model.usable = True
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    modulus, held = HELD_OUT
    rows = documents(docs).withColumn("held_out", remainder(F.col("doc_id"), modulus) == held)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(
        partial(_score, model=sent), "doc_id long, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _clean(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in pieces(batches):
        texts = batch.column("text").fill_null("")
        found = np.array([model.value.features(words_of(t), known) for t in strings(texts)])
        yield batch.filter(pa.array(model.value.score(found) < THRESHOLD))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, all columns, whose score stays below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_clean, model=sent), docs.schema)
