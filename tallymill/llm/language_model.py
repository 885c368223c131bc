"""Whole-document log-likelihoods under a gated recurrent language model.

1. Word counts of all training documents (map-side counters, one aggregate) give the base score and the classes. The
   ``heads * size`` most frequent words form the frequent classes; every other word, known or not, belongs to one of
   ``tails`` classes by its first bytes and shares its class by ``(count + 1) / (tokens + words + 1)``.
2. The network is trained on every training document once, in ``rounds``; in each, every partition trains on the
   documents whose hash falls to that round, and the partitions' weights are averaged by tokens, in two steps. A caller
   that cannot afford the pass may ask for a ``share`` of it.
3. Every document is scored whole, its state carried from window to window. Counts of at most ``remembered`` frequent
   words go to the workers (a bounded broadcast); all other words are joined with the counts by a shuffle.

Defined cases: a null text is empty and has the end token alone; a null id counts as the empty text for the held-out
remainder; repeated rows are scored (and counted) each; without training documents the base is ``log10(1)`` per token
and classes are uniform; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import recurrent
from tallymill.llm.frames import documents, pieces, remainder
from tallymill.sources.work import settle

#: Cannot be a word: words hold no white space.
END = b" "
HELD_OUT = (7, 2)
LOG10 = float(np.log(10))
GROUPS = 64
#: Tokens of a text that one row of the trainer takes; scoring does not cut.
PART = 512


def tail_class(word: bytes, tails: int) -> int:
    return zlib.crc32(word[:3]) % tails


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, lower-cased, with the end token as the last; the word's number of every token,
    each text's end included; and where each text's tokens end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    words, number = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
    ends = np.cumsum(pc.list_value_length(split).to_numpy())
    empty = pc.index(words, b"").as_py()
    if empty >= 0:  # white space at either end of a text, or no word
        kept = number != empty
        number, ends = number[kept], np.append(0, np.cumsum(kept))[ends]
    number = np.insert(number, ends, len(words))
    return pa.concat_arrays([words, pa.array([END], pa.binary())]), number, ends + np.arange(1, len(ends) + 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, rows=10_000):
        words, number, _ = _numbered(batch.column("text"))
        times = np.bincount(number)
        met = np.flatnonzero(times)
        yield pa.RecordBatch.from_pydict({"word": words.take(pa.array(met)), "n": pa.array(times[met], pa.int64())})


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (bytes; one space is the end token) and ``n`` over whole texts, ASCII letters lower-cased."""
    return texts.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words from a least count on, ``most`` at the most: the bound follows from numbers of words per step of the count."""
    step = F.floor(F.log2("n") * 8)
    left, least = most, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        left -= row["words"]
        if left < 0:
            break
        least = row["step"]
    if least is None:
        return []
    found = counts.where(step >= least).select("word", "n").collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in found), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """What workers need: symbols of the frequent words, counts of the remembered ones, classes' weights."""

    def __init__(self, top: list[tuple[bytes, int]], heads: int, size: int, tails: int, tail_counts: dict[int, tuple[int, int]]):
        self.heads, self.size, self.tails = heads, size, tails
        self.counts = dict(top)
        self.symbols = {w: k for k, (w, _) in enumerate(top[: heads * size])}
        rare = [heads * size + tail_class(w, tails) for w, _ in top[heads * size :]]
        #: Symbols and base sums in the order of ``counts``.
        self.symbol_of = np.array([*range(len(self.symbols)), *rare], dtype=np.int32)
        self.base_of = np.log10(np.array([n for _, n in top], dtype=float) + 1)
        sums = [tail_counts.get(k, (0, 0)) for k in range(tails)]
        self.tail_log = np.array([np.log10(n + v + 1) for n, v in sums])
        inner = np.zeros(heads * size)
        inner[: len(self.symbols)] = [n for _, n in top[: heads * size]]
        self.word_counts = inner.reshape(heads, size)
        self.class_counts = np.append(self.word_counts.sum(axis=1), [n + 1 for n, _ in sums])


class _Ranks(dict):
    """Ranks of the remembered words; of others ``-1 - class`` by their first bytes, kept by these."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(zip(vocabulary.counts, range(len(vocabulary.counts))))
        self.heads, self.tails = vocabulary.heads * vocabulary.size, vocabulary.tails
        self.symbol_of = np.append(vocabulary.symbol_of, np.int32(0))
        self.classes: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        first = word[:3]
        found = self.classes.get(first)
        if found is None:
            if len(self.classes) > 300_000:
                self.classes.clear()
            self.classes[first] = found = -1 - tail_class(word, self.tails)
        return found

    def symbols(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ranks and the symbols of tokens."""
        rank = np.fromiter(map(self.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        return rank, np.where(rank < 0, self.heads - 1 - rank, self.symbol_of[np.maximum(rank, 0)])


def _listed(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _tokens(text: bytes) -> list[bytes]:
    tokens = text.lower().split()
    tokens.append(END)
    return tokens


def _train(batches: Iterable[pa.RecordBatch], vocabulary, weights, settings: dict) -> Iterator[pa.RecordBatch]:
    ranks = _Ranks(vocabulary.value)
    trainer = recurrent.Trainer(weights.value, **settings)
    for batch in pieces(batches):
        words, number, ends = _numbered(batch.column("text"))
        texts = np.split(ranks.symbols(_listed(words))[1][number], ends[:-1])
        # parts of a long text train side by side
        trainer.add([t[at : at + PART] for t in texts for at in range(0, len(t), PART)])
    trainer.finish()
    if trainer.seen:
        values = trainer.w.flat().astype("<f4").tobytes()
        yield pa.RecordBatch.from_pydict({"seen": pa.array([float(trainer.seen)]), "weights": pa.array([values], pa.binary())})


def _average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0.0
    for batch in batches:
        for n, raw in zip(batch.column("seen").to_pylist(), batch.column("weights").to_pylist()):
            values = np.frombuffer(raw, dtype="<f4").astype(float) * n
            total = values if total is None else total + values
            seen += n
    if seen:
        mean = (total / seen).astype("<f4").tobytes()
        yield pa.RecordBatch.from_pydict({"seen": pa.array([seen]), "weights": pa.array([mean], pa.binary())})


def train(
    texts: DataFrame, vocabulary: Vocabulary, hidden: int = 16, rounds: int = 4, share: float = 1.0, rate: float = 0.01
) -> recurrent.Weights:
    """Rounds of local training and averaging; ``texts`` has ``doc_id`` and ``text`` of the training documents."""
    context = texts.sparkSession.sparkContext
    weights = recurrent.start(vocabulary.class_counts, vocabulary.word_counts, hidden)
    sent = context.broadcast(vocabulary)
    cells = max(rounds, round(rounds / share))
    cell = F.pmod(F.xxhash64("doc_id", "text"), F.lit(cells))
    kind = "seen double, weights binary"
    for k in range(rounds):
        now = context.broadcast(weights)
        settings = {"rate": rate * 0.6**k}
        trained = texts.where(cell == k).mapInArrow(partial(_train, vocabulary=sent, weights=now, settings=settings), kind)
        rows = trained.repartition(GROUPS).mapInArrow(_average, kind).collect()  # GROUPS rows at most
        if rows:
            share_of = np.array([r["seen"] for r in rows]) / sum(r["seen"] for r in rows)
            mean = sum(s * np.frombuffer(r["weights"], dtype="<f4").astype(float) for s, r in zip(share_of, rows))
            weights = weights.like(mean)
    return weights


def _score(batches: Iterable[pa.RecordBatch], vocabulary, weights) -> Iterator[pa.RecordBatch]:
    known: Vocabulary = vocabulary.value
    ranks = _Ranks(known)
    heads, base_of = known.heads * known.size, np.append(known.base_of, 0.0)
    # many texts at once, so that those of about the same length stand together
    for batch in pieces(batches, rows=8192):
        words, number, ends = _numbered(batch.column("text"))
        n_tokens = np.diff(ends, prepend=0)
        text = np.repeat(np.arange(len(ends)), n_tokens)
        # by word: base sum, part within a tail class
        rank, symbol = ranks.symbols(_listed(words))
        base = np.where(rank < 0, 0, base_of[np.maximum(rank, 0)])
        tail = symbol >= heads
        within = np.where(tail, base - known.tail_log[np.maximum(symbol - heads, 0)], 0)
        other = (rank < 0)[number]
        own = symbol[number]
        # words that are not remembered, and how often each text has them
        pairs, times = np.unique(text[other] * len(rank) + number[other], return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(len(ends) + 1) * len(rank))
        rest = pa.StructArray.from_arrays([words.take(pa.array(pairs % len(rank))), pa.array(times, pa.int64())], ["word", "times"])
        sums, within = (np.bincount(text, x[number], minlength=len(ends)) for x in (base, within))
        symbols = np.split(own, ends[:-1])
        network = recurrent.score(weights.value, symbols) / LOG10
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_tokens - np.bincount(text, other, minlength=len(ends)).astype(np.int64), pa.int64()),
                "sums": pa.array(sums, pa.float64()),
                "network": pa.array(network + within, pa.float64()),
                "rest": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rest),
            }
        )


def score_documents(
    docs: DataFrame,
    heads: int = 32,
    size: int = 32,
    tails: int = 64,
    remembered: int = 200_000,
    hidden: int = 16,
    rounds: int = 4,
    share: float = 1.0,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    if remembered < heads * size:
        raise ValueError("the frequent classes' words must be among the remembered ones")
    modulus, held = HELD_OUT
    rows = documents(docs).withColumn("held_out", remainder(F.col("doc_id"), modulus) == held)
    training = rows.where(~F.col("held_out"))
    counts = settle(word_counts(training), "word-counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    top = _most_frequent(counts, remembered)
    first_bytes = F.crc32(F.substring("word", 1, 3)) % tails
    tail_counts = {
        r["class"]: (r["n"], r["v"])
        for r in counts.groupBy(first_bytes.alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    }
    for word, n in top[: heads * size]:
        k = tail_class(word, tails)
        tail_counts[k] = tail_counts[k][0] - n, tail_counts[k][1] - 1
    vocabulary = Vocabulary(top, heads, size, tails, tail_counts)
    weights = train(training.select("doc_id", "text"), vocabulary, hidden, rounds, share)

    context = docs.sparkSession.sparkContext
    kind = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, sums double, network double, "
        "rest array<struct<word:binary,times:long>>"
    )
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(
        partial(_score, vocabulary=context.broadcast(vocabulary), weights=context.broadcast(weights)), kind
    )
    # the row's number is written with it, so it is the same for all later reads
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()), "network-scores")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    rare = counts.select(F.col("word").alias("of_word"), "n")
    added = (
        rest.join(rare, F.col("word") == F.col("of_word"))
        .groupBy(F.col("row").alias("of_row"))
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    per_token = float(np.log10(whole["tokens"] + whole["words"] + 1))
    return scored.join(added, F.col("row") == F.col("of_row"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(whole["tokens"]).cast("long").alias("train_tokens"),
        (F.col("sums") + more - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("network") + more).alias("score"),
    )
