"""Benchmark decontamination by templates: questions whose numbers, names or units were exchanged are found too.

Words become canonical tokens: numbers, names (capitalised within a sentence; neighbours are one name) and units after
numbers become typed placeholders, all else its lower-case form without punctuation at its ends. Windows of ``window``
tokens are joined with the benchmark's by hash. Matches of a document and an item count on one diagonal (the same
distance between both places), and the values in aligned placeholders must map one to one: a question with other
numbers keeps that, a text that merely has the same shape rarely does.

Three forms of a text are compared, each with the same form: names within sentences as above; the words that open
sentences as names too, unless they are function words (for items that have such words); and, for items whose
placeholders leave no window with ``literals`` other tokens, the plain words, all of which must be met.

The benchmark's words go to the workers only if the benchmark has at most ``vocabulary_bytes`` bytes (its size is
summed first); they spare windows that hold a word no item has. Beyond that size all windows are joined.

Defined cases: null texts are empty; items without a usable window match nothing if they have fewer than ``literals``
words or numbers only; an item shorter than a window is one window; null ids are kept (as documents) and ignored
(as items); repeated rows each get their row; an empty benchmark marks nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.frames import documents, pieces, strings
from tallymill.sources.work import settle

WINDOW = 8
#: Tokens of a window that must be no placeholders.
LITERALS = 5
#: Windows of one diagonal that make a match (all usable ones, if the item has fewer): 13 tokens in a row.
MATCHES = 6
#: Least share of placeholder values that map one to one.
CONSISTENT = 0.75
VOCABULARY_BYTES = 32 << 20

NUMBER, NAME, UNIT = 1, 2, 3
# fixed values: words for numbers, and units
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers"
    " kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons ounce ounces pound pounds ml l liter"
    " liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month"
    " months year years k c f degree degrees percent % $ € £ dollar dollars cent cents euro euros usd eur gbp mph kph kb"
    " mb gb tb w kw j cal kcal hz v".split()
)
# fixed values: words that open sentences and are no names
OPENERS = frozenset(
    "a about after all although an and another any are as assume at because before both but by calculate can compute"
    " consider could determine did do does during each either estimate evaluate every explain express few find first for"
    " from give given had has have he her here his how however i if in into is it its let many more most my next no not now"
    " of on once one only or other our over she should show simplify since so solve some state suppose than that the their"
    " then there these they this those though thus to under until was we were what when where whether which while who whom"
    " whose why will with without would write yet you your".split()
)
_EDGE = re.compile(r"^[^\w$€£%]+|[^\w$€£%]+$")
_NUMBER = re.compile(r"([$€£]?)[+-]?\d+(?:[.,:/]\d+)*(%|[a-zA-Z]{1,3})?$")
_ENDS = re.compile(r"[.!?:]['\")\]]*$")
#: Different words whose form a worker remembers.
REMEMBERED = 500_000

# bits of a word's form, below its 56-bit hash
_CAPITAL, _STOPS, _IS_UNIT, _EMPTY, _IS_NUMBER, _OPENER = 1, 2, 4, 8, 16, 32
#: Forms of a text: names within sentences; names that open sentences too; plain words.
INNER, OPENING, PLAIN = 0, 1, 2


def _form(word: str) -> tuple[int, int, int]:
    """(token, flags, plain token) of one raw word, as far as it does not depend on its neighbours."""
    # most words are letters and at most one mark
    if word.isalpha():
        bare, flags, letters = word, 0, True
    elif word[-1] in ".,;!?:" and word[:-1].isalpha():
        bare, flags, letters = word[:-1], 0 if word[-1] in ",;" else _STOPS, True
    else:
        bare, flags, letters = _EDGE.sub("", word), _STOPS if _ENDS.search(word) else 0, False
    lower = bare.lower()
    # signs are plain words
    plain = max(xxhash.xxh64_intdigest((lower or word).encode()) >> 8, 4)
    if not bare:
        return 0, flags | _EMPTY, plain
    if lower in NUMBER_WORDS or not letters and _NUMBER.match(bare):
        return NUMBER, flags | _IS_NUMBER, plain
    if lower in UNITS:
        flags |= _IS_UNIT
    if lower in OPENERS:
        flags |= _OPENER
    if len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        flags |= _CAPITAL
    return plain, flags, plain


class _Forms(dict):
    """The number of each word met, by which its form stands in a table."""

    def __init__(self):
        super().__init__()
        self.table = array("q")

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.table.extend(_form(word))
        return number

    def of(self, words: list[str]) -> np.ndarray:
        """A row of token, flags and plain token for each word."""
        if len(self) > REMEMBERED:
            self.clear()
            self.table = array("q")
        numbers = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.frombuffer(self.table, dtype=np.int64).reshape(-1, 3)[numbers]


def _split(text: str) -> list[str]:
    """The words; a line's end is a sentence's."""
    return text.replace("\n", ".\n").split()


def _words_of(text: str, forms: _Forms) -> tuple[list[str], np.ndarray]:
    """The words, and the forms of each."""
    words = _split(text)
    return words, forms.of(words)


def _tokens_of(found: np.ndarray, form: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of one form of a text, and the place of each token's (first) word; ``of``: the text's number of each word,
    if there are several."""
    flags = found[:, 1]
    if form == PLAIN:
        # a line's end alone is no word
        kept = np.flatnonzero(flags & (_EMPTY | _STOPS) != _EMPTY | _STOPS)
        return found[kept, 2], kept
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.append(True, np.zeros(len(found) - 1, dtype=bool) if of is None else of[1:] != of[:-1])
    opens = begins | np.append(True, flags[:-1] & _STOPS != 0)
    if form == OPENING:
        opens &= flags & _OPENER != 0
    after_number = ~begins & np.append(False, flags[:-1] & _IS_NUMBER != 0)
    tokens = np.where((flags & _CAPITAL != 0) & ~opens, NAME, found[:, 0])
    tokens = np.where((flags & _IS_UNIT != 0) & after_number, UNIT, tokens)
    kept = np.flatnonzero(flags & _EMPTY == 0)
    tokens = tokens[kept]
    single = np.append(True, (tokens[1:] != NAME) | (tokens[:-1] != NAME))[: len(tokens)]
    if of is not None:
        single[1:] |= of[kept[1:]] != of[kept[:-1]]
    return tokens[single], kept[single]


def canonical(text: str, forms: _Forms) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Tokens, the place of each token's (first) word, and the words."""
    words, found = _words_of(text, forms)
    return *_tokens_of(found, INNER), words


def _usable(tokens: np.ndarray, form: int, size: int, window: int, literals: int, known: np.ndarray | None) -> np.ndarray:
    """The places of windows with enough literals, of ``known`` tokens only."""
    if size < 1 or len(tokens) < size:
        return np.zeros(0, np.int64)
    placeholder = tokens <= UNIT
    good = np.ones(len(tokens), dtype=bool)
    if known is not None and len(known):
        near = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        good = placeholder | (known[near] == tokens)
    good, literal = np.append(0, np.cumsum(good)), np.append(0, np.cumsum(~placeholder))
    least = 0 if form == PLAIN else min(literals, window)
    return np.flatnonzero((good[size:] - good[:-size] == size) & (literal[size:] - literal[:-size] >= least))


def _item_forms(found: np.ndarray, window: int, literals: int) -> list[int]:
    """The forms in which an item is looked for."""
    inner, opening = _tokens_of(found, INNER)[0], _tokens_of(found, OPENING)[0]
    forms = [INNER] if np.array_equal(inner, opening) else [INNER, OPENING]
    kept = [f for f in forms if len(_usable(t := (inner, opening)[f], f, min(window, len(t)), window, literals, None))]
    if kept:
        return kept
    plain = _tokens_of(found, PLAIN)[1]
    return [PLAIN] if len(plain) >= literals and (found[plain, 1] & (_IS_NUMBER | _EMPTY) == 0).any() else []


def _hashes(tokens: np.ndarray, window: int) -> np.ndarray:
    """One hash per window of tokens."""
    n = len(tokens) - window + 1
    total = np.full(n, window, dtype=np.uint64)
    for k in range(window):
        total = (total ^ tokens[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def _slot_values(tokens: np.ndarray, places: np.ndarray, ends: np.ndarray, words: list[str], starts: np.ndarray, size: int) -> list[list[str]]:
    """The values of the placeholders of each window, each with its type; names go on to ``ends``."""
    slots = np.flatnonzero(tokens <= UNIT)
    lasts = np.where(tokens[slots] == NAME, ends[slots], places[slots] + 1)
    first, last = np.searchsorted(slots, starts).tolist(), np.searchsorted(slots, starts + size).tolist()
    needed = np.zeros(len(slots) + 1, dtype=np.int64)
    np.add.at(needed, first, 1)
    np.add.at(needed, last, -1)
    values = [
        f"{kind} " + " ".join([_EDGE.sub("", w) for w in words[a:b]]).lower() if n else ""
        for kind, a, b, n in zip(tokens[slots].tolist(), places[slots].tolist(), lasts.tolist(), np.cumsum(needed).tolist())
    ]
    return [values[a:b] for a, b in zip(first, last)]


def _windows(
    batches: Iterable[pa.RecordBatch], window: int, literals: int, keys: tuple[str, ...], shared: object, lengths: object
) -> Iterator[pa.RecordBatch]:
    """Windows with their hash, place and placeholder values; ``shared``: sorted tokens that items have, by form;
    ``lengths``: sizes of windows by form, None for items."""
    forms = _Forms()
    known = {} if shared is None else shared.value
    for batch in pieces(batches, rows=500, size=2 << 20):
        rows, hashes, places, totals, kinds, slots = [], [], [], [], [], []
        split = [_split(text.decode("utf-8", "replace")) for text in strings(batch.column("text"))]
        words = list(chain.from_iterable(split))
        found = forms.of(words)
        cuts = np.append(0, np.cumsum([len(w) for w in split]))
        # all texts at once; items may differ in form and size
        of = np.repeat(np.arange(len(split)), np.diff(cuts))
        if lengths is None:
            asked = [(form, k) for k in range(len(split)) for form in _item_forms(found[cuts[k] : cuts[k + 1]], window, literals)]
        else:
            asked = [(form, None) for form in lengths.value]
        for form, k in asked:
            part = slice(None) if k is None else slice(cuts[k], cuts[k + 1])
            tokens, at = _tokens_of(found[part], form, of[part])
            own, at = of[part][at], at + (0 if k is None else cuts[k])
            ends = np.minimum(np.append(at[1:], len(words)), cuts[own + 1])
            for size in [min(window, len(tokens))] if lengths is None else lengths.value[form]:
                start = _usable(tokens, form, size, window, literals, known.get(form))
                start = start[own[start] == own[start + size - 1]]
                if not len(start):
                    continue
                # a form meets itself only
                hashes.append(_hashes(tokens, size)[start] ^ np.int64(form))
                rows.append(own[start])
                places.append(start - np.searchsorted(own, own[start]))
                totals.append(np.bincount(own[start])[own[start]])
                kinds.append(np.full(len(start), form))
                slots += [[]] * len(start) if form == PLAIN else _slot_values(tokens, at, ends, words, start, size)
        if not hashes:
            continue
        of = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column(k).take(of) for k in keys]
            + [
                pa.array(np.concatenate(hashes)),
                pa.array(np.concatenate(places)),
                pa.array(np.concatenate(totals)),
                pa.array(np.concatenate(kinds), pa.int32()),
                pa.array(slots, pa.list_(pa.string())),
            ],
            names=[*keys, "window", "place", "windows", "form", "slots"],
        )


def _item_tokens(batches: Iterable[pa.RecordBatch], window: int, literals: int, sizes: bool) -> Iterator[pa.RecordBatch]:
    """Tokens of the items by form, or their sizes, at most ``window``."""
    forms = _Forms()
    for batch in pieces(batches):
        kinds, values = [], []
        for text in strings(batch.column("text")):
            found = _words_of(text.decode("utf-8", "replace"), forms)[1]
            for form in _item_forms(found, window, literals):
                tokens = _tokens_of(found, form)[0]
                values.append(np.array([min(window, len(tokens))]) if sizes else np.unique(tokens))
                kinds.append(np.full(len(values[-1]), form))
        if values:
            of = [pa.array(np.concatenate(kinds), pa.int32()), pa.array(np.concatenate(values), pa.int64())]
            yield pa.RecordBatch.from_arrays(of, names=["form", "value"])


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    literals: int = LITERALS,
    least: int = MATCHES,
    consistent: float = CONSISTENT,
    vocabulary_bytes: int = VOCABULARY_BYTES,
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``item_id``, ``coverage`` (share of the item's usable windows met on one diagonal) and
    ``consistency`` of every document and item that match."""
    context = docs.sparkSession.sparkContext
    items = benchmark.where("item_id is not null").select(
        F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    of_items = partial(_item_tokens, window=window, literals=literals)
    shared = None
    if size <= vocabulary_bytes:
        # fewer than three times the bytes just summed
        found = items.mapInArrow(partial(of_items, sizes=False), "form int, value long").distinct().collect()
        known = {f: np.array(sorted(r["value"] for r in found if r["form"] == f), dtype=np.int64) for f in (INNER, OPENING, PLAIN)}
        shared = context.broadcast(known)
    # items shorter than a window are windows of their own size: at most ``window`` sizes of each form
    found = items.mapInArrow(partial(of_items, sizes=True), "form int, value long").distinct().collect()
    lengths = context.broadcast({f: sorted(r["value"] for r in found if r["form"] == f) for f in {r["form"] for r in found}})

    cut = partial(_windows, window=window, literals=literals)
    asked = items.mapInArrow(
        partial(cut, keys=("item_id",), shared=None, lengths=None),
        "item_id long, window long, place long, windows long, form int, slots array<string>",
    )
    asked = settle(asked.withColumnsRenamed({"window": "of_window", "place": "item_place", "slots": "item_slots"}), "item-windows")
    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    held = rows.mapInArrow(
        partial(cut, keys=("doc_id", "text_hash"), shared=shared, lengths=lengths),
        "doc_id long, text_hash long, window long, place long, windows long, form int, slots array<string>",
    ).drop("windows", "form")
    met = held.join(asked, F.col("window") == F.col("of_window")).where(F.size("slots") == F.size("item_slots"))
    diagonal = ["doc_id", "text_hash", "item_id", "windows", "form", (F.col("place") - F.col("item_place")).alias("diagonal")]
    on_one = met.groupBy(*diagonal).agg(
        F.count_distinct("item_place").alias("met"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))))).alias("pairs"),
    )
    n_pairs = F.size("pairs")
    sides = [F.size(F.array_distinct(F.col("pairs").getField(s))) for s in ("i", "d")]
    measured = on_one.select(
        "doc_id",
        "text_hash",
        "item_id",
        (F.col("met") / F.col("windows")).alias("coverage"),
        F.when(n_pairs == 0, 1.0).otherwise(F.least(*sides) / n_pairs).alias("consistency"),
        (F.col("met") >= F.when(F.col("form") == PLAIN, F.col("windows")).otherwise(F.least(F.lit(least), F.col("windows")))).alias("enough"),
    )
    return (
        measured.where(F.col("enough") & (F.col("consistency") >= consistent))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max("coverage").alias("coverage"), F.max("consistency").alias("consistency"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``doc_id``, ``text_hash``, ``contaminated``, ``items`` (sorted ids) and the greatest ``coverage`` of every document."""
    found = (
        matches(docs, benchmark, **settings)
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    )
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash"))
    return rows.join(found, same, "left").select(
        "doc_id",
        "text_hash",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )
