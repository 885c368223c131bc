"""Token files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids.

A table of token files has one row per document: ``doc_id``, ``part`` (number of the range partition that wrote it),
``local_start`` (ids of that part before the document), ``n_tokens`` and ``ids``. Parts follow the order of the
documents, rows within a part too. The integer columns and the ids are stored as integer runs; every stripe is read by
itself, and a filter on ``doc_id`` skips stripes and row groups by their statistics and Bloom filters.

Defined cases: a null text is empty and gives the end id alone; a null id sorts first; repeated ids are kept, ordered
by their text; an empty table gives an empty folder of files that reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import compress
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.frames import documents, pieces

END_ID = 1
#: Words whose ids a Python worker remembers; then it forgets all but those of the texts at hand.
REMEMBERED = 600_000
#: The same of the lower-case letters of words and the marks after them.
REMEMBERED_STEMS = 300_000
FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"

# lines of composed letters of one case rule, that no normal form changes, and marks that open no contraction; others
_PLAIN = re.compile(r"^([A-Za-zÀ-ÖØ-öø-ÿ]+)[!-&(-/:-@\[-`{-~]*$|^.*$", re.MULTILINE)
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# how the byte-level rule writes each byte: those that are no printable characters of their own follow at 256
_ODD_BYTES = [*range(33), *range(127, 161), 173]
_BYTES = "".join("\n" if b == 10 else chr(256 + _ODD_BYTES.index(b)) if b in _ODD_BYTES else chr(b) for b in range(256))
_loaded: dict = {}


class _Encoder:
    """One tokenizer per Python worker, and its memory of words and of plain words' stems."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
        self.whole = Tokenizer.from_file(str(path))
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        rules = json.loads(Path(path).read_text())
        #: Plain words may be cut only if this is how the vocabulary treats them.
        plain = rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _PRE_TOKENIZER
        self.of_stems = self.whole.model if plain else None

    def _encoded(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word."""
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            found = self.whole.encode(some, is_pretokenized=True, add_special_tokens=False)
            cuts = np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(some) + 1))
            yield from _cut(found.ids, cuts)

    def _encoded_stems(self, stems: list[str]) -> Iterator[bytes]:
        """The same of lower-case letters, which the rules leave as they are: only the model is left to apply."""
        for at in range(0, len(stems), 2000):
            joined = "\n".join(stems[at : at + 2000])
            if not joined.isascii():
                joined = codecs.charmap_decode(joined.encode(), "strict", _BYTES)[0]
            found = list(map(self.of_stems.tokenize, joined.split("\n")))
            yield from _cut([token.id for tokens in found for token in tokens], np.cumsum([0, *map(len, found)]))

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the different words."""
        found = list(map(self.words.get, words))
        unknown = [k for k, ids in enumerate(found) if ids is None]
        if unknown:
            if len(self.words) + len(unknown) > REMEMBERED:
                self.words.clear()
                self.words.update((w, ids) for w, ids in zip(words, found) if ids is not None)
            new = [words[k] for k in unknown]
            self.learn(new)
            for k, ids in zip(unknown, map(self.words.__getitem__, new)):
                found[k] = ids
        return found

    def learn(self, words: list[bytes]) -> None:
        """Remembers the ids of new words."""
        joined = b"\n".join(words).decode("utf-8", "replace")
        if self.of_stems is None:
            self.words.update(zip(words, self._encoded(joined.split("\n"))))
            return
        plain, texts = _PLAIN.findall(joined), joined.split("\n")  # no letters for a word that is not plain
        odd = [not letters for letters in plain]
        self.words.update(zip(compress(words, odd), self._encoded(list(compress(texts, odd)))))
        marks = [text[len(letters) :] for text, letters in zip(texts, plain) if letters]
        if not marks:
            return
        # letters of these kinds stay as many when they are lower-cased
        letters = "\n".join(filter(None, plain)).lower().split("\n")
        stems, different = self.stems, (set(letters), set(marks))
        used = different[0] | different[1]
        if len(stems) + len(used.difference(stems)) > REMEMBERED_STEMS:
            kept = {x: stems[x] for x in used.intersection(stems)}
            stems.clear()
            stems.update(kept)
        new = list(different[0].difference(stems))
        stems.update(zip(new, self._encoded_stems(new)))
        new = list(different[1].difference(stems))
        stems.update(zip(new, self._encoded(new)))
        ids = map(add, map(stems.__getitem__, letters), map(stems.__getitem__, marks))
        self.words.update(zip(compress(words, plain), ids))


def _cut(ids: list[int], cuts: np.ndarray) -> Iterator[bytes]:
    raw, places = np.array(ids, dtype="<u4").tobytes(), (4 * cuts).tolist()
    return map(raw.__getitem__, map(slice, places, places[1:]))


def _remembered(vocabulary: str) -> _Encoder:
    if vocabulary not in _loaded:
        _loaded[vocabulary] = _Encoder(vocabulary)
    return _loaded[vocabulary]


def encode(texts: pa.Array, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one row, and where each text's ids end.

    The vocabulary never joins text across ASCII white space, so each word is encoded once and its ids are reused. It
    lower-cases, and keeps letters apart from punctuation, so plain words share the ids of their letters.
    """
    split = pc.ascii_split_whitespace(texts)  # white space at either end leaves an empty word, which has no ids
    words = split.flatten().dictionary_encode()
    ids = _remembered(vocabulary).ids_of(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    flat, first = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(sizes) - sizes
    words = words.indices.to_numpy()
    sizes = sizes[words]
    ends = np.append(0, np.cumsum(sizes))
    # each word's ids stand in ``flat`` as far from their place here as its first one does
    found = flat[np.repeat(first[words] - ends[:-1], sizes) + np.arange(ends[-1])]
    return found, ends[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))][1:]


def encode_texts(texts: list[bytes], vocabulary: str) -> list[bytes]:
    """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
    found, ends = encode(pa.array(texts, pa.binary()).view(pa.string()), vocabulary)
    return [x.tobytes() for x in np.split(found, ends[:-1])] if texts else []


def _encoder(vocabulary: str, end_id: int):
    def encode_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            found, ends = encode(batch.column("text"), vocabulary)
            ids = np.insert(found.astype(np.int32), ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            n = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(n), part, dtype=np.int32)),
                    pa.array(start + ends - n),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids)),
                ],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    return encode_all


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str = "word_bpe_49k.json",
    order: tuple[Column | str, ...] = ("doc_id",),
    end_id: int = END_ID,
    stripe_bytes: int = 16 << 20,
    index_rows: int = 1000,
) -> None:
    """Encodes every whole text, appends the end id and writes the files in the given order.

    Rows are range-partitioned on the order, so a part never needs more than its own rows.
    """
    named = {f"__o{k}": c if isinstance(c, Column) else F.col(c) for k, c in enumerate(order)}
    rows = documents(docs, *[c.alias(n) for n, c in named.items()])
    ordered = rows.repartitionByRange(*named, F.xxhash64("text")).sortWithinPartitions(*named, F.xxhash64("text"), "text")
    files = ordered.select("doc_id", "text").mapInArrow(_encoder(vocabulary, end_id), FILE_SCHEMA)
    (
        files.write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids = batch.column("ids")
        cuts = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("part"),
                batch.column("local_start"),
                pa.array(np.diff(cuts).astype(np.int64)),
                pa.array(crc, type=pa.int64()),
            ],
            names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
        )


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: place in the whole id sequence, number of ids and their checksum.

    Only one sum per part (a file) is put in order; documents add their place within the part.
    """
    from pyspark.sql import Window

    files = read_token_files(spark, path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = sums.select(
        F.col("part").alias("of"),
        F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    rows = files.mapInArrow(_checksums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(before, F.col("part") == F.col("of")).select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
