"""Alignment of two tokenizers' tokens over the same bytes, anchored at white space.

A text is encoded whole by a byte-level vocabulary (A, with one space before it) and by a piece vocabulary (B, which adds
that space itself). Where tokens of both end at one byte and space-marked tokens follow on both sides, the document is
cut: the token ids between two such anchors are a window, and since token bytes depend on ids alone, a window's
alignment is looked up by its two id tuples. Only windows not seen before are aligned, those of some hundred texts at once.

Where the vocabularies' rules begin anew at every single space between other characters, as those of the defaults do, a
text is its words: each is encoded and aligned once, many new ones at a time, and texts are put together from their
words' alignments. Texts with very long words, or with words that their tokens do not give back, are encoded whole.

Groups are the token runs between consecutive bytes where both sides end a token; links are the pairs of tokens whose
bytes overlap. How many documents hold an id pair linked is counted over all of them: distinct pairs per document are
stored with their multiplicities, counted by one aggregate, and joined back.

Defined cases: texts that are null or empty, or whose tokens' joined bytes differ from the space and the text, have no
tokens: zeros and empty groups; repeated rows are documents of their own; an empty table gives no rows; other columns
are ignored. Special tokens' strings are plain text. A window of any length is aligned; only those of up to
``MEMORABLE`` tokens are remembered.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.frames import documents, pieces
from tallymill.sources.work import new_folder, settle

#: Windows that a Python worker remembers; then it forgets all and starts anew.
REMEMBERED = 200_000
MEMORABLE = 64
#: The same of words, those encoded in one text, and the characters of a word that is still looked up as one.
REMEMBERED_WORDS = 300_000
TOGETHER = 50
LONGEST = 64
#: Id pairs whose counts are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 1_500_000
_loaded: dict = {}

#: Single spaces between characters that are neither white space nor the pieces' sign for it.
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


# ---- vocabularies -----------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of each id, their number, and whether they begin with a space; ``by_words``: no token or rule reaches
    across a single space between other characters, so a text's ids are those of its words."""

    def __init__(self, encode, tokens: list[bytes], by_words: bool):
        self.encode, self.tokens, self.by_words = encode, tokens, by_words
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.marked = np.array([t[:1] == b" " for t in tokens])


def _path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_vocabulary(name: str) -> Vocabulary:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_path(name))
    tokenizer.encode_special_tokens = True
    rules = json.loads(tokenizer.to_str())
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    by_words = (
        rules["normalizer"] is None
        and rules["pre_tokenizer"] == byte_level
        and rules["model"]["type"] == "BPE"
        and not rules["model"]["dropout"]
        and all(t["special"] for t in rules["added_tokens"])
    )
    letters = byte_letters()
    tokens = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return Vocabulary(encode, [bytes(letters[c] for c in t) if set(t) <= letters.keys() else t.encode() for t in tokens], by_words)


def _pieces_by_words(model) -> bool:
    """Only pair merges, no rewriting, and no piece with a space after another character."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # its rules cannot be read without protobuf
        return False
    rules = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    form, trained = rules.normalizer_spec, rules.trainer_spec
    return (
        trained.model_type == trained.BPE
        and not trained.treat_whitespace_as_suffix
        and not form.precompiled_charsmap
        and not form.remove_extra_whitespaces
        and form.add_dummy_prefix
        and form.escape_whitespaces
        and not any(re.search("[^▁]▁", p.piece) for p in rules.pieces)
    )


def piece_vocabulary(name: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=_path(name))
    tokens = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        raw = re.fullmatch("<0x([0-9A-F]{2})>", piece) if model.is_byte(k) else None
        tokens.append(bytes([int(raw[1], 16)]) if raw else piece.replace("▁", " ").encode())
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), tokens, _pieces_by_words(model))


# ---- one document -----------------------------------------------------------


def _distinct(*sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of windows that stand for all, and for each window its place among them. Windows are runs of ids on each
    side, given by their starts; equal hashes are compared id by id."""
    hashes = np.zeros(len(sides[0][1]) - 1, dtype=np.uint64)
    places = []
    for ids, starts in sides:
        sizes = np.diff(starts)
        place = np.arange(len(ids)) - np.repeat(starts[:-1], sizes)
        places.append((sizes, place))
        powers = np.cumprod(np.full(sizes.max(), 0x9E3779B97F4A7C15, dtype=np.uint64))
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(31)
        hashes = hashes * np.uint64(0xFF51AFD7ED558CCD) + np.add.reduceat(mixed * powers[place], starts[:-1])
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    for (ids, starts), (sizes, place) in zip(sides, places):
        same = first[which]
        if not (np.array_equal(sizes[same], sizes) and np.array_equal(ids[np.repeat(starts[same], sizes) + place], ids)):
            every = np.arange(len(hashes))
            return every, every
    return first, which


class Aligner:
    """Both vocabularies and the memory of windows: a text of groups and the bytes of links (``a << 32 | b``) each."""

    def __init__(self, byte_name: str, piece_name: str):
        self.a, self.b = byte_vocabulary(byte_name), piece_vocabulary(piece_name)
        # what an id writes inside and at the end of its group's side
        self.names = [np.array([f"{k}{end}" for k in range(len(v.tokens))], dtype=object) for v, end in zip((self.a, self.a, self.b, self.b), ",|,;")]
        #: By the ids of A, then those of B with their sign bit set: one sequence that has one reading.
        self.known: dict[bytes, tuple[str, bytes]] = {}
        #: Of words: numbers of tokens and groups, groups, links; None for a word that its tokens do not give back.
        self.words: dict[str, tuple[int, int, int, str, bytes] | None] = {}

    def windows(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> list[tuple[str, bytes]]:
        """The alignments of windows given one after the other, with their numbers of tokens of both sides."""
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        # groups: those before a token's own say where its text stands
        first_a = np.append(0, np.searchsorted(ends_a, shared, "right"))
        first_b = np.append(0, np.searchsorted(ends_b, shared, "right"))
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        words = np.empty(len(a) + len(b), dtype=object)
        last = shared[group_a] == ends_a
        words[np.arange(len(a)) + first_b[group_a]] = np.where(last, self.names[1][a], self.names[0][a])
        last = shared[group_b] == ends_b
        words[np.arange(len(b)) + first_a[group_b + 1]] = np.where(last, self.names[3][b], self.names[2][b])
        words = words.tolist()
        # links: between two consecutive ends of either side lies one pair
        every = np.union1d(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, every)].astype(np.int64) << 32 | b[np.searchsorted(ends_b, every)]
        links = links.tobytes()
        cuts = np.append(0, np.cumsum(sizes_a + sizes_b)).tolist()
        link_cuts = np.append(0, 8 * np.searchsorted(every, ends_a[np.cumsum(sizes_a) - 1], "right")).tolist()
        texts = ["".join(words[u:v])[:-1] for u, v in zip(cuts, cuts[1:])]
        return list(zip(texts, [links[u:v] for u, v in zip(link_cuts, link_cuts[1:])]))

    def _learned(self, keys: list[bytes]) -> dict[bytes, tuple[str, bytes]]:
        """Aligns new windows, all at once, and remembers those that are not long."""
        ids = np.frombuffer(b"".join(keys), dtype=np.uint32)
        of_b = ids >> np.uint32(31) == 1
        window = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys])
        sizes_b = np.bincount(window[of_b], minlength=len(keys))
        sizes_a = np.bincount(window[~of_b], minlength=len(keys))
        found = dict(zip(keys, self.windows(ids[~of_b], ids[of_b] & np.uint32(0x7FFFFFFF), sizes_a, sizes_b)))
        if len(self.known) + len(found) > REMEMBERED:
            self.known.clear()
        some = islice(((k, f) for k, f in found.items() if len(k) <= 4 * MEMORABLE), REMEMBERED)
        self.known.update(some)
        return found

    def _given_back(self, text: bytes, a_ids: list[int], b_ids: list[int]) -> bool:
        raw = b" " + text
        return all(b"".join(map(v.tokens.__getitem__, i)) == raw for v, i in ((self.a, a_ids), (self.b, b_ids)))

    def align(self, texts: list[bytes], a_lists: list[list[int]], b_lists: list[list[int]]) -> list:
        """Per text the numbers of its tokens and groups, its groups and all links; None if its tokens do not give it back."""
        out: list = [None] * len(texts)
        usable = []
        for k, (text, a_ids, b_ids) in enumerate(zip(texts, a_lists, b_lists)):
            if text and self._given_back(text, a_ids, b_ids):
                usable.append(k)
        if not usable:
            return out
        counts_a, counts_b = (np.array([len(x[k]) for k in usable]) for x in (a_lists, b_lists))
        a, b = (np.fromiter(chain.from_iterable(x[k] for k in usable), np.uint32, n.sum()) for x, n in ((a_lists, counts_a), (b_lists, counts_b)))
        # texts stand one after the other: each ends with tokens of both sides and the next begins with a space
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        met = np.searchsorted(ends_b, ends_a)
        shared = np.flatnonzero(ends_b[met] == ends_a)
        next_a, next_b = shared[:-1] + 1, met[shared[:-1]] + 1
        anchors = shared[np.append(np.flatnonzero(self.a.marked[a[next_a]] & self.b.marked[b[next_b]]), len(shared) - 1)]
        starts_a, starts_b = np.append(0, anchors + 1), np.append(0, met[anchors] + 1)
        first, which = _distinct((a, starts_a), (b, starts_b))
        cuts = [(4 * starts[first + k]).tolist() for starts in (starts_a, starts_b) for k in (0, 1)]
        bytes_a, bytes_b = a.tobytes(), (b | np.uint32(1 << 31)).tobytes()
        keys = [bytes_a[u:v] + bytes_b[x:y] for u, v, x, y in zip(*cuts)]
        found = list(map(self.known.get, keys))
        if None in found:
            new = self._learned(list({k for k, f in zip(keys, found) if f is None}))
            found = [f or new[k] for k, f in zip(keys, found)]
        pairs = np.empty((2, len(found)), dtype=object)
        pairs[0], pairs[1] = zip(*found)
        groups, links = pairs[0][which].tolist(), pairs[1][which].tolist()
        last_a = np.cumsum(counts_a) - 1
        n_groups = np.diff(np.searchsorted(shared, last_a, "right"), prepend=0).tolist()
        cuts = [0, *np.searchsorted(anchors, last_a, "right").tolist()]
        for k, n_a, n_b, n, u, v in zip(usable, counts_a.tolist(), counts_b.tolist(), n_groups, cuts, cuts[1:]):
            out[k] = n_a, n_b, n, ";".join(groups[u:v]), np.frombuffer(b"".join(links[u:v]), dtype=np.int64)
        return out

    def _of_words(self, words: list[str], together: int) -> dict[str, tuple[int, int, int, str, bytes] | None]:
        """The alignments of words, ``together`` of them in one text; its tokens are dealt by the words' bytes."""
        out: dict = {}
        some = [words[k : k + together] for k in range(0, len(words), together)]
        texts = [" ".join(x) for x in some]
        good, a_lists, b_lists = [], [], []
        for own, text, a_ids, b_ids in zip(some, texts, self.a.encode(texts), self.b.encode(texts)):
            if self._given_back(text.encode(), a_ids, b_ids):
                good += own
                a_lists.append(a_ids)
                b_lists.append(b_ids)
            else:
                out |= dict.fromkeys(own) if together == 1 else self._of_words(own, 1)
        if not good:
            return out
        a, b = (np.array(list(chain.from_iterable(x)), dtype=np.uint32) for x in (a_lists, b_lists))
        ends = np.cumsum([len(w.encode()) + 1 for w in good])
        sizes_a, sizes_b = (
            np.diff(np.searchsorted(np.cumsum(v.sizes[ids]), ends, "right"), prepend=0) for v, ids in ((self.a, a), (self.b, b))
        )
        found = self.windows(a, b, sizes_a, sizes_b)
        for word, n_a, n_b, (groups, links) in zip(good, sizes_a.tolist(), sizes_b.tolist(), found):
            out[word] = n_a, n_b, groups.count(";") + 1, groups, links
        return out

    def align_texts(self, texts: list[str]) -> list:
        """Encodes the texts and gives for each what ``align`` gives, from the alignments of its words if it can be cut."""
        split = [()] * len(texts)
        if self.a.by_words and self.b.by_words:
            split = [w if max(map(len, w)) <= LONGEST else () for w in map(_CUT.split, texts)]
        every = set().union(*split)
        new = every.difference(self.words)
        if len(self.words) + len(new) > REMEMBERED_WORDS:
            self.words.clear()
            new = every
        # only words that show no white space at their ends may stand beside others
        alone = [w for w in new if "▁" in w or not w or w[0].isspace() or w[-1].isspace()]
        self.words.update(self._of_words(alone, 1))
        self.words.update(self._of_words(list(new.difference(alone)), TOGETHER))
        out: list = [None] * len(texts)
        whole = []
        for k, words in enumerate(split):
            found = list(map(self.words.__getitem__, words))
            if not found or None in found:
                whole.append(k)
                continue
            n_a, n_b, n_groups, groups, links = zip(*found)
            out[k] = sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), np.frombuffer(b"".join(links), dtype=np.int64)
        left = [texts[k] for k in whole]
        for k, found in zip(whole, self.align([t.encode() for t in left], self.a.encode(left), self.b.encode(left))):
            out[k] = found
        return out


def _aligner(byte_name: str, piece_name: str) -> Aligner:
    """One per Python worker."""
    if (byte_name, piece_name) not in _loaded:
        _loaded[byte_name, piece_name] = Aligner(byte_name, piece_name)
    return _loaded[byte_name, piece_name]


# ---- all documents ----------------------------------------------------------

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def _aligned(batches: Iterable[pa.RecordBatch], byte_name: str, piece_name: str) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(byte_name, piece_name)
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    # windows are many small objects without cycles: the collector need not look after every few hundred of them
    gc.set_threshold(50_000, 20, 20)
    for batch in pieces(batches, rows=500, size=2 << 20):
        numbers, groups, pairs, times = [], [], [], []
        for found in aligner.align_texts(batch.column("text").to_pylist()):
            if found is None:
                numbers.append((0, 0, 0, 0))
                groups.append("")
                distinct = counts = np.empty(0, dtype=np.int64)
            else:
                n_a, n_b, n_groups, own, links = found
                numbers.append((n_a, n_b, n_groups, len(links)))
                groups.append(own)
                distinct, counts = np.unique(links, return_counts=True)
            pairs.append(distinct)
            times.append(counts)
        cuts = pa.array(np.append(0, np.cumsum([len(p) for p in pairs])).astype(np.int32))
        flat = np.array(numbers, dtype=np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *[pa.array(flat[:, k]) for k in range(4)],
                pa.array(groups, type=pa.string()),
                pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(pairs))),
                pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(times).astype(np.int32))),
            ],
            names=names,
        )


def alignments(docs: DataFrame, byte_name: str = "byte_bpe_50k.json", piece_name: str = "piece_bpe_32k.model") -> DataFrame:
    """Per document the numbers of tokens, groups and links, the ``groups`` (``a1,a2|b1;a3|b2,b3``), and its distinct
    linked id pairs (``a << 32 | b``) with how often each occurs."""
    return documents(docs).mapInArrow(lambda b: _aligned(b, byte_name, piece_name), ALIGNED)


def pair_counts(stored: DataFrame) -> DataFrame:
    """``pair``, ``held`` (documents that hold it linked) and ``best`` (1 if no pair of its A id is held by more)."""
    held = stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held"))
    # an A id has at most as many pairs as B has ids
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    return held.select("pair", "held", (F.col("held") == F.max("held").over(of_a)).cast("int").alias("best"))


def linked_counts(stored: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """``row_id``, ``n_best`` and ``count_sum`` over the links of each stored document that has some."""
    counts = settle(pair_counts(stored), "pair-counts")
    if counts.count() <= most:
        counts = F.broadcast(counts)
    each = stored.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.select("row_id", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    return each.join(counts, "pair").groupBy("row_id").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum")
    )


def digest(docs: DataFrame, most: int = BROADCAST_PAIRS, **vocabularies: str) -> DataFrame:
    """Per document the numbers of the alignment, the counts of its links' pairs and the hash of its groups."""
    hashed = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    found = alignments(docs, **vocabularies).select("doc_id", "n_a", "n_b", "n_groups", "n_links", hashed, "pairs", "times")
    found = found.withColumn("row_id", F.monotonically_increasing_id())
    path = new_folder(docs.sparkSession, "alignments")
    found.write.option("compression", "zstd").parquet(path)
    stored = docs.sparkSession.read.schema(found.schema).parquet(path)
    counts = linked_counts(stored, most)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return stored.drop("pairs", "times").join(counts, "row_id", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
