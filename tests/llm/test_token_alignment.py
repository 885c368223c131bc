"""Token alignment against all pairs of byte ranges."""

import hashlib
import random
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pytest
import sentencepiece
from corpora import documents, with_clashes
from tokenizers import Tokenizer

from tallymill.llm import token_alignment as T

ODD = [
    "x", " ", "a  b", "  lead", "trail  ", "x▁y", "\t a\nb", "<s> hi </s><unk> <0x41>", "é ﬁ é", "<|endoftext|> x",
    "\x00a", "\U0001f642 smile", "你好，世界", "The quick brown fox. The quick brown fox.", "abc" * 300, "12,345.67 it's",
]


@lru_cache(1)
def tokenizers():
    byte_level = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte_level.encode_special_tokens = True
    return byte_level, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens_by_hand(text):
    byte_level, model = tokenizers()
    raw = (" " + text).encode()
    a = byte_level.encode(" " + text, add_special_tokens=False).ids
    letters = T.byte_letters()
    a_bytes = [bytes(letters[c] for c in byte_level.id_to_token(i)) for i in a]
    b = model.encode(text)
    b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    return a, [len(x) for x in a_bytes], b, [len(x) for x in b_bytes]


def ranges(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def by_hand(text):
    found = tokens_by_hand(text)
    if found is None:
        return None
    a, a_sizes, b, b_sizes = found
    a_at, b_at = ranges(a_sizes), ranges(b_sizes)
    cuts = sorted({e for _, e in a_at} & {e for _, e in b_at})
    groups, low = [], 0
    for high in cuts:
        sides = [",".join(str(i) for i, (s, e) in zip(ids, at) if low <= s and e <= high) for ids, at in ((a, a_at), (b, b_at))]
        groups.append("|".join(sides))
        low = high
    links = [(i, j) for i, (s, e) in zip(a, a_at) for j, (u, v) in zip(b, b_at) if s < v and u < e]
    return len(a), len(b), len(groups), ";".join(groups), links


def expected(rows):
    each = [(d, by_hand(t or "")) for d, t in rows]
    held = Counter(p for _, f in each if f for p in set(f[4]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for d, f in each:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = f[4]
        n_best = sum(held[p] == best[p[0]] for p in links)
        out.append((d, *f[:3], len(links), n_best, sum(held[p] for p in links), hashlib.sha256(f[3].encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("text", ODD)
def test_groups_and_links_of_a_text(text):
    aligner = T._aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    (got,) = aligner.align([text.encode()], aligner.a.encode([text]), aligner.b.encode([text]))
    want = by_hand(text)
    if want is None:
        assert got is None
        return
    pairs = sorted(a << 32 | b for a, b in want[4])
    assert got[:4] == want[:4] and sorted(got[4].tolist()) == pairs


def test_forgetting_changes_nothing(monkeypatch):
    aligner = T.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    text = " ".join(ODD[13:] * 3)
    (one,) = aligner.align([text.encode()], aligner.a.encode([text]), aligner.b.encode([text]))
    monkeypatch.setattr(T, "REMEMBERED", 2)
    aligner.known.clear()
    (two,) = aligner.align([text.encode()], aligner.a.encode([text]), aligner.b.encode([text]))
    assert one[:4] == two[:4] and one[4].tolist() == two[4].tolist() and len(aligner.known) <= 2


@pytest.mark.parametrize("most", [T.BROADCAST_PAIRS, 0])
def test_documents(spark, most):
    rows = [(k, t, None, None, None) for k, t in enumerate(ODD * 2)] + [tuple(r) for r in documents(spark).where("n_chars < 2000 or text is null").collect()]
    docs = with_clashes(documents(spark, rows), "pairs", "times", "row_id", "groups", "held", "best", "n_a")
    got = sorted((tuple(r) for r in T.digest(docs, most).collect()), key=str)
    assert got == expected([(r[0], r[1]) for r in rows])


def test_empty(spark):
    assert T.digest(documents(spark, [])).count() == 0


def same(got, want):
    return got is want is None or (got[:4] == want[:4] and sorted(got[4].tolist()) == sorted(want[4].tolist()))


def test_texts_from_words_equal_whole_texts(monkeypatch):
    rng = random.Random(1)
    parts = [" ", " ", " ", "  ", "\n", "\t", " ", "\x1c", "▁", "a", "The", "'s", "don't", "12", "!!", "é", "ﬁ", "́", "你好", "<s>", "<|endoftext|>", "x" * 70]
    texts = ["", *ODD, *["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(500)]]
    aligner = T.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    want = aligner.align([t.encode() for t in texts], aligner.a.encode(texts), aligner.b.encode(texts))
    assert aligner.a.by_words and aligner.b.by_words
    assert all(map(same, aligner.align_texts(texts), want))
    monkeypatch.setattr(T, "REMEMBERED_WORDS", 3)
    for k, t in enumerate(texts):
        assert same(aligner.align_texts([t])[0], want[k])


def test_a_word_is_encoded_once():
    aligner = T.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    encoded = []
    for side in (aligner.a, aligner.b):
        side.encode = lambda texts, f=side.encode: encoded.extend(texts) or f(texts)
    aligner.align_texts(["some words come again", "words come again and again"])
    assert sorted(" ".join(encoded).split()) == sorted(["again", "and", "come", "some", "words"] * 2)
    encoded.clear()
    (found,) = aligner.align_texts(["again some words"])
    assert not encoded and found[:3] == by_hand("again some words")[:3]
