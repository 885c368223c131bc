"""Token files: exact round trip, order, pruning, odd cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from corpora import SCHEMA, documents, with_clashes
from tokenizers import Tokenizer

from tallymill.llm import token_files as T

VOCABULARY = "word_bpe_49k.json"


def whole(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    [
        "", "   ", "It's  they'll 12 345 a b", "café ́x Ångström ΣΣ σ",
        "a\x1cb \x85 c d <|endoftext|> x<|startoftext|>y", "\U0001f600!!! 你好 　 end", "don't'd '' 's",
    ],
)
def test_word_by_word_equals_whole_text(text):
    found = T.encode_texts([text.encode()], VOCABULARY)[0]
    assert np.frombuffer(found, dtype="<u4").tolist() == whole(text)


def test_plain_words_share_the_ids_of_their_letters(monkeypatch):
    """Words that differ in case and marks after them are encoded once; all others as before, across forgetting."""
    text = "Straße, STRASSE! ÀÉÎ) àéî. ÿÝ H\u0331 ǅ ªº don't. x'S. İstanbul, <|EndOfText|> a<|endoftext|>. ÑANDÚ?! q.”, ;; a\u0301."
    want = whole(text)
    monkeypatch.setattr(T, "_loaded", {})
    for most in (300_000, 3):
        monkeypatch.setattr(T, "REMEMBERED_STEMS", most)
        assert np.frombuffer(T.encode_texts([text.encode()], VOCABULARY)[0], dtype="<u4").tolist() == want
        T._loaded[VOCABULARY].words.clear()
    monkeypatch.setattr(T, "REMEMBERED_STEMS", 300_000)
    encoder = T._remembered(VOCABULARY)
    assert encoder.of_stems is not None
    encoder.stems.clear()
    T.encode_texts([b"Reader, reader. READER reader;"], VOCABULARY)
    assert set(encoder.stems) == {"reader", ",", ".", ";", ""} and len(encoder.words) == 4


def test_words_are_looked_up_once_a_batch_and_new_letters_meet_only_the_model(monkeypatch):
    """Whatever marks follow: words of a batch are numbered, plain ones never go through the library's rules; those
    of the batch at hand outlast forgetting."""
    texts = ["Reader### reader&&& RÉADER", "", " \t", "été### reader Été ÉTÉ### don't x\xad a__ __a b^`~ (c)"] * 2
    monkeypatch.setattr(T, "_loaded", {})
    encoder = T._remembered(VOCABULARY)
    asked, odd, plain = [], [], encoder._encoded
    ids_of = encoder.ids_of
    monkeypatch.setattr(encoder, "ids_of", lambda words: asked.extend(words) or ids_of(words))
    monkeypatch.setattr(encoder, "_encoded", lambda words: odd.extend(words) or plain(words))
    found = T.encode_texts([t.encode() for t in texts], VOCABULARY)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in found] == [whole(t) for t in texts]
    assert len(asked) == len(set(asked)) == len({w for t in texts for w in t.encode().split()} | {b""})
    assert set(odd) == {"", "###", "&&&", "__", "^`~", "don't", "x\xad", "__a", "(c)"}
    monkeypatch.setattr(T, "REMEMBERED", 3)
    odd.clear()
    assert T.encode_texts([b"don't x^ x^"], VOCABULARY)[0] == np.array(whole("don't x^ x^"), dtype="<u4").tobytes()
    assert set(encoder.words) == {b"don't", b"x^"} and "don't" not in odd
    assert T.encode_texts([], VOCABULARY) == []


def test_round_trip(spark, tmp_path):
    docs = with_clashes(documents(spark), "part", "ids", "start", "local_start", "before", "of")
    path = str(tmp_path / "files")
    T.write_token_files(docs, path)
    got = sorted((tuple(r) for r in T.digest(spark, path).collect()), key=lambda r: r[1])
    given = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r[0] for r in got] == [r.doc_id for r in given]
    start = 0
    for r, d in zip(got, given):
        ids = whole(d.text or "") + [1]
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_filter_on_ids_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "files")
    T.write_token_files(documents(spark), path)
    one = T.read_token_files(spark, path).where("doc_id = 7")
    assert one.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_empty(spark, tmp_path):
    path = str(tmp_path / "files")
    T.write_token_files(documents(spark, []), path)
    assert T.digest(spark, path).count() == 0
    assert SCHEMA
