import json
import os
import random
import sys

import pytest

from graphloom.llm import bpe
from graphloom.llm.encode import encode_corpus, token_count, token_text

TEXTS = ["", " ", "Hello world", "don't we'll  I'm", "naïve Ünïcödé 漢字 🙂‍👩", "a\n\n\n  b\t\r\nc", "x" * 3000, "<|endoftext|>", "1234567890 ٣٤٥ ½", "  nbsp", "foo_bar(baz);// çA"]


def test_same_ids_as_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(bpe.TOKENIZER_DIR, bpe.DEFAULT_VOCABULARY))
    t.encode_special_tokens = True
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("ab \n'tsdre.,;é漢🙂1² ") for _ in range(r.randrange(60))) for _ in range(2000)]
    enc = bpe.encoder()
    for text in texts:
        assert enc.encode(text) == t.encode(text, add_special_tokens=False).ids, text
        assert enc.decode(enc.encode(text)) == text
        assert enc.count(text) == len(enc.encode(text))


def test_merges_by_rank_not_by_position():
    vocab = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    for m in ("bc", "ab", "abc", "bcbc"):
        vocab[m] = len(vocab)
    enc = bpe.Encoder(vocab, ["b c", "a b", "ab c", "bc bc"])
    assert [enc.bytes_of[i] for i in enc.encode("abcbc")] == [b"a", b"bcbc"]
    assert [enc.bytes_of[i] for i in enc.encode("abab")] == [b"ab", b"ab"]


def test_cache_is_bounded_and_changes_nothing(monkeypatch):
    path = os.path.join(bpe.TOKENIZER_DIR, bpe.DEFAULT_VOCABULARY)
    whole = bpe.Encoder.load(path)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    small = bpe.Encoder.load(path)
    text = "one two three four five six seven one two three"
    assert small.encode(text) == whole.encode(text)
    assert len(small._cache) <= 3


def test_spans_cover_the_text():
    enc = bpe.encoder()
    for text in TEXTS:
        found, ids = enc.spans(text), enc.encode(text)
        if not ids:
            assert found is None
            continue
        ends, starts, before = found
        assert ends.tolist() == [len(b"".join(enc.bytes_of[i] for i in ids[: k + 1])) for k in range(len(ids))]
        assert ends[-1] == len(text.encode()) and starts[-1] == len(text) and before[-1] == len(ids)
        assert all(enc.count(text[:s]) == b or text[:s].endswith((" ", "\n", "\t")) for s, b in zip(starts, before))
        assert enc.spans(text, len(ids)) is None


def test_corpus_encoding(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello world", "c"), (3, "Hello world", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect())
    enc = bpe.encoder()
    assert got == [(1, []), (2, []), (3, enc.encode("Hello world")), (3, enc.encode("Hello world"))]
    assert encode_corpus(df.limit(0)).count() == 0
    back = encode_corpus(df).select("doc_id", token_text("ids").alias("t")).where("doc_id = 3").first()["t"]
    assert back == "Hello world"
    assert [r[0] for r in df.select(token_count("text")).collect()] == [0, 0, 2, 2]
