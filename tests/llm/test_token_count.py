"""Token counts against the vocabulary's own library."""

import random

import pytest

from lineloom.llm import token_count


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    read = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: len(read.encode(text, add_special_tokens=False).ids)


def test_every_character_alone_and_between_letters(library):
    of = token_count.public_words()
    for c in [*range(0x3200), *range(0xAC00, 0xAD00), *range(0xF900, 0x10000), *range(0x1F300, 0x1F700)]:
        if 0xD800 <= c < 0xE000:
            continue
        for text in (chr(c), f"a{chr(c)}b"):
            assert of(text) == library(text), hex(c)


def test_random_texts(library):
    of, r = token_count.public_words(), random.Random(2)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\x1c", "\x1f", "'s", "'LL", "'", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "é", "é", "ß", "İ", "Σ", "9", "12", "́", "中", "한", "하", "!", "?!", "😀", "​", "\xa0", "　", "K", "ﬁ"]
    for _ in range(5000):
        text = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert of(text) == library(text), text


def test_long_words_long_texts_and_slices(library, monkeypatch):
    of, r = token_count.public_words(), random.Random(3)
    assert of(text := "".join(r.choices("abcdeéz", k=50_000))) == library(text)
    monkeypatch.setattr(token_count, "SLICE", 7)
    for text in ["a few words and more, " * 50, "x" * 100 + " " * 30 + "y", "\x1c a\x1d" * 40, "  leading", "trailing  "]:
        assert of(text) == library(text)


def test_bounded_memory_of_counts(library, monkeypatch):
    monkeypatch.setattr(token_count, "KEPT", 3)
    import public_tokenizers

    counter = token_count.Counter(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"word{i} other{i}" for i in range(50))
    assert counter.of(text) == library(text) and len(counter._chunk) == 3


def test_rows(spark, library):
    rows = [(1, "Two words", "x"), (1, "Two words", "x"), (None, None, None), (3, "", "y"), (4, "é " * 3000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string")
    counted = token_count.count_tokens(frame, token_count.public_words)
    want = sorted(((t and len(t.encode())) or 0, library(t or ""), library(t or "") > 2048) for _, t, _ in rows)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect()) == want
    assert counted.columns == ["doc_id", "text", "n_tokens", "n_bytes", "over_limit"]
    assert token_count.count_tokens(frame.limit(0), token_count.public_words).count() == 0
    assert counted.where("over_limit").count() == 1
