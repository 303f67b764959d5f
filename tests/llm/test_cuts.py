"""Texts are cut where matches of the pattern begin, in bytes; words are kept without the signs and lines after them."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import binary_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHITE = [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
SIGNS = [*"abZ09'.,!%<|>\0\x7f²µº×÷ÀÿſɏɐʰПи日ạ’—…€Ⅷ😀\u0301", "'s", "th", "er", "<|endoftext|>"]


def library(texts):
    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_words_with_signs_and_lines_are_kept_apart():
    rng = random.Random(3)
    words = ["".join(rng.choices("aehinrstéü", k=6)) for _ in range(40)]
    texts = [" ".join(f"{a}{rng.choice(['%%%', '###', ')', '’', '.'])}\n{b}" for a in words) for b in words]
    ids = binary_ids.Ids(PATH)
    assert ids(texts) == library(texts)
    assert len(ids.young) < 300  # of 1600 pairs


def test_cuts_do_no_harm():
    rng, ids = random.Random(7), binary_ids.Ids(PATH)
    texts = ["", " ", "\n", "<|endoftext|>"]
    for _ in range(4000):
        pool = rng.sample(SIGNS, 6) + [" ", "\n", rng.choice(WHITE)] * rng.randrange(3)
        texts.append("".join(rng.choices(pool, k=rng.randrange(25))))
    for text, got, want in zip(texts, ids(texts), library(texts), strict=True):
        assert got == want, text


@pytest.mark.parametrize("text", ["и мир", "日 本", "’ x", "— x", "é, x", "ạ x", "😀 x", "€ x", "あ x"])
def test_cuts_after_characters_of_many_bytes(text):
    assert binary_ids.cuts(np.frombuffer(text.encode(), np.uint8)).any()


@pytest.mark.parametrize("text", ["\xa0 x", "\u2003 x", "\u2028 x", "\u3000 x", "\u1680 x", "\x85 x", "×!", "÷!", "\n x"])
def test_no_cuts_where_white_space_or_signs_may_go_on(text):
    assert not binary_ids.cuts(np.frombuffer(text.encode(), np.uint8))[: text.encode().rindex(text[-1].encode())].any()


@pytest.mark.parametrize("size", [1, 50, 4_000_000])
def test_parts_hold_all_texts_in_order(monkeypatch, size):
    monkeypatch.setattr(binary_ids, "PART_BYTES", size)
    monkeypatch.setattr(binary_ids, "CACHE_WORDS", 5)
    texts = ["", "a b c", "", "x" * 300 + " y", "<|endoftext|>", "", "d " * 30, "a b c", "e\nf g, h", ""]
    ids = binary_ids.Ids(PATH)
    assert ids(texts) == library(texts) and ids(texts[::-1]) == library(texts[::-1])
    assert all(len(w) <= binary_ids.KEPT_CHARS for w in ids.young)
