"""Ids of words that are encoded together equal the library's, with few calls of it."""

import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers

from llm import binary_ids


def test_new_words_are_encoded_together():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, rng, calls = binary_ids.Ids(path), random.Random(5), []
    twin = ids.tokenizer

    def counted(f):
        return lambda *a, **k: calls.append(1) or f(*a, **k)

    ids.tokenizer = SimpleNamespace(encode_batch_fast=counted(twin.encode_batch_fast), model=SimpleNamespace(tokenize=counted(twin.model.tokenize)))
    signs = ["a", "b", "th", "er", "é", "à", "ß", "ó", "½", "²", "日", "ж", "7", "'s", "'", "\n", ".", "!", "%", "\xa0", "\0", "_", "😀", "Ⅷ"]
    weights = [9] * 8 + [1] * 16
    texts = [" ".join("".join(rng.choices(signs, weights, k=rng.randrange(1, 9))) + rng.choice(["", "", ",", "...", ".\nErst"]) for _ in range(rng.randrange(400))) for _ in range(300)]
    texts += ["", " x", "x ", "a  b", "<|endoftext|> a", "\n a", "a\n b", "é" * 300 + " " + "é" * 300 + ". b", "\0 a"]
    cut = [t for t in texts if "\0" not in t]
    got = ids(cut)
    assert len(calls) < 20 + sum(map(len, ids.young)) / 200
    for text, found in zip([*cut, *texts], [*got, *ids(texts)]):
        assert found == np.array(twin.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert all(len(w) <= binary_ids.KEPT_CHARS for w in ids.young) and ids([]) == []
    # Where a token would reach over a word's end, words are encoded one by one.
    assert ids._merge_words([" a", "b"]) == ids._encode([" a", "b"])
