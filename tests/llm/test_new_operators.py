"""Collocations, lexical search and the tokenization automaton against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import bpe_automaton, collocations, lexical_search

LIMIT = [(1, "The cat. the CAT sat,the cat sat\ton", "en", 1), (2, None, None, 2), (None, "", "en", 3), (4, "ÄÖ the  cat sat on on on", None, 4), (4, "ÄÖ the  cat sat on on on", None, 4)]


def corpus(rng, docs, words, length):
    """Texts of few words with a very frequent pair, marks and odd spaces."""
    out = []
    for i in range(docs):
        text = " ".join(rng.choice(["a b", "a b c", *words]) for _ in range(rng.randrange(length)))
        out.append((i, re.sub(" ", lambda _: rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x85"]), text), rng.choice(["en", "de", None])))
    return out


def collocated(rows, min_count, k, covered=100):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for a in range(len(words)):
                for b in range(a + 1, min(a + 5, len(words)) + 1):
                    counts[lang or "und", tuple(words[a:b])] += 1
    frequent = {key: n for key, n in counts.items() if n >= min_count}
    out = {}
    for (lang, words), a in frequent.items():
        around = [n for (other, longer), n in frequent.items() if other == lang and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1)) and len(longer) > len(words)]
        if len(words) < 2 or any(100 * n >= covered * a for n in around):
            continue
        n = totals[lang]
        score, _, left, right = min((1000 * a * n // (frequent[lang, words[:i]] * frequent[lang, words[i:]]), i, frequent[lang, words[:i]], frequent[lang, words[i:]]) for i in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right, n))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n, -s) for lang, found in out.items() for i, (s, a, p, left, right, n) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize("group, bucket_bytes, k, covered", [(1_000_000, 4 << 20, 2000, 100), (20, 500, 2000, 100), (60, 20_000, 7, 80)])
def test_collocations_equal_brute_force(spark, group, bucket_bytes, k, covered):
    rows = corpus(random.Random(group), 400, ["d", "Éa", "éa", "the", "THE", "of", "x" * 300], 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = collocations.collocations(docs, 30, k, covered, group, bucket_bytes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == collocated(rows, 30, k, covered)


def test_collocations_of_odd_tables(spark):
    docs = spark.createDataFrame(LIMIT, "doc_id long, text string, lang string, n long")  # n clashes with a column made here
    assert sorted(map(tuple, collocations.collocations(docs, 2).collect())) == collocated([r[:3] for r in LIMIT], 2, 2000)
    assert collocations.collocations(docs.where("doc_id = 99"), 2).collect() == []


def test_score_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big // 10**4, big // 10**3, big // 10**4, big // 10**5)], "a long, n long, l long, r long")
    a, n, left, right = row.head()
    assert row.select(collocations.exact_score("a", "n", "l", "r")).head()[0] == 1000 * a * n // (left * right)


def ranked(rows, items, k):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    docs = [(doc_id, Counter(terms(text))) for doc_id, text in rows if terms(text)]
    count, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc_id, tf in docs:
            m = 50 + 50 * sum(tf.values()) * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in wanted & tf.keys())
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, i + 1, doc_id, -s) for i, (s, _, _, doc_id) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_terms, block", [(100_000, 500), (10, 7)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, item_terms, block):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    rng = random.Random(5)
    words = ["the", "The", "été", "É", "x1", "x_1", "re-do", "\x00", "\x7f", "漢字", "long" * 50, "rare"]
    rows = [(i // 2 if i % 50 == 0 else i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)] + [(None, "the x1"), (None, None), (900, "the " * 30_000), (901, ""), (902, "...")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(25)] + [(3, "rare again"), (None, "the rare"), (77, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, term int, block long").repartition(4)
    found = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 20, item_terms)
    assert sorted(map(tuple, found.collect()), key=str) == ranked(rows, items, 20)


def test_lexical_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.where("doc_id = 2"), items).collect() == []
    assert lexical_search.search(docs, items.where("item_id = 2")).collect() == []


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_automaton.transducer(path), Tokenizer.from_file(path)


def test_automaton_equals_the_library(both):
    mine, library = both
    rng = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "漢", "🙂", "'s", "'T", "99", "<|endoftext|>", "<|endo", "_", "-", " ", "​", "aaaa", "\x00", "\x1c", "́", "tion", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(5000)] + ["a" * 50_000, "ab" * 20_000, "".join(rng.choice("aedht") for _ in range(20_000)), ""]
    for text, ids, wanted in zip(texts, mine.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == wanted.ids, text[:80]
        assert mine.decode(ids) == library.decode(wanted.ids, skip_special_tokens=False)


def test_automaton_accepts_what_bpe_makes(both):
    mine, library = both
    automaton, rng = mine.automaton, random.Random(2)
    for _ in range(3000):
        pair = [rng.randrange(50_000) for _ in range(2)]
        word = b"".join(automaton.labels[t] for t in pair)
        whole = list(next(automaton.encode([word])))
        assert automaton.has(*pair) == (whole == pair)


def test_gadget_of_a_doubled_token():
    labels = {i: bytes([i]) for i in range(256)} | {256: b"aa", 257: b"aaa"}
    made = bpe_automaton.Automaton(labels, [(97, 97, 256), (256, 97, 257)])
    assert [list(x) for x in made.encode([b"a", b"aa", b"aaa", b"aaaa", b"aaaaab"])] == [[97], [256], [257], [256, 256], [256, 257, 98]]
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(labels, [(256, 97, 257), (97, 97, 256)])


def test_automaton_query_of_odd_tables(spark, both):
    mine, library = both
    docs = spark.createDataFrame(LIMIT, "doc_id long, text string, lang string, n_tokens long")
    rows = bpe_automaton.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True).collect()
    assert len(rows) == len(LIMIT)
    for row in rows:
        text = next(r[1] for r in LIMIT if r[0] == row["doc_id"]) or ""
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert (row["n_tokens"], bytes(row["ids"]), row["decoded"]) == (len(ids) // 4, ids, text)
        assert (row["ids_sha256"], row["decoded_sha256"]) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_automaton.encode(docs.where("doc_id = 99"), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
