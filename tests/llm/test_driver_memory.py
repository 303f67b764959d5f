"""What the driver holds while it fits the models of the pipeline."""

import random
import tracemalloc
from collections import Counter

import numpy as np

from llm import decontaminate, toxicity


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_search_is_made_without_copies_of_its_directions():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60_000)]
    known = np.unique(decontaminate._Columns()(words))
    items = [decontaminate.Item(k, part, " ".join(part)) for k in range(1500) for part in [words[k * 40 : k * 40 + 40]]]
    basis = np.linalg.qr(rng.standard_normal((len(known), decontaminate.RANK)))[0].astype(np.float32)
    idf = np.linspace(1, 9, decontaminate.HASHED)
    search, most = peak(lambda: decontaminate.Search(items, idf, known, basis))
    assert most < 2 * (search.latent.nbytes + search.passages.nbytes) + 40e6
    rows, cols, values = decontaminate.weighted_rows([x.words for x in items], decontaminate.ITEM_STRIDE, idf, decontaminate._Columns())
    own = np.zeros((rows[-1] + 1, decontaminate.RANK))
    np.add.at(own, rows, basis[np.searchsorted(known, cols)] * values[:, None])
    assert np.allclose(search.passages, own / np.linalg.norm(own, axis=1)[:, None], atol=1e-5)
    assert np.allclose(search.latent[:-1], basis * idf[known][:, None], atol=1e-5) and not search.latent[-1].any()


def test_orthonormal_columns_span_the_same():
    rng = np.random.default_rng(2)
    for n, rank in ((5000, 60), (30, 60), (5000, 20), (1, 60)):  # also fewer rows or directions than columns
        made = (rng.standard_normal((n, rank)) * np.geomspace(1, 1e-4, rank)) @ rng.standard_normal((rank, 60))
        a = made.astype(np.float32)
        kept = a.astype(np.float64)
        q, most = peak(lambda: decontaminate.orthonormal(a))
        assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-5)
        assert np.allclose(q @ (q.T @ kept), kept, atol=1e-4 * np.abs(kept).max())
        assert most < 6e6  # a part of the rows, not all of them
    assert decontaminate.orthonormal(np.zeros((0, 60), np.float32)).size == 0


def test_occurrences_equal_plain_pairs():
    rng = random.Random(3)
    texts = [[rng.choice(["ab", "abcdef", "abcdef!", "x", "..."]) for _ in range(rng.randrange(9))] for _ in range(50)]
    pairs = {(t, b) for x in texts for t, b in zip(x, ["", *x])}
    want: Counter = Counter()
    for token, _ in pairs:
        want.update(toxicity.stems(token))
    assert toxicity.occurrences(texts) == (want, len(pairs)) and toxicity.occurrences([]) == (Counter(), 0)
    many = [[f"t{rng.randrange(2000)}" for _ in range(1000)] for _ in range(300)]
    assert peak(lambda: toxicity.occurrences(many))[1] < 18e6
