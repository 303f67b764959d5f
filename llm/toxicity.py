"""Operator 9: toxic spans by a linear-chain conditional random field.

Tokens are runs between white space. A token's potential is the sum of weights
of its features (its words, their beginnings and endings); two
states, clean and toxic, follow each other along a document.

Labelled tokens come from labelled documents: a word, or a beginning of words,
that occurs after many different tokens in toxic documents of the sample and
hardly ever in clean ones (chance is ruled out at NOISE) marks its tokens in
toxic documents.
The field is fitted to pieces around marked tokens and to clean pieces by
gradient ascent on the likelihood, computed by forward-backward. The marginals
of a document give its likeliest toxic token and the number expected among
likely ones; a logistic function, fitted on documents the field has not seen, makes that
its score. Tokens with a marginal of one half or more are the offending spans.

The classifier is fitted on a bounded sample (PER_CLASS whole texts of each
label, none over MAX_CHARS characters); scoring reads every text whole.

Defined cases: null and empty texts have no tokens and get the score of a text
without toxic ones; a table without labels of both classes gives every text the
share of toxic labels, or 0; repeated rows are each scored; an empty table gives an
empty result; only doc_id and text of documents are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.calibration import Logistic, class_weights
from llm.common import dealt, held_out, labelled_sample, table
from llm.quality import keep_where

PER_CLASS, MAX_CHARS = 3000, 20_000
THRESHOLD = 0.5
#: Log of the chance at which a word's lean to toxic documents counts as noise.
NOISE = log(1e-7)
BEGINNINGS = range(4, 9)
HASHED, PIECE, STEPS = 1 << 18, 12, 40
CACHE_WORDS = 500_000
LANE = 128
WORD = re.compile(r"\w+")


def features(token: str) -> list[int]:
    """Hashed features of a token: for each word in it, the word, its beginnings and its ending."""
    out = set()
    for word in WORD.findall(token.lower()) or [token]:
        out.add(f"={word}")
        out.update(f"^{word[:n]}" for n in BEGINNINGS if n <= len(word))
        out.add(f"${word[-3:]}")
    return [zlib.crc32(f.encode("utf-8", "replace")) % HASHED for f in out]


def stems(token: str) -> set[str]:
    """Words of a token, and their beginnings followed by a star."""
    out = set()
    for word in WORD.findall(token.lower()):
        out.add(word)
        out.update(f"{word[:n]}*" for n in BEGINNINGS if n < len(word))
    return out


def log_tail(k: int, n: int, p: float) -> float:
    """Log of the chance of k or more out of n at p, from its first terms."""
    term = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    return term + log(1 + (n - k) / (k + 1) * p / (1 - p)) if n > k else term


def occurrences(texts: list[list[str]]) -> tuple[Counter, int]:
    """How often stems occur, after how many different tokens; copies of a text add nothing."""
    place: dict[str, int] = {}
    ids = [np.array([place.setdefault(t, len(place)) for t in tokens], np.int64) for tokens in texts if tokens]
    before = [np.append(len(place), x[:-1]) for x in ids]  # a text's first token comes after none
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(x * (len(place) + 1) + y for x, y in zip(ids, before))]))
    counts: Counter = Counter()
    for token, n in zip(place, np.bincount(pairs // (len(place) + 1), minlength=len(place)).tolist()):
        for stem in stems(token):
            counts[stem] += n
    return counts, len(pairs)


def toxic_stems(texts: list[list[str]], y: np.ndarray) -> set[str]:
    """Words and beginnings that occur in toxic documents far beyond chance, and hardly ever in clean ones."""
    clean, n_clean = occurrences([t for t, label in zip(texts, y) if label != 1])
    toxic, out = [t for t, label in zip(texts, y) if label == 1], set()
    while toxic:  # toxic documents that no stem explains yet are looked at again by themselves
        counts, n = occurrences(toxic)
        p = (n + 1) / (n + n_clean + 2)
        more = {x for x, k in counts.items() if k >= 4 and k >= 9 * clean[x] and log_tail(k, k + clean[x], p) < NOISE}
        if not more:
            break
        out |= more
        toxic = [t for t in toxic if not any(stems(x) & more for x in set(t))]
    return out


class Field:
    """Potentials of a two-state chain: e for toxic tokens, T between states, s at the start."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.weights, self.transitions, self.start = weights, transitions, start
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        cache, weights = self.cache, self.weights
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for token in {t for t in tokens if t not in cache}:
            cache[token] = float(weights[features(token)].sum())
        return np.fromiter(map(cache.__getitem__, tokens), np.float64, len(tokens))

    def marginals(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Chance of the toxic state for each token of several documents in a row; `first` has where documents begin.

        A document's first token has a transition that forgets what was before,
        so that all documents are one chain. It is cut into lanes of LANE
        tokens. Products of each lane's matrices, taken for all lanes at once,
        give what enters every lane; then messages run through all lanes at once.
        """
        n = len(emissions)
        lanes = -(-n // LANE)
        m = np.empty((lanes * LANE, 2, 2))
        m[:] = np.eye(2)  # fills the last lane up
        m[:n] = np.exp(self.transitions)
        m[first] = np.exp(self.start)  # both rows alike
        scale = np.exp(-np.abs(emissions))
        m[:n, :, 0] *= np.where(emissions > 0, scale, 1)[:, None]
        m[:n, :, 1] *= np.where(emissions > 0, 1, scale)[:, None]
        m = np.ascontiguousarray(m.reshape(lanes, LANE, 2, 2).transpose(1, 2, 3, 0))  # step, from, to, lane
        forward = self._pass(m, False)
        backward = self._pass(m, True)
        toxic = forward[:, 1] * backward[:, 1]
        return (toxic / (forward[:, 0] * backward[:, 0] + toxic)).T.ravel()[:n]

    @staticmethod
    def _pass(m: np.ndarray, back: bool) -> np.ndarray:
        """Messages (step, state, lane): of what is up to a token, or of what comes after it."""
        steps, _, _, lanes = m.shape
        if back:  # after a token stands the next one's matrix, transposed
            m = m.transpose(0, 2, 1, 3)[::-1]
        whole = np.empty((2, 2, lanes))
        whole[:] = np.eye(2)[:, :, None]
        for t in range(steps):
            whole = np.stack([whole[:, 0] * m[t, 0, 0] + whole[:, 1] * m[t, 1, 0], whole[:, 0] * m[t, 0, 1] + whole[:, 1] * m[t, 1, 1]], 1)
            whole /= whole.sum((0, 1))
        enter = np.empty((2, lanes))
        a, b = 0.5, 0.5
        w = whole.tolist()
        for k in reversed(range(lanes)) if back else range(lanes):
            enter[:, k] = a, b
            a, b = a * w[0][0][k] + b * w[1][0][k], a * w[0][1][k] + b * w[1][1][k]
            a, b = a / (a + b), b / (a + b)
        out = np.empty((steps, 2, lanes))
        now = enter
        for t in range(steps):
            if back:
                out[steps - 1 - t] = now
            now = np.stack([now[0] * m[t, 0, 0] + now[1] * m[t, 1, 0], now[0] * m[t, 0, 1] + now[1] * m[t, 1, 1]])
            now = now / now.sum(0)
            if not back:
                out[t] = now
        return out


def fit_field(texts: list[list[str]], marks: list[np.ndarray]) -> Field:
    """The field that makes the marked tokens likeliest, over pieces around marks and clean pieces."""
    pieces: list[tuple[list[str], np.ndarray]] = []
    for tokens, mark in zip(texts, marks):
        hot = {int(i) // PIECE for i in np.flatnonzero(mark)}
        count = -(-len(tokens) // PIECE)
        if not count:
            continue
        spread = {zlib.crc32(f"{len(tokens)} {k}".encode()) % count for k in range(2)}
        for k in hot | spread:
            pieces.append((tokens[k * PIECE : (k + 1) * PIECE], mark[k * PIECE : (k + 1) * PIECE]))
    n = len(pieces)
    lengths = np.array([len(p) for p, _ in pieces])
    live = np.arange(PIECE) < lengths[:, None]
    y = np.zeros((n, PIECE))
    index: dict[str, int] = {}
    ids = np.zeros((n, PIECE), np.int64)
    for i, (tokens, mark) in enumerate(pieces):
        y[i, : len(tokens)] = mark
        ids[i, : len(tokens)] = [index.setdefault(t, len(index)) for t in tokens]
    by_type = [features(t) for t in index]
    type_of = np.repeat(np.arange(len(by_type)), [len(f) for f in by_type])
    feature_of = np.array([x for f in by_type for x in f], np.int64)
    used, feature_of = np.unique(feature_of, return_inverse=True)
    weights, transitions, start = np.zeros(len(used)), np.zeros((2, 2)), np.zeros(2)
    squares = [np.full_like(x, 1e-8) for x in (weights, transitions, start)]
    emitted = np.zeros(len(index))
    for _ in range(STEPS):
        emitted = np.bincount(type_of, weights[feature_of], len(index))
        e = np.where(live, emitted[ids], 0)
        move, begin = np.exp(transitions), np.exp(start)
        alpha, beta = np.empty((n, PIECE, 2)), np.ones((n, PIECE, 2))
        push = np.stack([np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))], -1)
        alpha[:, 0] = begin * push[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(-1, keepdims=True)
        for t in range(1, PIECE):
            alpha[:, t] = (alpha[:, t - 1] @ move) * push[:, t]
            alpha[:, t] /= alpha[:, t].sum(-1, keepdims=True)
        for t in range(PIECE - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], (beta[:, t + 1] * push[:, t + 1]) @ move.T, 1)
            beta[:, t] /= beta[:, t].sum(-1, keepdims=True)
        both = alpha * beta
        p = both[..., 1] / both.sum(-1)
        error = np.where(live, y - p, 0)
        pairs = alpha[:, :-1, :, None] * move * (beta * push)[:, 1:, None, :]
        pairs /= pairs.sum((-1, -2), keepdims=True)
        true = np.stack([1 - y, y], -1)
        follow = live[:, 1:, None, None]
        gradients = [
            np.bincount(feature_of, np.bincount(ids.ravel(), error.ravel(), len(index))[type_of], len(used)) - 0.01 * weights,
            ((true[:, :-1, :, None] * true[:, 1:, None, :] - pairs) * follow).sum((0, 1)) - 0.01 * transitions,
            (true[:, 0] - np.stack([1 - p[:, 0], p[:, 0]], -1)).sum(0) - 0.01 * start,
        ]
        for value, square, gradient in zip((weights, transitions, start), squares, gradients):
            square += gradient**2
            value += 0.5 * gradient / np.sqrt(square)
    full = np.zeros(HASHED)
    full[used] = weights
    return Field(full, transitions, start)


class ToxicityModel:
    """A field and a calibration; picklable."""

    def __init__(self, rows: list[tuple[int, str, int]], counts: dict[int, int]):
        self.prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.0
        self.field = self.calibration = None
        if len({y for _, _, y in rows}) < 2:
            return
        y = np.array([k for _, _, k in rows], float)
        fitted = np.zeros(len(rows), bool)
        for k in (0, 1):
            fitted[np.flatnonzero(y == k)[::2]] = True  # rows are in doc_id order
        one: dict[str, str] = {}  # equal tokens are one string
        own = [[one.setdefault(x, x) for x in t.split()] for (_, t, _), f in zip(rows, fitted) if f]
        known = toxic_stems(own, y[fitted])
        marked = {token: bool(stems(token) & known) for t in own for token in set(t)}
        marks = [np.array([label == 1 and marked[x] for x in t], float) for t, label in zip(own, y[fitted])]
        self.field = fit_field(own, marks)
        rest = ~fitted if len(set(y[~fitted])) == 2 else fitted
        x = self.features([" ".join(t.split()) for (_, t, _), r in zip(rows, rest) if r])
        self.calibration = Logistic(x, y[rest], class_weights(y[rest], counts))

    def _marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens, and where each text's tokens begin, with the end."""
        split = [t.split() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(int)
        tokens = [t for s in split for t in s]
        if not tokens:
            return np.zeros(0), at
        return self.field.marginals(self.field.emissions(tokens), at[:-1][np.diff(at) > 0]), at

    @staticmethod
    def _aggregate(p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By text: the log odds of its likeliest toxic token, and the log of one plus the toxic tokens expected among likely ones."""
        filled = np.diff(at) > 0
        expected, top = np.zeros(len(filled)), np.zeros(len(filled))
        if len(p):
            expected[filled] = np.add.reduceat(np.where(p >= 0.5, p, 0), at[:-1][filled])
            top[filled] = np.maximum.reduceat(p, at[:-1][filled])
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.stack([np.log(top / (1 - top)), np.log1p(expected)], 1)

    def features(self, texts: list[str]) -> np.ndarray:
        return np.vstack([self._aggregate(*self._marginals(part)) for part in self._parts(texts)]) if texts else np.zeros((0, 2))

    @staticmethod
    def _parts(texts: list[str]) -> Iterator[list[str]]:
        """Some texts at a time, about a million characters."""
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size > 1_000_000:
                yield part
                part, size = [], 0
        if part:
            yield part

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), self.prior)
        return self.calibration(self.features(texts))

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
        """Scores, and the character offsets of each text's offending spans."""
        if self.calibration is None:
            return np.full(len(texts), self.prior), [[] for _ in texts]
        scores, spans = [], []
        for part in self._parts(texts):
            p, at = self._marginals(part)
            scores.append(self.calibration(self._aggregate(p, at)))
            hot = p >= 0.5
            for text, a, b in zip(part, at[:-1], at[1:]):
                found: list[dict[str, int]] = []
                if hot[a:b].any():
                    for match, toxic, before in zip(re.finditer(r"\S+", text), hot[a:b], [False, *hot[a : b - 1]]):
                        if toxic and before:
                            found[-1]["end"] = match.end()
                        elif toxic:
                            found.append({"start": match.start(), "end": match.end()})
                spans.append(found)
        return np.concatenate(scores) if scores else np.zeros(0), spans


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    return ToxicityModel(*labelled_sample(documents, labels, "toxic", per_class, max_chars))


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2^18 weights
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = shared.value.tag([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "score", "spans"])

    scored = dealt(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is under THRESHOLD, in the columns they came in, whatever their names.

    Null and empty texts are scored as in score(); repeated rows and null ids stay or go by their text; an empty table
    stays empty.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return keep_where(docs, model, lambda p: p < THRESHOLD)
