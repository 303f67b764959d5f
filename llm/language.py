"""Operator 6: language by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (1 to 3 characters, small
letters, all else a space), hashed to HASHED places and scaled to length one.
Weights are learned by follow-the-regularised-leader with an L1 and an L2
penalty, then the scores' temperature is fitted on texts kept apart: on these
and on short pieces of them, since whole texts are nearly all told right, from
which no temperature can be learned (its loss falls to the end of the search).

Document frequencies are counted over all learning documents. The weights are
fitted on a bounded sample (PER_LANG whole texts of each language, SAMPLE in
all, none over MAX_CHARS characters); prediction reads every text whole.

Defined cases: a null text or one without letters is `und` with score 0;
without any label every text is `und`; ties go to the language first by name;
repeated rows are each predicted; an empty table gives an empty result; only
doc_id, text and (for learning) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import dealt, held_out, table

PER_LANG, SAMPLE, MAX_CHARS = 800, 20_000, 20_000
HASHED, EPOCHS = 1 << 15, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Characters of the pieces, out of a text's middle, on which the temperature is fitted beside the whole text, and where it is searched.
PIECES, TEMPERATURES = (4, 8, 16, 32), (0.02, 20.0)
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The hashed n-grams of a text in order, and how often each occurs; None without a letter."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    kept = np.ones(len(codes), bool)
    kept[1:] = is_letter[1:] | is_letter[:-1]  # runs of other characters are one space
    codes = codes[kept]
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + codes[1:] * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + codes[2:] * np.uint32(0x9E3779B1)
    grams = np.concatenate([one, two, three])
    total = np.bincount((grams ^ (grams >> np.uint32(15))) & np.uint32(HASHED - 1), minlength=HASHED)
    seen = np.flatnonzero(total)
    return seen, total[seen]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class LanguageModel:
    """Weights, document frequencies and a temperature; picklable."""

    def __init__(self, rows: list[tuple[str, str]], df: np.ndarray, n: int):
        """rows: texts and languages, which are kept as sparse rows only; df: in how many of n documents each n-gram occurs."""
        self.idf = np.log((1 + n) / (1 + df)) + 1
        counted = [(self._row(*c), lang, text) for text, lang in rows if (c := ngram_counts(text)) is not None]
        self.langs = sorted({lang for _, lang, _ in counted})
        if not self.langs:
            return
        x, y = [v for v, _, _ in counted], np.array([self.langs.index(lang) for _, lang, _ in counted])
        apart = np.arange(len(x)) % 5 == 4
        if apart.all() or not apart.any():
            apart[:] = False
        self.weights = self._follow(x, y, np.flatnonzero(~apart))
        rest = np.flatnonzero(apart) if apart.any() else np.arange(len(x))
        logits, of = [self._logits(*x[k]) for k in rest], list(y[rest])
        for k in rest:
            text = counted[k][2]
            for n in PIECES:
                if n < len(text) and (c := ngram_counts(text[(len(text) - n) // 2 :][:n])) is not None:
                    logits.append(self._logits(*self._row(*c)))
                    of.append(y[k])
        self.temperature = self._calibrate(np.array(logits), np.array(of))

    def _row(self, i: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF weights of length one."""
        v = np.log1p(n) * self.idf[i]
        return i.astype(np.int32), (v / np.linalg.norm(v)).astype(np.float32)

    def _follow(self, x: list, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Weights (place and, last, bias; language) after EPOCHS passes of follow-the-regularised-leader."""
        c = len(self.langs)
        z, n = np.zeros((HASHED + 1, c)), np.zeros((HASHED + 1, c))
        weight = lambda i: -np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        order = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for k in order.permutation(rows):
                i, v = np.append(x[k][0], HASHED), np.append(x[k][1], 1.0)
                w = weight(i)
                p = softmax(v @ w)
                p[y[k]] -= 1
                g = v[:, None] * p
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
                n[i] += g * g
        return weight(np.arange(HASHED + 1)).astype(np.float32)

    def _logits(self, i: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[i] + self.weights[HASHED]

    @staticmethod
    def _calibrate(logits: np.ndarray, y: np.ndarray) -> float:
        """The temperature of least loss, by golden-section search on its logarithm."""
        loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
        (a, b), g = np.log(TEMPERATURES), (np.sqrt(5) - 1) / 2
        for _ in range(40):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        return float(np.exp((a + b) / 2))

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text or "") if self.langs else None
        if counts is None:
            return UNKNOWN, 0.0
        p = softmax(self._logits(*self._row(*counts)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, and how many texts have a letter; each task sends HASHED sums at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(HASHED, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (c := ngram_counts(text.as_py() or "")) is not None:
                    total[c[0]] += 1
                    n += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*seen, -1], pa.int32()), pa.array([*total[seen], n], pa.int64())], ["place", "n"])

    rows = texts.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(HASHED, np.int64), 0
    for r in rows:
        if r["place"] < 0:
            n = r["n"]
        else:
            df[r["place"]] = r["n"]
    return df, n


def fit(documents: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> LanguageModel:
    """Learn from documents that are not held out: document frequencies from all of them, weights from those of each
    language with the smallest hashes of doc_id, of rows with one doc_id one; per_lang times the languages, and
    `sample`, are the most texts that come to the driver."""
    known = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).withColumn("hash", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "hash")
    keys = known.where(F.length("text") <= max_chars).select("doc_id", "lang", "hash").distinct()
    ids = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang).orderBy("rank", "lang").limit(sample).select("doc_id", "hash", "lang")
    picked = known.select("doc_id", "hash", "lang", "text").join(F.broadcast(ids), ["doc_id", "hash", "lang"])  # `sample` ids at most
    rows = picked.groupBy("doc_id", "hash", "lang").agg(F.min("text").alias("text")).collect()
    return LanguageModel(sorted((r["text"], r["lang"]) for r in rows), *document_frequencies(dealt(known.select("text"))))


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # HASHED weights by language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([lang for lang, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    found = dealt(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, fit(documents))
