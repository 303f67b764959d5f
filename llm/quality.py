"""Operator 1: quality by compression against two dictionaries.

One zstandard dictionary is trained on texts labelled good, one on texts
labelled bad. A text is compressed in windows of WINDOW bytes, all of it, with
either dictionary and with none, since without windows a long text would soon
be its own dictionary. The differences between the three sizes, divided by the
text's bytes, are the normalised compressed-size differences; their means and
extremes over the windows go through a logistic function fitted on labelled
texts that the dictionaries have not seen.

The classifier is fitted on a bounded sample (PER_CLASS whole texts of each
label, none over MAX_CHARS characters); scoring reads every text whole.

Defined cases: null and empty texts have no windows and get the score of
all-zero differences; a table without labels of both classes gives every text
the share of good labels, or 0.5 without labels (so does one whose texts of a label are all over MAX_CHARS); repeated rows are each scored; an empty table
gives an empty result; only doc_id and text of documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.calibration import Logistic, class_weights
from llm.common import dealt, held_out, labelled_sample, table

PER_CLASS, MAX_CHARS = 1500, 20_000
WINDOW, DICTIONARY_BYTES, LEVEL = 2048, 65_536, 3
THRESHOLD = 0.3


def windows(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; with too few texts to train on, their last bytes."""
    samples = [w for t in texts for w in windows(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


class QualityModel:
    """Two dictionaries and a calibration; picklable."""

    def __init__(self, rows: list[tuple[int, str, int]], counts: dict[int, int]):
        self.prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        self.dictionaries: list[bytes] = []
        self.calibration = None
        self._open = None
        if len({y for _, _, y in rows}) == 2:
            # Rows are in doc_id order; of each class, every other one builds the dictionary.
            parts = {k: [t for _, t, y in rows if y == k] for k in (0, 1)}
            self.dictionaries = [dictionary(parts[k][::2] or parts[k]) for k in (1, 0)]
            rest = [(t, k) for k in (0, 1) for t in (parts[k][1::2] or parts[k])]
            y = np.array([k for _, k in rest], float)
            self.calibration = Logistic(self.features([t for t, _ in rest]), y, class_weights(y, counts))

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def _compressors(self):
        if self._open is None:
            made = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries]
            for d in made:
                d.precompute_compress(level=LEVEL)
            options = {"write_content_size": False, "write_checksum": False}
            self._open = [zstandard.ZstdCompressor(dict_data=d, write_dict_id=False, **options) for d in made] + [zstandard.ZstdCompressor(level=LEVEL, **options)]
        return self._open

    def features(self, texts: list[str]) -> np.ndarray:
        """Differences of sizes by byte: means of bad - good, none - good and none - bad, and extremes of the first two over the windows."""
        out = np.zeros((len(texts), 6))
        good, bad, none = (c.compress for c in self._compressors())
        for i, text in enumerate(texts):
            parts = windows(text)
            if not parts:
                continue
            n = np.array([len(w) for w in parts], float)
            g, b, c = (np.array([len(f(w)) for w in parts]) for f in (good, bad, none))
            total = n.sum()
            whole = n >= min(WINDOW / 2, n.max())  # a short rest says little by itself
            by = ((b - g) / n)[whole], ((c - g) / n)[whole]
            out[i] = [(b - g).sum() / total, (c - g).sum() / total, (c - b).sum() / total, by[0].min(), by[1].min(), by[0].max()]
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), self.prior)
        return self.calibration(self.features(texts))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> QualityModel:
    return QualityModel(*labelled_sample(documents, labels, "quality", per_class, max_chars))


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = dealt(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is at least THRESHOLD, in the columns they came in, whatever their names.

    Null and empty texts are scored as in score(); repeated rows and null ids stay or go by their text; an empty table
    stays empty.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return keep_where(docs, model, lambda p: p >= THRESHOLD)


def keep_where(docs: DataFrame, model, keep) -> DataFrame:
    """The rows of docs whose text's probability passes `keep`; no join, so repeated ids do no harm."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = keep(shared.value([t or "" for t in batch.column(at).to_pylist()]))
            yield batch.filter(pa.array(passed, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
