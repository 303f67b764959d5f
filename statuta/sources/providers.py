"""Remote models behind functions: text to vector, messages to reply, query to web results.

A provider is a picklable callable over a list. It runs in Arrow batches, so
that a call is made for each batch and not for each row. The ones here are
deterministic and offline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[list[str]], list[str]]
#: Results (url, content) of one query, at most as many as named, from the domains named.
Search = Callable[[str, int, tuple[str, ...]], list[dict]]
# Where web searches look.
DOMAINS = ("nts.go.kr", "law.go.kr", "moef.go.kr")


class HashEmbedder:
    """A vector of length one for each text, from hashes of its words."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        split = [text.split() or [""] for text in texts]
        place: dict[str, int] = {}
        for word in set(chain.from_iterable(split)):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            place[word] = h % self.dimensions + 1 if h >> 63 else -1 - h % self.dimensions
        at = np.array([place[w] for words in split for w in words], np.int64)
        np.add.at(out, (np.repeat(np.arange(len(texts)), [len(words) for words in split]), np.abs(at) - 1), np.sign(at))
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(length == 0, 1, length)).tolist()


def embed(rows: DataFrame, text: str, key: str, embedder: Embedder, batch: int = 100) -> DataFrame:
    """(key, embedding, error): a failed batch gives its rows the error and no vector."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, batch):
                part = whole.slice(first, batch)
                try:
                    vectors, error = embedder([t or "" for t in part.column(1).to_pylist()]), None
                except Exception as e:  # noqa: BLE001  other batches go on
                    vectors, error = [None] * part.num_rows, f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([error] * part.num_rows, pa.string())], [key, "embedding", "error"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>, error string")


def reply(rows: DataFrame, prompt: str, key: str, chat: Chat) -> DataFrame:
    """(key, reply): replies of a chat model; null where the call failed.

    A batch that fails is asked again message by message, so that one bad message takes no other's reply.
    """
    kind = dict(rows.dtypes)[key]

    def alone(message: str) -> str | None:
        try:
            return chat([message])[0]
        except Exception:  # noqa: BLE001
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            messages = [t or "" for t in batch.column(1).to_pylist()]
            try:
                replies = chat(messages)
            except Exception:  # noqa: BLE001
                replies = [alone(m) for m in messages]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string())], [key, "reply"])

    return rows.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, reply string")


def web_search(rows: DataFrame, key: str, queries: str, search: Search, limit: int = 3, results: int = 3, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """(key, query_idx, rank, url, content) of the first queries of each row; a query that fails gives none."""
    asked = rows.select(key, F.posexplode(F.slice(queries, 1, limit)).alias("query_idx", "query"))
    kind = dict(rows.dtypes)[key]

    def found(query: str | None) -> list[dict]:
        try:
            return [r if isinstance(r, dict) else {} for r in search(query or "", results, domains)][:results]
        except Exception:  # noqa: BLE001  other queries go on
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(i, rank, r.get("url"), r.get("content")) for i, q in enumerate(batch.column(2).to_pylist()) for rank, r in enumerate(found(q))]
            at, rank, url, content = zip(*hits) if hits else ([], [], [], [])
            taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(rank, pa.int32()), pa.array(url, pa.string()), pa.array(content, pa.string())], [key, "query_idx", "rank", "url", "content"])

    return asked.mapInArrow(run, f"`{key}` {kind}, query_idx int, rank int, url string, content string")
