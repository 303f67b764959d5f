"""Vectors that SQL can follow, for queries that embed without a model."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_vectors(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can follow: the first eight bytes of a text's MD5."""
    return [[float(b) for b in hashlib.md5(t.encode()).digest()[:8]] for t in texts]


DIGEST_SQL = "array_to_string(list_transform(range(8), lambda i: CAST('0x' || substr(md5({}), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER)), ',')"


def shown() -> Column:
    return F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
