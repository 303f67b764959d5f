"""Sliding windows over tokens."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of anything but spaces, tabs and line ends: the words that Spark and other engines cut alike.
WORD_END = r"[ \t\n\r\f]+"


class Tokenizer(NamedTuple):
    """Another unit than words: a text to numbers, and numbers back to text."""

    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_END, -1), lambda w: w != "")


def window_count(n: Column, size: int, overlap: int) -> Column:
    """0 for no tokens; else windows of `size` that begin every size - overlap tokens, up to the first that reaches the end."""
    step = size - overlap
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int"))


def windows(tokens: Column, size: int = 800, overlap: int = 100) -> Column:
    """array<struct<chunk_index, start, n_tokens, tokens>>."""
    step, n = size - overlap, F.size(tokens)
    count = window_count(n, size, overlap)
    made = F.transform(
        F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
        lambda i: F.struct(i.alias("chunk_index"), (i * step).alias("start"), F.least(F.lit(size), n - i * step).alias("n_tokens"), F.slice(tokens, i * step + 1, size).alias("tokens")),
    )
    return F.when(n == 0, F.slice(made, 1, 0)).otherwise(made)


def chunk(rows: DataFrame, text: str, keys: list[str], size: int = 800, overlap: int = 100, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(keys, chunk_index, start, n_tokens, content): windows over words, or over a tokenizer's numbers if one is given."""
    if tokenizer is None:
        split, join = words(F.col(text)), lambda tokens: F.array_join(tokens, " ")
    else:
        encode, decode = tokenizer

        def to_numbers(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: encode(t or ""))

        def to_text(tokens: pd.Series) -> pd.Series:
            return tokens.map(lambda t: decode([int(x) for x in t]))

        numbers = F.pandas_udf(to_numbers, "array<int>")
        join = F.pandas_udf(to_text, "string")
        split = numbers(F.col(text))
    split = rows.select(*keys, split.alias("tokens"))
    made = split.select(*keys, F.explode(windows(F.col("tokens"), size, overlap)).alias("w"))
    return made.select(*keys, "w.chunk_index", "w.start", "w.n_tokens", join(F.col("w.tokens")).alias("content"))
