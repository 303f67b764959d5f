"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python's str.strip() takes off.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Where lines end.
LINE_END = r"\r\n|[\n\x{0B}\x{0C}\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{AD}]"
#: Texts without any of these are in normal form C already.
MAY_COMPOSE = r"[\p{M}\x{1100}-\x{11FF}\x{2126}\x{212A}\x{212B}\x{340}-\x{37E}\x{387}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{0958}-\x{095F}\x{2329}\x{232A}\x{2ADC}]"


#: Texts without any of these are normalised already, but for their normal form.
MAY_CLEAN = r"[\t-\r\x{1C}-\x{1F}\x{85}\x{A0}\x{AD}\x{1680}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]|  |\A | \z"


def strip(text: Column) -> Column:
    """Trimmed by a list of characters: a pattern that ends in \\z is tried at every run of spaces."""
    return F.btrim(text, F.lit(SPACES))


def clean_text(text: Column) -> Column:
    """Normalised text of a text in normal form C; null becomes empty."""
    given = F.coalesce(text, F.lit(""))
    text = F.regexp_replace(given, INVISIBLE, "")
    text = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), " {2,}", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.when(~given.rlike(MAY_CLEAN), given).otherwise(strip(F.array_join(F.transform(F.split(text, LINE_END, -1), strip), "\n")))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize_rows(df: DataFrame, column: str, to: str) -> DataFrame:
    """df with the normalised text. Only rows that may change under normal form C go through Python."""
    may = F.coalesce(F.col(column).rlike(MAY_COMPOSE), F.lit(False))
    same = df.where(~may).withColumn(to, clean_text(F.col(column)))
    return same.unionByName(df.where(may).withColumn(to, clean_text(nfc(column))))


def article_no(number: Column, branch: Column) -> Column:
    """`제3조의2` of 3 and 2; empty without a number."""
    base = F.concat(F.lit("제"), number, F.lit("조"))
    return F.when(F.coalesce(number, F.lit("")) == "", "").when(F.coalesce(branch, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("의"), branch))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


# Labels of the lines of an embedding text.
EMBED_LABELS = ("법령명: ", "문서유형: ", "세목: ", "조문: ", "제목: ", "내용:\n")


def embed_text(*fields: Column) -> Column:
    """Labelled lines: law, type, tax type, article, title, body."""
    if len(fields) != len(EMBED_LABELS):
        raise ValueError("six fields are needed")
    lines = [F.concat(F.lit(label), F.coalesce(f, F.lit(""))) for label, f in zip(EMBED_LABELS, fields)]
    return F.concat_ws("\n", *lines)


def preview(text: Column, chars: int = 80) -> Column:
    flat = F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > chars, F.concat(flat, F.lit("..."))).otherwise(flat)


def or_else(value: Column, other: Column) -> Column:
    """value, or other where value is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) == "", other).otherwise(value)
