"""Statute XML to articles, and search replies to rows.

Parsing runs in Arrow batches with the standard library's parser: Spark's own
XML reader takes the last of repeated tags and accepts what follows the root.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import chain, repeat
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import article_no, clean_text
from statuta.schemas import LAW_SUMMARY

# Tags of statute XML, alternatives in order of preference.
INFO = "기본정보"
LAW_NAME = ("법령명_한글", "법령명한글", "법령명")
LAW_TYPE = ("법령종류명", "법령종류", "법종류")
EFFECTIVE, AMENDED = ("시행일자",), ("공포일자",)
SECTIONS, UNITS = ("조문", "조문목록"), ("조문단위", "조문")
NUMBER, BRANCH, STATUS, TITLE, BODY = ("조문번호",), ("조문가지번호",), ("조문여부",), ("조문제목", "조제목"), ("조문내용", "조내용")
PARAGRAPH, PARAGRAPH_BODY = "항", ("항내용",)
DELETED = "삭제"
SEARCH_FIELDS = {"mst": "법령일련번호", "law_name": "법령명한글", "law_type": "법령종류명", "promulgation_date": "공포일자", "ministry": "소관부처명"}

RAW = "law_name string, law_type string, effective_date string, amendment_date string, position int, number string, branch string, status string, title string, body string"


def text_of(element: ET.Element, tags: tuple[str, ...]) -> str:
    """Stripped text of the first tag whose first child has any; else empty."""
    found = (element.find(tag) for tag in tags)
    return next((t for e in found if e is not None and (t := (e.text or "").strip())), "")


def first_texts(element: ET.Element) -> dict[str, str]:
    """Stripped text of the first child of each tag."""
    found: dict[str, str] = {}
    for child in element:
        if (tag := child.tag) not in found:
            text = child.text
            found[tag] = text.strip() if text else ""
    return found


def any_of(found: dict[str, str], tags: tuple[str, ...]) -> str:
    """As text_of, of first_texts."""
    for tag in tags:
        if text := found.get(tag):
            return text
    return ""


def raw_articles(xml: str | None) -> list[tuple]:
    """Article fields of a payload, titles and bodies in normal form C and else as they stand; none if it is malformed."""
    if not xml:
        return []
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    info = root.find(INFO)
    if info is None or not len(info):
        info = root
    section = next((s for tag in SECTIONS if (s := root.find(tag)) is not None), None)
    units = [] if section is None else next((u for tag in UNITS if (u := section.findall(tag))), [])
    named = first_texts(info)
    heads = any_of(named, LAW_NAME), any_of(named, LAW_TYPE), any_of(named, EFFECTIVE), any_of(named, AMENDED)
    out = []
    for i, unit in enumerate(units):
        found = first_texts(unit)
        body = any_of(found, BODY)
        if PARAGRAPH in found:
            paragraphs = [text_of(p, PARAGRAPH_BODY) for p in unit.findall(PARAGRAPH)]
            body = "\n".join([t for t in (body, *paragraphs) if t])
        title = any_of(found, TITLE)
        out.append((*heads, i, any_of(found, NUMBER), any_of(found, BRANCH), any_of(found, STATUS), title if title.isascii() else normalize("NFC", title), body if body.isascii() else normalize("NFC", body)))
    return out


def parse_articles(payloads: DataFrame, xml: str = "raw_xml", name_hint: str | None = None, type_hint: str | None = None, keys: tuple[str, ...] = ("mst",)) -> DataFrame:
    """(keys, position, article fields) of the articles in payloads; deleted and empty ones are left out.

    name_hint and type_hint are columns of payloads that stand in for missing names and types.
    """
    hints = [F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in (name_hint, type_hint)]
    rows = payloads.select(*keys, hints[0].alias("_name"), hints[1].alias("_type"), F.col(xml).alias("_xml"))
    kept = [f for f in rows.schema.fields if f.name != "_xml"]
    names = [x.split()[0] for x in RAW.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in RAW.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), RAW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [raw_articles(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            index = pa.array(chain.from_iterable(repeat(i, len(articles)) for i, articles in enumerate(parsed)), pa.int64())
            fields = list(zip(*chain.from_iterable(parsed))) or [[]] * len(names)
            columns = [batch.column(i).take(index) for i in range(len(kept))] + [pa.array(f, k) for f, k in zip(fields, kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *names])

    found = rows.mapInArrow(run, schema).where(F.col("status") != DELETED)
    # Texts come in normal form C, so payloads are parsed once and not for rows with and without such letters apart.
    found = found.withColumn("article_text", clean_text(F.col("body"))).withColumn("article_title", clean_text(F.col("title"))).where("article_text <> ''")
    given = lambda c, hint: F.when(F.col(c) == "", F.col(hint)).otherwise(F.col(c)).alias(c)
    return found.select(*keys, "position", given("law_name", "_name"), given("law_type", "_type"), article_no(F.col("number"), F.col("branch")).alias("article_no"), "article_title", "article_text", "effective_date", "amendment_date")


def search_fields(xml: str) -> tuple[list[tuple[str, ...]], int]:
    """SEARCH_FIELDS of the laws of a search reply, and the total it names; a malformed reply raises."""
    root = ET.fromstring(xml)
    total = root.find("totalCnt")
    laws = [tuple([found.get(tag, "") for tag in SEARCH_FIELDS.values()]) for found in map(first_texts, root.findall("law"))]
    return laws, int(total.text.strip()) if total is not None and (total.text or "").strip() else 0


def parse_search(xml: str) -> tuple[list[dict[str, str]], int]:
    """The same with a dictionary for each law."""
    laws, total = search_fields(xml)
    return [dict(zip(SEARCH_FIELDS, law)) for law in laws], total


def search_rows(replies: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, position, law fields, error) of search replies; a malformed one gives one row with its error."""
    names, kind = [x.split()[0] for x in LAW_SUMMARY.split(", ")], dict(replies.dtypes)[key]
    order = [list(SEARCH_FIELDS).index(n) for n in names]

    def laws(reply: str | None) -> list[tuple]:
        try:
            return [(i, *[law[k] for k in order], None) for i, law in enumerate(search_fields(reply or "")[0])]
        except (ET.ParseError, ValueError) as e:
            return [(0, *(None for _ in names), f"{type(e).__name__}: {e}"[:500])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [laws(x) for x in batch.column(1).to_pylist()]
            index = pa.array(chain.from_iterable(repeat(i, len(rows)) for i, rows in enumerate(found)), pa.int64())
            fields = list(zip(*chain.from_iterable(found))) or [[]] * (len(names) + 2)
            kinds = [pa.int32(), *(pa.string() for _ in names), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), *(pa.array(f, k) for f, k in zip(fields, kinds))], [key, "position", *names, "error"])

    return replies.select(key, xml).mapInArrow(run, f"`{key}` {kind}, position int, {LAW_SUMMARY}, error string")


SUMMARY_FIELDS = tuple(x.split()[0] for x in LAW_SUMMARY.split(", "))
