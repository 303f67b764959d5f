"""Discovery of laws among search results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Ministries whose laws are kept, and keywords that are searched.
MINISTRIES = ("기획재정부", "행정안전부", "관세청", "국세청", "행정자치부")
KEYWORDS = (
    "세법", "조세", "국세", "지방세", "관세", "소득세", "법인세", "부가가치세", "상속세", "증여세",
    "종합부동산세", "개별소비세", "교통에너지환경세", "주세", "인지세", "농어촌특별세", "교육세", "증권거래세", "국세징수법", "조세범처벌법",
)


def of_ministries(rows: DataFrame, ministries: Iterable[str] = MINISTRIES) -> DataFrame:
    """Rows whose ministry contains one of the names."""
    hit = F.lit(False)
    for name in ministries:
        hit = hit | F.col("ministry").contains(name)
    return rows.where(F.coalesce(hit, F.lit(False)))


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") == 1).drop("nth")


def discover(results: DataFrame, ministries: Iterable[str] = MINISTRIES) -> DataFrame:
    """Search results (keyword_rank, position, mst, ministry, ...) of kept ministries, each mst once, where it was found first."""
    return first_of_each(of_ministries(results, ministries), "mst", "keyword_rank", "position")


def exact(results: DataFrame, law_name: str) -> DataFrame:
    """The first result of exactly this name."""
    return results.where(F.col("law_name") == law_name).orderBy("position").limit(1)
