"""Ordered first-match rules: a value takes the label of the first rule whose keyword it contains.

Rules are data: (keyword, label) in order. They become one CASE expression, so
that classification is a projection inside code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Iterable[tuple[str, str]]

# Question keywords by law label, in order of precedence.
QUESTION_RULES: Mapping[str, tuple[str, ...]] = {
    "소득세법": ("소득세", "종합소득", "원천징수", "근로소득", "사업소득", "기타소득", "양도소득"),
    "부가가치세법": ("부가세", "부가가치세", "vat", "간이과세", "일반과세", "매입세액", "매출세액"),
    "법인세법": ("법인세", "법인소득", "법인 세금"),
    "상속세및증여세법": ("상속세", "증여세", "상속", "증여", "유산"),
    "지방세법": ("지방세", "취득세", "재산세", "주민세", "자동차세", "등록면허세"),
    "조세특례제한법": ("조세특례", "감면", "공제", "세액공제", "조특법", "세제혜택"),
    "국세기본법": ("국세기본", "가산세", "경정청구", "불복", "과세전적부심사"),
    "종합부동산세법": ("종합부동산세", "종부세"),
    "개별소비세법": ("개별소비세", "특별소비세"),
    "교통에너지환경세법": ("교통에너지환경세", "교통세"),
    "주세법": ("주세", "주류세"),
    "인지세법": ("인지세",),
    "농어촌특별세법": ("농어촌특별세", "농특세"),
    "교육세법": ("교육세",),
    "증권거래세법": ("증권거래세",),
    "국세징수법": ("국세징수", "체납", "압류", "공매"),
    "조세범처벌법": ("조세범", "세금포탈", "조세포탈"),
    "국제조세조정에관한법률": ("국제조세", "이전가격", "조세조약", "해외금융계좌"),
    "관세법": ("관세", "수입세", "수출입", "관세청"),
    "지방세기본법": ("지방세기본", "지방세 불복", "지방세 경정"),
    "지방세특례제한법": ("지방세특례", "지방세 감면"),
    "지방세징수법": ("지방세징수", "지방세 체납"),
}
# Tax type by a part of the law's name, in order of precedence.
LAW_NAME_RULES = (
    ("국세기본", "국세기본법"),
    ("소득세", "소득세법"),
    ("법인세", "법인세법"),
    ("부가가치세", "부가가치세법"),
    ("상속세", "상속세및증여세법"),
    ("증여세", "상속세및증여세법"),
    ("조세특례", "조세특례제한법"),
    ("지방세기본", "지방세기본법"),
    ("지방세특례", "지방세특례제한법"),
    ("지방세징수", "지방세징수법"),
    ("지방세", "지방세법"),
    ("종합부동산세", "종합부동산세법"),
    ("개별소비세", "개별소비세법"),
    ("주세", "주세법"),
    ("인지세", "인지세법"),
    ("농어촌특별세", "농어촌특별세법"),
    ("교육세", "교육세법"),
    ("증권거래세", "증권거래세법"),
    ("국세징수", "국세징수법"),
    ("조세범처벌", "조세범처벌법"),
    ("국제조세조정", "국제조세조정에관한법률"),
    ("관세", "관세법"),
)
# Document category and law by a part of the file name, in order of precedence.
FILE_CATEGORY_RULES = (("(법률)", "법령"), ("(대통령령)", "시행령"), ("(부령)", "시행규칙"), ("(훈령)", "집행기준"), ("(고시)", "집행기준"))
FILE_LAW_RULES = tuple((name, name) for name in ("소득세법", "부가가치세법", "법인세법", "상속세및증여세법", "지방세법", "조세특례제한법", "국세기본법"))
# Default labels.
ALL, OTHER_CATEGORY, COMMON_LAW = "ALL", "기타", "공통"


def question_rules() -> list[tuple[str, str]]:
    return [(keyword, label) for label, keywords in QUESTION_RULES.items() for keyword in keywords]


def first_match(value: Column, rules: Rules, default: Column | None = None) -> Column:
    """Label of the first rule whose keyword is in value; else default (null if none)."""
    out = None
    for keyword, label in rules:
        hit = value.contains(keyword)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    default = F.lit(None).cast("string") if default is None else default
    return default if out is None else out.otherwise(default)


def detect_label(question: Column, reply: Column | None = None, rules: Rules | None = None) -> Column:
    """Law label of a question: by rule, else a provider's reply if it is exactly a known label, else ALL."""
    rules = list(question_rules() if rules is None else rules)
    known = F.lit(None).cast("string") if reply is None else F.when(F.trim(reply).isin(sorted({label for _, label in rules})), F.trim(reply))
    return F.coalesce(first_match(F.lower(question), rules), known, F.lit(ALL))


def infer_tax_type(law_name: Column, rules: Rules = LAW_NAME_RULES) -> Column:
    return first_match(law_name, rules, law_name)


def classify_file(filename: Column, category_reply: Column | None = None, law_reply: Column | None = None, category_rules: Rules = FILE_CATEGORY_RULES, law_rules: Rules = FILE_LAW_RULES) -> tuple[Column, Column]:
    """(category, law) of a file: by rule, else the provider's field, else the default."""
    reply = lambda c: F.lit(None).cast("string") if c is None else c
    return (
        F.coalesce(first_match(filename, category_rules), reply(category_reply), F.lit(OTHER_CATEGORY)),
        F.coalesce(first_match(filename, law_rules), reply(law_reply), F.lit(COMMON_LAW)),
    )


def lookup(value: Column, mapping: Mapping[str, object], default: object) -> Column:
    """Mapped value, or the default for unknown and null values."""
    out = None
    for key, mapped in mapping.items():
        out = F.when(value == key, F.lit(mapped)) if out is None else out.when(value == key, F.lit(mapped))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


# Rank and kind of sources.
LAW_PRIORITY, LAW_PRIORITY_DEFAULT = {"법률": 0, "대통령령": 1, "총리령": 2, "부령": 2}, 2
LAW_SOURCE, LAW_SOURCE_DEFAULT = {"법률": "law", "대통령령": "regulation", "총리령": "rule", "부령": "rule"}, "law"
CATEGORY_PRIORITY, CATEGORY_PRIORITY_DEFAULT = {"법령": 3, "시행령": 4, "시행규칙": 5, "집행기준": 6, "기타": 7}, 7
CATEGORY_SOURCE, CATEGORY_SOURCE_DEFAULT = {"법령": "law", "시행령": "regulation", "시행규칙": "rule", "집행기준": "practice_pdf", "기타": "user_pdf"}, "user_pdf"
