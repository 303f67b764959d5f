"""First-match rules in thousands: one pass over a text finds all keywords, and the first rule wins.

rules.first_match makes a branch of each keyword, which suits tens of rules.
Here the rules are data (a table of keyword, label and rank); they are sent to
the tasks as a list whose size is checked, and a task makes one Aho-Corasick
automaton of them, so that a text costs its own length however many rules there
are.

Defined cases: a null text has no rule; an empty keyword is in every text, as
for first_match; null keywords are no rules; of equal keywords the first counts;
equal ranks go by keyword, then label; without rules every text has the default.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most characters of keywords and labels that are sent to the tasks.
MAX_CHARS = 32 << 20


def listed(rules: DataFrame, max_chars: int = MAX_CHARS) -> list[tuple[str, str | None]]:
    """The rules (keyword, label, rank) in their order; ValueError if they are over max_chars."""
    known = rules.where(F.col("keyword").isNotNull())
    size = known.agg(F.coalesce(F.sum(F.length("keyword") + F.coalesce(F.length("label"), F.lit(0))), F.lit(0))).head()[0]
    if size > max_chars:
        raise ValueError(f"rules have {size} characters, more than {max_chars}")
    return [(r["keyword"], r["label"]) for r in known.orderBy(F.asc_nulls_last("rank"), "keyword", "label").select("keyword", "label").collect()]


class FirstRule:
    """The place of the first rule whose keyword is in a text; None without one."""

    def __init__(self, keywords: Sequence[str]):
        self.machine, self.always = ahocorasick.Automaton(), None
        for place, keyword in enumerate(keywords):
            if not keyword:
                self.always = place if self.always is None else self.always
            elif keyword not in self.machine:
                self.machine.add_word(keyword, place)
        if len(self.machine):
            self.machine.make_automaton()

    def __call__(self, text: str | None) -> int | None:
        if text is None:
            return None
        found = min((place for _, place in self.machine.iter(text)), default=None) if len(self.machine) else None
        return min((p for p in (found, self.always) if p is not None), default=None)


def first_rule(value: Column, rules: Sequence[tuple[str, str | None]], default: Column | None = None) -> Column:
    """The label of the first rule whose keyword is in value, else default, as rules.first_match for any number of rules."""
    # A text without a rule is told from one whose rule has a null label.
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rule = FirstRule([keyword for keyword, _ in rules])
        for part in parts:
            places = [rule(t) for t in part]
            yield pd.DataFrame({"hit": [p is not None for p in places], "label": pd.Series([None if p is None else rules[p][1] for p in places], dtype=object)})

    found = F.pandas_udf(run, "hit boolean, label string")(value)
    default = F.lit(None).cast("string") if default is None else default
    return F.when(found["hit"], found["label"]).otherwise(default)
