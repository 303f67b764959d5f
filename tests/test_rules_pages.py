"""Rules in thousands against one branch a rule, and the stream of search pages over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import rule_automaton, rules
from statuta.sources import law_api

TEXTS = ["", "abcabd", "세법과 관세", "관세법 주세", "zzz", None, "ab", "a\x00b", "bab" * 500]


def test_automaton_equals_branches(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("abc세법", k=rng.randrange(12))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for n in (0, 1, 30):
        made = [("".join(rng.choices("abc세법", k=rng.randrange(1, 4))), f"L{i}") for i in range(n)] + [("a\x00", "nul")] * (n > 1)
        both = rows.select(rule_automaton.first_rule(F.col("text"), made, F.lit("d")).alias("x"), rules.first_match(F.col("text"), made, F.lit("d")).alias("y"))
        assert both.where("x IS DISTINCT FROM y").count() == 0
    question = rules.question_rules()
    asked = spark.createDataFrame([("부가세와 소득세",), ("VAT",), ("상속",), ("x",)], "q string")
    assert [r[0] for r in asked.select(rule_automaton.first_rule(F.lower("q"), question)).collect()] == [r[0] for r in asked.select(rules.first_match(F.lower("q"), question)).collect()]


def test_rules_as_data(spark):
    made = spark.createDataFrame([("b", "second", 2), ("b", "first", 1), ("", "all", 5), (None, "no", 0), ("c", None, 3), ("d", "last", None)], "keyword string, label string, rank int")
    listed = rule_automaton.listed(made)
    assert listed == [("b", "first"), ("b", "second"), ("c", None), ("", "all"), ("d", "last")]
    rows = spark.createDataFrame([("xb",), ("c",), ("d",), (None,)], "text string")
    found = [r[0] for r in rows.select(rule_automaton.first_rule(F.col("text"), listed, F.lit("none"))).collect()]
    assert found == ["first", None, "all", "none"]  # a null label is a label
    with pytest.raises(ValueError):
        rule_automaton.listed(made, 5)


def test_thousands_of_rules(spark):
    made = [(f"key{i}x", str(i)) for i in range(20_000)]
    rows = spark.createDataFrame([(i, f"... key{i + 5}x key{i}x key{i} ...") for i in range(0, 20_000, 97)], "id long, text string")
    found = rows.select("id", rule_automaton.first_rule(F.col("text"), made).alias("label")).collect()
    assert all(r["label"] == str(r["id"]) for r in found)


def reply(names, total):
    return f"<LawSearch><totalCnt>{total}</totalCnt>" + "".join(f"<law><법령일련번호>{n}</법령일련번호></law>" for n in names) + "</LawSearch>"


def test_stream_of_pages_reads_no_page_twice(spark, tmp_path):
    pages, out, at = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "at")
    pages.mkdir()
    put = lambda name, xml: (pages / f"{name}.xml").write_text(xml, encoding="utf-8")
    spark.dataSource.register(law_api.LawSearchSource)

    def run(keywords="가,나,다"):
        rows = spark.readStream.format("law_search").options(keywords=keywords, pages=str(pages), display="2").load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["keyword"], r["position"], r["mst"], r["error"] is not None) for r in spark.read.schema(law_api.SCHEMA).parquet(out).collect())

    put("가-1", reply("12", 3)), put("나-1", "<broken"), put("가-3", reply("9", 3))
    first = [("가", 0, "1", False), ("가", 1, "2", False), ("나", 0, None, True)]
    assert run() == first
    put("가-1", reply("xy", 3))  # pages of finished batches are not read again
    assert run() == first
    put("가-2", reply("34", 5)), put("다-1", reply("7", 1)), put("라-1", reply("8", 1))
    assert run("가,나,다,라") == sorted(first + [("가", 2, "3", False), ("가", 3, "4", False), ("가", 4, "9", False), ("다", 0, "7", False), ("라", 0, "8", False)])


def test_stream_asks_how_many_pages(monkeypatch):
    asked = []

    def get(url, query):
        asked.append((query["display"], query["page"]))
        return "<broken" if query["query"] == "나" else reply("12", 5)

    monkeypatch.setattr(law_api, "get", get)
    stream = law_api.LawSearchStream({"keywords": "가,나", "url": "u", "api_key": "k", "display": "2", "max_results": "4"})
    assert stream.latestOffset() == {"가": 2, "나": 1} and asked == [(1, 1), (1, 1)]
    assert [(p.keyword, p.page) for p in stream.partitions({"가": 1}, {"가": 2, "나": 1})] == [("가", 2), ("나", 1)]
    assert [r[2] for r in stream.read(law_api.Page(0, "가", 2))] == [2, 3] and next(stream.read(law_api.Page(1, "나", 1)))[-1]


def test_stream_of_many_pages_has_few_tasks_and_lists_once(tmp_path, monkeypatch):
    for i in range(1, 1001):
        (tmp_path / f"가-{i}.xml").write_text("<broken" if i == 500 else reply([i], 1000), encoding="utf-8")
    (tmp_path / "나-1.xml").write_text(reply("7", 1), encoding="utf-8"), (tmp_path / "나-3.xml").write_text(reply("9", 1), encoding="utf-8")
    listed = []
    monkeypatch.setattr(law_api, "exists", lambda fs, path: listed.append(path) or True)
    stream = law_api.LawSearchStream({"keywords": "가,나", "pages": str(tmp_path), "display": "1"})
    end = stream.latestOffset()
    assert end == {"가": 1000, "나": 1} and not listed  # one listing, no look at each page
    runs = stream.partitions(stream.initialOffset(), end)
    assert len(runs) <= law_api.TASKS + 2
    rows = [r for run in runs for r in stream.read(run)]
    assert [(r[0], r[2]) for r in rows] == [("가", i) for i in range(1000)] + [("나", 0)]
    assert [r[2] for r in rows if r[-1]] == [499]  # a page that fails leaves the rest of its run
