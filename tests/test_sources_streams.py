"""XML, the paginated source, providers, and streams against their batch twins."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.sources import law_api, law_xml, providers
from statuta.streaming import ingest, think_filter

XML = """<법령><기본정보><법령명_한글>소득세법</법령명_한글><법종류>법률</법종류><시행일자>20260101</시행일자><공포일자>20251231</공포일자></기본정보><조문>
<조문단위><조문번호>1</조문번호><조문제목>목적</조문제목><조문내용>제1조(목적)</조문내용><항><항내용>① 하나</항내용></항><항><항내용> ② 둘 </항내용></항></조문단위>
<조문단위><조문번호>2</조문번호><조문여부>삭제</조문여부><조문내용>삭제</조문내용></조문단위>
<조문단위><조문번호>3</조문번호><조문가지번호>2</조문가지번호><조문내용><![CDATA[본문 < 글]]></조문내용></조문단위>
<조문단위><조문번호>4</조문번호><조문내용>  </조문내용></조문단위></조문></법령>"""


def test_parse_articles(spark):
    bare = "<법령><기본정보/><조문><조문><조문번호>1</조문번호><조내용>가</조내용></조문></조문></법령>"
    df = spark.createDataFrame([("1", XML, "h", "t"), ("2", "<a", "h", "t"), ("3", "", "h", "t"), ("4", None, "h", "t"), ("5", bare, "힌트", "대통령령")], "mst string, raw_xml string, n string, t string")
    rows = sorted(law_xml.parse_articles(df, name_hint="n", type_hint="t").collect(), key=lambda r: (r["mst"], r["position"]))
    assert [(r["mst"], r["article_no"]) for r in rows] == [("1", "제1조"), ("1", "제3조의2"), ("5", "제1조")]
    assert rows[0]["article_text"] == "제1조(목적)\n① 하나\n② 둘" and rows[1]["article_text"] == "본문 < 글"
    assert (rows[0]["law_name"], rows[0]["law_type"], rows[0]["effective_date"], rows[0]["amendment_date"]) == ("소득세법", "법률", "20260101", "20251231")
    assert (rows[2]["law_name"], rows[2]["law_type"]) == ("힌트", "대통령령")


def reply(names, total):
    laws = "".join(f"<law><법령일련번호>{n}</법령일련번호><법령명한글>{n}법</법령명한글><소관부처명>국세청</소관부처명></law>" for n in names)
    return f"<LawSearch><totalCnt>{total}</totalCnt>{laws}</LawSearch>"


def test_paginated_source(spark, tmp_path):
    (tmp_path / "가-1.xml").write_text(reply(["1", "2"], 3), encoding="utf-8")
    (tmp_path / "가-2.xml").write_text(reply(["2"], 3), encoding="utf-8")
    (tmp_path / "가-3.xml").write_text(reply(["9"], 3), encoding="utf-8")
    (tmp_path / "나-1.xml").write_text("<broken", encoding="utf-8")
    spark.dataSource.register(law_api.LawSearchSource)
    rows = spark.read.format("law_search").options(keywords="가,나,다", pages=str(tmp_path)).load().collect()
    assert sorted((r["keyword_rank"], r["position"], r["mst"]) for r in rows if r["error"] is None) == [(0, 0, "1"), (0, 1, "2"), (0, 2, "2")]
    assert [r["keyword"] for r in rows if r["error"]] == ["나"]
    with pytest.raises(ValueError):
        law_api.LawSearchReader({"keywords": "가"})


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    found = {r["id"]: r for r in providers.embed(rows, "text", "id", providers.HashEmbedder(8)).collect()}
    assert len(found[1]["embedding"]) == 8 and found[2]["error"] is None

    def broken(texts):
        raise OSError("down")

    assert {r["error"] for r in providers.embed(rows, "text", "id", broken).collect()} == {"OSError: down"}
    assert {r["reply"] for r in providers.reply(rows, "text", "id", broken).collect()} == {None}


def line(content, done=False):
    return json.dumps({"message": {"content": content}, "done": done})


CASES = {
    "split": (["<th", "ink>x</thi", "nk>an", "swer"], "answer"),
    "short": (["short"], "short"),
    "long": (["a" * 31, "<think>b</think>"], "a" * 31 + "<think>b</think>"),
    "open": (["<think>kept"], "kept"),
    "blank": (["<think>  "], ""),
}


def test_think_filter_cases(spark):
    rows = [(k, i, line(c)) for k, (chunks, _) in CASES.items() for i, c in enumerate(chunks)] + [("bad", 0, "{"), ("bad", 1, ""), ("bad", 2, line("ok", True)), ("bad", 3, line("late"))]
    made = think_filter.answers(think_filter.filter_batch(spark.createDataFrame(rows, "stream_id string, seq long, line string")))
    expected = {k: v for k, (_, v) in CASES.items() if v} | {"bad": "ok"}
    assert {r["stream_id"]: r["answer"] for r in made.collect()} == expected


def test_think_filter_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for s in range(20):
        text = rng.choice(["", "<think>some thought</think>"]) + "word " * rng.randint(1, 20)
        pieces = [text[i : i + 7] for i in range(0, len(text), 7)]
        rows += [(f"s{s}", i, line(p, i == len(pieces) - 1)) for i, p in enumerate(pieces)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, line string")
    for part in range(3):
        df.where(F.col("seq") % 100 >= 0).where((F.col("seq") / 6).cast("int") == part if part < 2 else F.col("seq") >= 12).coalesce(1).write.json(str(tmp_path / "in" / str(part)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    query = think_filter.filter_stream(stream).writeStream.format("memory").queryName("thoughts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["stream_id"]: r["answer"] for r in think_filter.answers(spark.table("thoughts")).collect()}
    assert got == {r["stream_id"]: r["answer"] for r in think_filter.answers(think_filter.filter_batch(df)).collect()}


def test_sse(spark):
    df = spark.createDataFrame([(1, 'data: {"chunk":"a"}\n\nnoise\n\ndata: {bad\n\ndata: {"chunk":"b"}\n\ndata: [DONE]\n\ndata: {"chunk":"c"}\n\n'), (2, 'data: {"chunk":"x"}\n\ndata: {"chunk":"cut"}')], "id int, body string")
    assert sorted((r["id"], r["chunk"]) for r in think_filter.parse_sse(df, "id", "body").collect()) == [(1, "a"), (1, "b"), (2, "x")]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    write = ingest.append_new(str(tmp_path / "store"))
    schema = "position long, law_name string, article_no string, content_hash string"
    write(spark.createDataFrame([(1, "a", "1", "h"), (2, "a", "1", "h")], schema), 0)
    for _ in range(2):
        write(spark.createDataFrame([(3, "a", "1", "h"), (4, "a", "2", "h")], schema), 1)
    assert sorted(r["position"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 4]


def test_single_page_and_details(spark, tmp_path):
    (tmp_path / "가-1.xml").write_text(reply(["1"], 9), encoding="utf-8")
    (tmp_path / "가-2.xml").write_text(reply(["2", "3"], 9), encoding="utf-8")
    spark.dataSource.register(law_api.LawSearchSource)
    rows = spark.read.format("law_search").options(keywords="가", pages=str(tmp_path), page="2").load().collect()
    assert [r["mst"] for r in rows] == ["2", "3"]

    def fetch(mst):
        if mst == "2":
            raise OSError("gone")
        return f"<{mst}/>"

    got = {r["mst"]: (r["raw_xml"], r["error"]) for r in law_api.details(spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "mst string"), fetch).collect()}
    assert got == {"1": ("<1/>", None), "2": (None, "OSError: gone")}
    with pytest.raises(ValueError):
        law_api.detail_of("http://localhost")


def test_web_search(spark):
    def search(query, results, domains):
        if query == "b":
            raise OSError
        return [{"url": query, "content": domains[0]}, {}, {"url": "3"}, {"url": "4"}]

    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, []), (3, None)], "id long, q array<string>")
    found = sorted((r["id"], r["query_idx"], r["rank"]) for r in providers.web_search(df, "id", "q", search).collect())
    assert found == [(1, q, r) for q in (0, 2) for r in range(3)]


def test_payloads_are_parsed_by_one_plan_and_once(spark):
    """One parsing step in the plan, with composed and decomposed letters alike, whatever the column of them."""
    unit = "<조문단위><조문번호>1</조문번호><조문제목>{}</조문제목><조문내용>{}</조문내용></조문단위>"
    texts = [("e\u0301", "plain"), ("plain", "e\u0301  x"), ("\u1112\u1161\u11ab", " a\t b"), ("t", "\u212b")]
    rows = spark.createDataFrame([(i, "<법령><조문>" + unit.format(*t) + "</조문></법령>") for i, t in enumerate(texts)], "mst int, raw_xml string")
    made = law_xml.parse_articles(rows)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = [(r["article_title"], r["article_text"]) for r in made.orderBy("mst").collect()]
    assert found == [("\u00e9", "plain"), ("plain", "\u00e9 x"), ("\ud55c", "a b"), ("t", "\u00c5")]


def test_clean_text_leaves_only_clean_texts_alone(spark):
    odd = [*T.SPACES, *map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD))]
    texts = [f"{a}x{b}y{c}" for o in odd for a, b, c in ((o, "", ""), ("", o, ""), ("", "", o), ("", o + o, ""))] + ["", "a b", "a\r\nb\r\n\r\n\r\n\r\nc"]
    found = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.clean_text(F.col("t"))).collect()]

    def plain(t):
        t = re.sub("[\u200b\u200c\u200d\ufeff\xad]", "", t).replace("\t", " ")
        t = re.sub("\n{3,}", "\n\n", re.sub(" {2,}", " ", t))
        return "\n".join(x.strip(T.SPACES) for x in re.split("\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", t)).strip(T.SPACES)

    assert found == list(map(plain, texts))
