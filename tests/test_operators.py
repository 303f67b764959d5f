"""Operators on small tables of their own, and the values that the engine has to give."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators import chunking, conversation, discovery, retrieval, rules, store, vector
from statuta.schemas import DOCUMENTS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_text_functions(spark):
    assert one(spark, T.article_no(F.lit("1"), F.lit(""))) == "제1조"
    assert one(spark, T.article_no(F.lit("3"), F.lit("2"))) == "제3조의2"
    assert one(spark, T.article_no(F.lit(""), F.lit(""))) == ""
    assert re.fullmatch("[0-9a-f]{64}", one(spark, T.content_hash(F.lit("조문"))))
    text = one(spark, T.embed_text(*map(F.lit, ("소득세법", "법률", "소득세법", "제1조", "목적", "본문"))))
    assert text == "법령명: 소득세법\n문서유형: 법률\n세목: 소득세법\n조문: 제1조\n제목: 목적\n내용:\n본문"
    assert one(spark, T.preview(F.lit("a\n" * 60))) == "a " * 40 + "..."


def twin(text):
    """The rules of normalisation in plain Python."""
    text = unicodedata.normalize("NFC", text or "")
    text = re.sub("[​‌‍﻿­]", "", text).replace("\t", " ")
    text = re.sub("\n{3,}", "\n\n", re.sub(" {2,}", " ", text))
    return "\n".join(line.strip() for line in text.splitlines()).strip()


def test_normalize_equals_python(spark):
    rng = random.Random(3)
    odd = " \t\n\r 　\u0085 ​﻿­ab가하é\x1c\x0b"
    texts = ["", None, "   ", "a\n \n \nb", "a\n\n\n\nb", "  x  ", "é"] + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    rows = T.normalize_rows(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "clean").collect()
    assert {r["id"]: r["clean"] for r in rows} == {i: twin(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("question, label", [("종합소득 신고", "소득세법"), ("VAT 환급", "부가가치세법"), ("취득세율", "지방세법"), ("지방세특례 감면", "지방세법"), ("날씨", "ALL")])
def test_detect_label(spark, question, label):
    assert one(spark, rules.detect_label(F.lit(question))) == label


def test_rules(spark):
    assert one(spark, rules.detect_label(F.lit("x"), F.lit("관세법"))) == "관세법"
    assert one(spark, rules.detect_label(F.lit("x"), F.lit("그런 법"))) == "ALL"
    for name, tax in (("지방세기본법 시행령", "지방세기본법"), ("지방세법", "지방세법"), ("증여세 사무", "상속세및증여세법"), ("도로법", "도로법")):
        assert one(spark, rules.infer_tax_type(F.lit(name))) == tax
    category, law = rules.classify_file(F.lit("소득세법(대통령령).pdf"))
    assert (one(spark, category), one(spark, law)) == ("시행령", "소득세법")
    category, law = rules.classify_file(F.lit("메모.pdf"), F.lit(None).cast("string"), F.lit("관세법"))
    assert (one(spark, category), one(spark, law)) == ("기타", "관세법")
    assert len(rules.QUESTION_RULES) == 22 and len(rules.question_rules()) == 74


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 799, 800, 801, 1500, 1501, 2200])
def test_chunk_windows(spark, n):
    starts, at = [], 0
    while n:
        starts.append((at, min(800, n - at)))
        if at + 800 >= n:
            break
        at += 700
    df = chunking.chunk(spark.createDataFrame([(1, " ".join(map(str, range(n))))], "id int, text string"), "text", ["id"])
    rows = sorted(df.collect(), key=lambda r: r["chunk_index"])
    assert [(r["start"], r["n_tokens"]) for r in rows] == starts
    assert all(r["content"].split() == [str(i) for i in range(r["start"], r["start"] + r["n_tokens"])] for r in rows)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [1.0, 1.0])], "id long, embedding array<float>")
    found = [(r["id"], round(r["similarity"], 4), r["rank"]) for r in vector.top_k(rows, [1.0, 0.0], 3).orderBy("rank").collect()]
    assert found == [(1, 1.0, 1), (4, 1.0, 2), (5, 0.7071, 3)]
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "question_id long, embedding array<float>")
    batch = [(r["question_id"], r["id"], r["rank"]) for r in vector.batch_top_k(rows, asked, 3).orderBy("rank").collect()]
    assert batch == [(7, 1, 1), (7, 4, 2), (7, 5, 3)]


def test_batch_top_k_of_unequal_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [1.0]), (3, [1.0, 1.0]), (4, [None, 1.0]), (5, None), (6, [0.0, 0.0])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 1.0]), (3, [2.0]), (4, None), (5, [None, 1.0]), (6, [0.0, 0.0])], "question_id long, embedding array<float>")
    found = {(r["question_id"], r["id"], round(r["similarity"], 6)) for r in vector.batch_top_k(rows, asked, 5).collect()}
    assert {(1, 3, 0.707107), (2, 1, 1.0), (3, 2, 1.0)} == {x for x in found if x[0] < 6}


def library(spark):
    law = spark.createDataFrame(
        [(i, "법", "부령", "ALL", f"제{i}조", "", "본문", "", [1.0, float(i)], True) for i in range(1, 4)],
        "id long, law_name string, law_type string, tax_type string, article_no string, article_title string, article_text string, source_url string, embedding array<float>, is_current boolean",
    )
    documents = spark.createDataFrame([(9, "내용", [1.0, 0.0], ("f.pdf", "공통", None, "u", 0), "me", None)], DOCUMENTS)
    return law, documents


def test_retrieval_order_and_guards(spark):
    law, documents = library(spark)
    found = retrieval.hybrid_search(law, documents, [1.0, 0.0], "me", threshold=0.3).orderBy("rank").collect()
    assert [r["source_type"] for r in found] == ["rule", "rule", "rule", "user_pdf"]  # 0.71, 0.45, 0.32 stand before 1.0
    assert [r["similarity_score"] for r in found] == [0.7071, 0.4472, 0.3162, 1.0]
    assert retrieval.hybrid_search(law, documents, [1.0, 0.0], "other", threshold=0.4).count() == 2
    empty = retrieval.hybrid_search(law, documents, [-1.0, 0.0], "me")
    assert empty.count() == 0 and retrieval.context(empty).head()["context"] == retrieval.NOT_FOUND
    text = retrieval.context(retrieval.hybrid_search(law, documents, [1.0, 0.0], "me")).head()["context"]
    assert text.count("\n\n---\n\n") == 2 and text.startswith("[출처: 법 | 법 | 📌 부령 (rule)]\n제1조\n본문")
    with pytest.raises(ValueError):
        retrieval.hybrid_search(law, documents, [1.0, 0.0], "")


def test_store(spark):
    kept = spark.createDataFrame([("a", "1", "h")], "law_name string, article_no string, content_hash string")
    batch = spark.createDataFrame([(1, "a", "1", "h"), (2, "a", "1", "new"), (3, "a", "1", "new"), (4, "b", "1", "h")], "position long, law_name string, article_no string, content_hash string")
    status = store.insert_status(batch, kept)
    assert {r["position"]: r["status"] for r in status.collect()} == {1: "skipped", 2: "inserted", 3: "skipped", 4: "inserted"}
    assert {r["position"]: r["id"] for r in store.inserted(status, 10).collect()} == {2: 10, 4: 11}
    again = store.insert_status(batch, kept.unionByName(status.where("status = 'inserted'").select(*kept.columns)))
    assert {r["status"] for r in again.collect()} == {"skipped"}
    _, documents = library(spark)
    left, n = store.delete(documents, "f.pdf", "me")
    assert (left.count(), n) == (0, 1)
    with pytest.raises(LookupError):
        store.delete(documents, "f.pdf", "you")


def test_inserted_ids_of_many_ranges(spark):
    """Ranges that adaptive execution merges by their bytes differ between a plan of the keys alone and one of whole rows."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    before = [spark.conf.get(k, None) for k in keys]
    try:
        for k, v in zip(keys, ("16", "128k", "128k")):
            spark.conf.set(k, v)
        status = spark.range(60_000).select(F.col("id").alias("position"), F.sha2(F.col("id").cast("string"), 512).alias("h"), F.when(F.col("id") % 7 == 0, "skipped").otherwise("inserted").alias("status"))
        rows = sorted((r["position"], r["id"]) for r in store.inserted(status.repartition(8), 1000).select("position", "id").collect())
        assert rows == [(p, 1000 + k) for k, p in enumerate(p for p in range(60_000) if p % 7)]
        assert store.inserted(status.limit(0), 1000).columns == ["position", "h", "id"]
    finally:
        for k, v in zip(keys, before):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = spark.createDataFrame([("a.PDF", 5, "x"), ("a.txt", 5, "x"), ("b.pdf", 50, "x"), ("c.pdf", 5, " ")], "path string, length int, text string")
    assert [r["reject_code"] for r in store.guard_upload(files, 10).collect()] == [None, 400, 413, 422]
    rows = spark.createDataFrame([(1, None), (2, None), (3, [1.0, 2.0]), (4, None)], "id long, embedding array<float>")
    new = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0])], "id long, embedding array<float>")
    assert {r["id"]: r["embed_status"] for r in store.backfill(rows, new, 2).collect()} == {1: "embedded", 2: "failed", 3: "kept", 4: "missing"}


def test_discovery(spark):
    rows = spark.createDataFrame([(0, 1, "m1", "국세청"), (1, 0, "m1", "국세청"), (0, 2, "m2", "환경부"), (1, 1, "m3", "기획재정부 세제실")], "keyword_rank int, position int, mst string, ministry string")
    assert {(r["mst"], r["keyword_rank"]) for r in discovery.discover(rows).collect()} == {("m1", 0), ("m3", 1)}


def test_conversation(spark):
    logs = spark.createDataFrame([("s", i, (("user", "assistant")[i % 2], f"t{i}"), 0) for i in range(9)], "session_id string, id long, message struct<role:string,content:string>, created_at int")
    history = conversation.transcript(conversation.last_messages(logs)).head()["history"]
    assert [m["content"] for m in history] == [f"t{i}" for i in range(3, 9)]
    made = conversation.transcript(conversation.last_messages(logs)).select(conversation.final_messages("S", F.col("history"), F.lit("Q"), F.lit("A"), F.lit("W")).alias("m")).head()["m"]
    assert (made[0]["role"], made[-1]["role"], len(made)) == ("system", "user", 8) and all(x in made[-1]["content"] for x in "QAW")
    gap = conversation.parse_gap(F.lit('<think>a</think> {"gap_found": "x", "search_queries": ["q"], "search_required": true}'))
    assert one(spark, conversation.wants_search(gap)) is True
    for bad in ("<think>a</think>", "no json", '{"search_required": true, "search_queries": []}'):
        assert one(spark, conversation.wants_search(conversation.parse_gap(F.lit(bad)))) is False
    results = spark.createDataFrame([("k", q, r, None if r else f"u{q}", "c" * 600) for q in range(4) for r in range(4)], "key string, query_idx int, rank int, url string, content string")
    web = conversation.web_text(results, "key").head()["web"]
    assert web.count("[출처: ") == 9 and web.count("c") == 9 * 500 and "[출처: ?]" in web and "u3" not in web


def test_failed_and_updated_rows(spark):
    batch = spark.createDataFrame([(1, "a", "1", "h"), (2, "a", None, "h"), (3, "a", "1", "h")], "position long, law_name string, article_no string, content_hash string")
    assert [r["status"] for r in store.insert_status(batch, batch.limit(0)).orderBy("position").collect()] == ["inserted", "failed", "skipped"]
    old = spark.createDataFrame([(1, None), (2, [1.0])], "id long, embedding array<float>").withColumn("updated_at", F.timestamp_seconds(F.lit(0)))
    rows = {r["id"]: r for r in store.backfill(old, spark.createDataFrame([(1, [2.0]), (2, [3.0])], "id long, embedding array<float>"), 1).collect()}
    assert rows[1]["updated_at"].year > 2000 and rows[2]["updated_at"].year < 2000 and rows[2]["embedding"] == [1.0]


def test_tenant():
    assert retrieval.tenant("6F9619FF8B86D011B42D00C04FC964FF") == "6f9619ff-8b86-d011-b42d-00c04fc964ff"
    for bad in ("", "x"):
        with pytest.raises(ValueError):
            retrieval.tenant(bad)


def test_chunks_of_a_tokenizer(spark):
    letters = chunking.Tokenizer(lambda t: [ord(c) for c in t], lambda n: "".join(map(chr, n)))
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "ab")], "id int, text string")
    made = chunking.chunk(df, "text", ["id"], 4, 1, letters).orderBy("id", "chunk_index").collect()
    assert [(r["id"], r["content"]) for r in made] == [(1, "abcd"), (1, "defg"), (4, "ab")]


def test_batch_search_keeps_to_its_scope(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [1.0, 0.0], None)], "id long, embedding array<double>, kind string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "b"), (2, [1.0, 0.0], None), (3, [1.0, 0.0], "none")], "question_id long, embedding array<double>, k string")
    found = vector.batch_top_k(rows, asked, 2, same=[("kind", F.col("k"))])
    assert sorted((r["question_id"], r["id"]) for r in found.collect()) == [(1, 2), (2, 1), (2, 3)]


@pytest.mark.parametrize("row_block, query_block", [(20_000, 1024), (7, 3)])
def test_scoped_search_equals_the_masked_one(spark, monkeypatch, row_block, query_block):
    monkeypatch.setattr(vector, "ROW_BLOCK", row_block)
    monkeypatch.setattr(vector, "QUERY_BLOCK", query_block)
    rng = random.Random(3)
    made = lambda n: [rng.choice([0.0, 1.0, 2.0, -1.0]) for _ in range(n)]
    users = ["a"] * 8 + ["b", "c", None]
    rows = [(i, made(rng.choice([3, 3, 2])), rng.choice(users), rng.choice("xy")) for i in range(150)] + [(900, None, "a", "x"), (901, [1.0, None, 1.0], "a", "x"), (902, [], "a", "x")]
    asked = [(i, made(3), rng.choice(["a", "b", "nobody"]), rng.choice(["x", None])) for i in range(20)]
    rows = spark.createDataFrame(rows, "id long, embedding array<double>, user string, law string")
    asked = spark.createDataFrame(asked, "question_id long, embedding array<double>, u string, l string")
    found = vector.scoped_top_k(rows, asked, 4, ("user", F.col("u")), same=[("law", F.col("l"))])
    wanted = vector.batch_top_k(rows, asked, 4, same=[("user", F.col("u")), ("law", F.col("l"))])
    plain = lambda df: sorted((r["question_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in df.collect())
    assert plain(found) == plain(wanted) and len(plain(found)) > 30
    assert vector.scoped_top_k(rows.limit(0), asked, 4, ("user", F.col("u"))).collect() == []


def test_failed_calls_leave_other_questions(spark):
    from statuta.operators import chat
    from statuta.schemas import CHAT_LOGS

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise OSError
        return ["<think>t</think>ok"] * len(prompts)

    asked = spark.createDataFrame([(1, 7, "u", "bad", [1.0]), (2, 7, "u", "good", [1.0])], "question_id long, session_id string, user_id string, text string, embedding array<double>").repartition(2, "question_id")
    law = spark.createDataFrame([], "id long, law_name string, law_type string, tax_type string, article_no string, article_title string, article_text string, source_url string, embedding array<float>, is_current boolean")
    made = {r["question_id"]: r for r in chat.answers(asked, law, spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHAT_LOGS), model, search=lambda *a: []).collect()}
    assert made[2]["answer"] == "<think>t</think>ok" and made[2]["web"] == conversation.WEB_SKIPPED and made[2]["label"] == "ALL"
    assert made[1]["rag_answer"] is None and made[1]["answer"] is None


def test_targets_and_pending(spark):
    from statuta.operators import ingestion
    from statuta.sources import providers

    assert [r["tax_type"] for r in ingestion.targets(spark).orderBy("target_idx").collect()] == list(ingestion.TARGETS)
    results = spark.createDataFrame(
        [(0, 0, "1", "소득세법", "국세청"), (1, 0, "1", "소득세법", "국세청"), (1, 1, "2", "관세법 시행령", "관세청"), (1, 2, "3", "민법", "법무부"), (2, 0, None, None, None)],
        "keyword_rank int, position int, mst string, law_name string, ministry string",
    )
    assert [(r["law_name"], r["tax_type"]) for r in ingestion.found_targets(results).orderBy("target_idx").collect()] == [("소득세법", "소득세법"), ("관세법 시행령", "관세법")]
    stored = spark.createDataFrame(
        [(1, None, True, "a"), (2, None, False, "a"), (3, [1.0] * 4, True, "a"), (4, None, True, "b")], "id long, embedding array<float>, is_current boolean, tax_type string"
    ).selectExpr("*", "'l' law_name", "'t' law_type", "'1' article_no", "'' article_title", "'x' article_text")
    made = {r["id"]: r["embed_status"] for r in ingestion.backfill_pending(stored, providers.HashEmbedder(4), 4, "a").collect()}
    assert made == {1: "embedded", 2: "missing", 3: "kept", 4: "missing"}
    assert spark.range(1).select(ingestion.law_url(F.lit("7")).alias("u")).head()["u"] == "https://www.law.go.kr/lsInfoP.do?lsiSeq=7"
    report = spark.createDataFrame([(1, "a", None), (2, "b", "e")], "target_idx long, law_name string, error string")
    assert [r["law_name"] for r in ingestion.failures(report).collect()] == ["b"]
