"""Streams against their finished twins at every cut, timers, stateful ingestion, and the store in buckets."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from statuta.operators import buckets, store, upload
from statuta.sources import providers
from statuta.streaming import ingest, sse, think_filter

LINES = "stream_id string, seq long, line string"
TEXTS = ["<think>ab</think>cd", "<think> x", "no block at all but longer than thirty characters", "short", "<think>  \n", "</think>z", "a<think>b</think>c</think>d", "é" * 31]
ODD = [
    "", "{", "[]", "5", '"x"', "null", '{"message":5}', '{"message":null}', '{"message":{"content":5}}', '{"message":{"content":null},"done":0}', '{"done":1}', '{"done":"no"}', '{"done":""}',
    '{"done":[]}', '{"done":[1]}', '{"done":{}}', '{"done":{"a":1}}', '{"done":0.0}', '{"done":null}', '{"done":2.5}', '  {"message":{"content":"w"}}  ', '{"message":["content"]}', '{"a":1} x', "no json",
]


def line(content, done=False):
    return json.dumps({"message": {"content": content}, "done": done})


def by_machine(lines):
    machine = think_filter.Machine()
    out = list(machine.lines(enumerate(lines)))
    if not machine.over and lines and (last := machine.end()):
        out.append((len(lines) - 1, last))
    return out


def test_fold_equals_the_machine_at_every_cut(spark):
    rng, streams = random.Random(4), []
    for text in TEXTS:
        for i in range(len(text) + 1):
            for j in range(i, len(text) + 1, 4):
                a, b, c = text[:i], text[i:j], text[j:]
                streams += [[line(a), line(b), line(c)], [line(a), line(b, True), line(c)]]
    streams += [[line("<think>q</think>1"), odd, line("2")] for odd in ODD]
    streams += [[rng.choice([*ODD, line("ab"), line("<think>"), line("</think>"), line("x" * 20)]) for _ in range(rng.randrange(1, 9))] for _ in range(300)]
    rows = [(f"s{k}", i, text) for k, lines in enumerate(streams) for i, text in enumerate(lines)]
    made = think_filter.filter_batch(spark.createDataFrame(rows, LINES).repartition(4))
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    found = {}
    for r in made.collect():
        found.setdefault(r["stream_id"], []).append((r["seq"], r["chunk"]))
    for k, lines in enumerate(streams):
        assert sorted(found.get(f"s{k}", [])) == sorted(by_machine(lines)), lines


def test_streams_that_stop_are_ended_by_a_timer(spark, tmp_path):
    rows = [("held", 0, line("<think>never closed")), ("short", 0, line("a few")), ("done", 0, line("all there", True)), ("blank", 0, line("<think>  "))]
    late = [("short", 1, line("late", True)), ("done", 1, line("late"))]
    spark.conf.set(ingest.STATEFUL, ingest.ROCKS)
    stream = spark.readStream.schema(LINES).json(f"{tmp_path}/in/*")
    tail = think_filter.filter_stream(stream, 1500).writeStream.format("memory").queryName("tails").option("checkpointLocation", f"{tmp_path}/c1").trigger(processingTime="200 milliseconds").start()
    whole = think_filter.answer_stream(stream, 1500).writeStream.format("memory").queryName("wholes").option("checkpointLocation", f"{tmp_path}/c2").trigger(processingTime="200 milliseconds").start()
    try:
        spark.createDataFrame(rows, LINES).coalesce(1).write.json(f"{tmp_path}/in/0")
        until = time.time() + 60
        while time.time() < until and (spark.table("wholes").count() < 4 or spark.table("tails").count() < 3):
            time.sleep(0.5)
        spark.createDataFrame(late, LINES).coalesce(1).write.json(f"{tmp_path}/in/1")
        time.sleep(8)
        assert sorted(map(tuple, spark.table("tails").collect())) == [("done", 0, "all there"), ("held", 0, "never closed"), ("short", 0, "a few")]
        assert sorted(map(tuple, spark.table("wholes").collect())) == [("blank", "", "idle"), ("done", "all there", "done"), ("held", "never closed", "idle"), ("short", "a few", "idle")]
    finally:
        tail.stop()
        whole.stop()


BODY = 'data: {"chunk":"a"}\n\nnoise\n\ndata: {bad\n\ndata: {"chunk":"b\\n\\n"}\n\n\n\ndata: {"x":1}\n\ndata: {"chunk":7}\n\ndata: {"chunk":null}\n\ndata: [DONE]\n\ndata: {"chunk":"c"}\n\n'


def test_sse_pieces_equal_the_body_at_every_cut(spark):
    rng = random.Random(8)
    whole = {(r["place"], r["chunk"]) for r in think_filter.parse_sse(spark.createDataFrame([(1, BODY)], "id int, body string"), "id", "body").collect()}
    assert whole == {(0, "a"), (3, "b\n\n"), (6, "7")}
    for _ in range(200):  # the parser by itself, in many pieces
        at = sorted(rng.sample(range(len(BODY) + 1), rng.randrange(9)))
        parser = sse.Parser()
        assert {x for a, b in zip([0, *at], [*at, len(BODY)]) for x in parser.take(BODY[a:b])} == whole
    rows = [(f"c{i}", s, p) for i in range(len(BODY) + 1) for s, p in enumerate((BODY[:i], BODY[i:]))]
    pieces = spark.createDataFrame(rows, "stream_id string, seq long, piece string")
    found = {}
    for r in ingest.in_rounds([pieces.where("seq = 0"), pieces.where("seq = 1")], sse.parse_stream, "cuts").collect():
        found.setdefault(r["stream_id"], []).append((r["place"], r["chunk"]))
    assert len(found) == len(BODY) + 1 and all(len(x) == 3 and set(x) == whole for x in found.values())


ARTICLES = "position long, law_name string, article_no string, content_hash string, text string"


def test_stateful_ingestion_reads_no_store_and_repeats_nothing(spark, tmp_path):
    store_path, folder = f"{tmp_path}/store", f"{tmp_path}/in"
    spark.conf.set(ingest.STATEFUL, ingest.ROCKS)

    def arrive(number, rows):
        spark.createDataFrame(rows, ARTICLES).coalesce(1).write.parquet(f"{folder}/{number}")
        run = ingest.changes(spark.readStream.schema(ARTICLES).parquet(f"{folder}/*")).writeStream.foreachBatch(ingest.append_batches(store_path)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        return sum(p["numInputRows"] for p in run.recentProgress)

    assert arrive(0, [(2, "l", "1", "g", "y"), (1, "l", "1", "h", "x"), (3, None, "1", "h", "n"), (4, "l", "2", "h", "z")]) == 4
    assert arrive(1, [(5, "l", "1", "h", "x again"), (6, "l", "1", "k", "w")]) == 2  # however much came before
    assert arrive(2, [(7, "l", "1", "k", "w again")]) == 1
    os.makedirs(f"{store_path}/batch=9")  # a batch that never ended
    spark.createDataFrame([(99, "l", "1", "q", "?", 9)], ARTICLES + ", version int").write.parquet(f"{store_path}/half")
    for name in os.listdir(f"{store_path}/half"):
        if name.endswith(".parquet"):
            os.rename(f"{store_path}/half/{name}", f"{store_path}/batch=9/{name}")
    rows = ingest.stored(spark, store_path, ARTICLES + ", version int")
    found = sorted((r["position"], r["version"], r["is_current"]) for r in ingest.current(rows).collect())
    assert found == [(1, 1, False), (2, 2, False), (4, 1, True), (6, 3, True)]
    changed = spark.createDataFrame([(6, "l", "1", "k", "w", "inserted", 3)], ARTICLES + ", status string, version int")
    ingest.append_batches(store_path)(changed, 1)  # a batch that is tried again
    assert ingest.stored(spark, store_path, ARTICLES + ", version int").count() == 4


def test_batches_without_end_are_not_read(spark, tmp_path):
    write = ingest.append_new(f"{tmp_path}/s")
    schema = "position long, law_name string, article_no string, content_hash string"
    write(spark.createDataFrame([(1, "a", "1", "h")], schema), 0)
    os.remove(f"{tmp_path}/s/batch=0/_SUCCESS")
    write(spark.createDataFrame([(2, "a", "1", "h")], schema), 1)
    assert [r["position"] for r in ingest.stored(spark, f"{tmp_path}/s", schema).collect()] == [2]


META = "struct<source:string,law_name:string,category:string,uploader:string,chunk_index:int>"
DOCUMENTS = f"content string, metadata {META}, user_id string"


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_buckets_rewrite_what_they_touch(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = [(f"{s}-{u}-{i}", (s, None, None, "u", i), u) for s in [f"f{k}" for k in range(40)] + [None] for u in ("x", "y") for i in range(3)]
    documents = spark.createDataFrame(rows, DOCUMENTS)
    buckets.write(documents, path, 16)
    before = files_of(path)
    names = spark.createDataFrame([("f1", "x"), ("f2", "y"), ("f2", "y"), (None, "x"), ("new", "x")], "source string, user_id string")
    chunks = spark.createDataFrame([("one", ("f1", None, None, "u", 0), "x"), ("two", ("new", None, None, "u", 0), "x")], DOCUMENTS)
    touched = buckets.replace(spark, path, names, chunks)
    assert 0 < len(touched) <= 3
    after = files_of(path)
    same = {f for f, at in before.items() if after.get(f) == at}
    assert {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched} == same
    wanted = store.overwrite(store.overwrite(documents, chunks.where("metadata.source = 'f1'"), "f1", "x"), chunks.where("metadata.source = 'new'"), "f2", "y")
    assert sorted(r["content"] for r in buckets.read(spark, path).collect()) == sorted(r["content"] for r in wanted.collect())
    assert [r["content"] for r in buckets.of(spark, path, "f1", "x").collect()] == ["one"] and buckets.of(spark, path, "f2", "y").count() == 0
    with pytest.raises(ValueError):
        buckets.replace(spark, path, names, spark.createDataFrame([("three", ("f3", None, None, "u", 0), "x")], DOCUMENTS))
    assert buckets.replace(spark, path, names.limit(0), chunks.limit(0)) == []
    with pytest.raises(FileNotFoundError):
        buckets.read(spark, f"{tmp_path}/none")


def test_a_bucket_can_lose_all_its_rows(spark, tmp_path):
    path = f"{tmp_path}/store"
    buckets.write(spark.createDataFrame([("a", ("f", None, None, "u", 0), "x"), ("b", ("g", None, None, "u", 0), "x")], DOCUMENTS), path, 64)
    buckets.replace(spark, path, spark.createDataFrame([("f", "x")], "source string, user_id string"), spark.createDataFrame([], DOCUMENTS))
    assert [r["content"] for r in buckets.read(spark, path).collect()] == ["b"]


def test_white_space_replaces_nothing(spark):
    blank = ["\n\n", " \n　", "\x0b\x1c", "", None, " "]
    files = spark.createDataFrame([(i, "a.pdf", 10, text, "u", "u", None) for i, text in enumerate(blank)], "file_id long, path string, length long, text string, user_id string, uploader string, reply string")
    former = spark.createDataFrame([("kept", None, ("a.pdf", "l", "c", "u", 0), "u")], f"content string, embedding array<float>, metadata {META}, user_id string")
    documents, report = upload.upload(files, former, providers.HashEmbedder(4))
    assert {(r["reject_code"], r["chunks_stored"], r["status"]) for r in report.collect()} == {(422, 0, "rejected")}
    assert [r["content"] for r in documents.collect()] == ["kept"]
    words = files.limit(1).withColumn("text", F.lit("some words"))
    none = upload.chunking.Tokenizer(lambda text: [], lambda tokens: "")
    documents, report = upload.upload(words, former, providers.HashEmbedder(4), tokenizer=none)
    assert [(r["reject_code"], r["status"]) for r in report.collect()] == [(422, "rejected")] and documents.count() == 1
