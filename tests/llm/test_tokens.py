"""BPE, binary files, chat formatting and rollups: round trips and plain twins."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import binary_ids, bpe, chat, rollup
from llm.common import cut, shared_path, table

DATA = "/root/testdata/sf0.01"
RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ODD = [
    "", " ", "  a", " a", "a  b", "a \n b", "\n \nbar", "x" * 5000, "ab" * 3000, "é" * 300 + " ok", "don't we'll  '  b", "日本語 123 ４５ ²", "\t\t x", "<|endoftext|> a", "😀😀 😀",
]


def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(" \n\tab'stéß1２—.!😀  ") for _ in range(rng.randint(1, 200))) for _ in range(300)]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_equals_tiktoken(spark):
    twin = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rows = list(enumerate(texts())) + [(-1, None), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    found = bpe.encode(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    expected = {i: np.array(twin.encode_ordinary(t or ""), "<u4").tobytes() for i, t in rows}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found} == {i: (len(x) // 4, sha(x), sha((t or "").encode())) for (i, t), x in zip(rows, expected.values())}
    assert bpe.encode(df.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_bpe_on_documents(spark):
    twin = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    encode = bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode_batch
    all_texts = [r["text"] for r in table(spark, DATA, "documents").collect()]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(all_texts)] == [twin.encode_ordinary(t) for t in all_texts]


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2 ** (rng.random(n) * 32)).astype("<u4")
        assert (binary_ids.unpack(*binary_ids.pack(ranks), n) == ranks).all()
    docs = [(5, 2, *binary_ids.pack(np.array([1, 300]))), (binary_ids.NULL_ID, 1, *binary_ids.pack(np.array([70_000])))]
    back = [(d, b, r.tolist()) for d, b, r in binary_ids.read_file(binary_ids.file_bytes(docs, 10))]
    assert back == [(5, 10, [1, 300]), (None, 12, [70_000])]
    with pytest.raises(ValueError):
        list(binary_ids.read_file(b"other"))


def read_back(spark, df):
    ids = cut(binary_ids.token_ids(df, public_tokenizers.path("byte_bpe_50k.json")))
    folder = shared_path(spark, "t")
    return binary_ids.read_files(spark, folder, binary_ids.write_files(ids, folder)).collect()


@pytest.mark.parametrize("sizes", [(4_000_000, 8_000_000), (20_000, 5_000)])
def test_binary_files(spark, monkeypatch, sizes):
    monkeypatch.setattr(binary_ids, "RANGE_IDS", sizes[0])
    monkeypatch.setattr(binary_ids, "FILE_IDS", sizes[1])
    twin = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, DATA, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts())] + [(-5, None)], "doc_id long, text string"))
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    expected, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*twin.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in read_back(spark, docs)) == expected


def test_words_and_pieces_equal_the_library():
    rng, path = random.Random(5), public_tokenizers.path("byte_bpe_50k.json")
    ids, twin = binary_ids.Ids(path), Tokenizer.from_file(path)
    odd = ["a <|endoftext|> b", "x\n\ny z", "a\0 b c", "a.\nb,\nc!? d?!\n", "\u00b2 foo_. bar's, it'S.", ". . ,", "a b. c\u0085d", "b" * 300 + ". c", ""]
    for text in odd + ["".join(rng.choice("ab .,\n_'\u00bd\u00e9\t\u65e5<") for _ in range(rng.randint(1, 30))) for _ in range(500)]:
        assert ids([text])[0] == np.array(twin.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert all(len(w) <= binary_ids.KEPT_CHARS for w in ids.young)


def test_binary_files_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert read_back(spark, spark.createDataFrame([], schema)) == []
    rows = read_back(spark, spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], schema))
    assert sorted(r["start"] for r in rows) == [0, 2, 4] and [r["doc_id"] for r in rows].count(None) == 1


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a ### b </turn>\n c \\s \\\\ ####"), (1, 2, "user", None), (2, 0, "assistant", ""), (2, 1, "assistant", "### Assistant: x"),
    (3, 0, "user", "only"), (4, 5, "odd: role\\</turn>", "x"), (4, 5, "Assistant", "y"), (4, None, None, "z"), (None, 0, "user", "null id"), (5, 0, "user", "same"), (5, 0, "user", "same"),
]


def test_chat_read_back_and_masks(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("target", F.lit("clash"))
    found = {r["conv_id"]: r for r in chat.digests(chat.format_examples(df)).collect()}
    plain = {}
    for c, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        plain.setdefault(c, []).append((role or "", text or ""))
    for c, turns in plain.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert found[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns).encode()), c
        assert (found[c]["n_turns"], found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(turns), len(loss), sha(loss.encode()))
    examples = chat.format_examples(df).collect()
    assert found[1]["formatted_chars"] == sum(len(e["context"] + e["target"]) for e in examples if e["conv_id"] == 1)
    second = next(e for e in examples if e["conv_id"] == 2 and e["example"] == 1)
    assert second["context"] == "### Assistant: </turn>\n### Assistant: " and second["target"] == "#\\s## Assistant: x</turn>\n"
    assert chat.digests(chat.format_examples(df.limit(0))).count() == 0


def test_chat_plan_has_no_python_and_one_shuffle(spark):
    plan = chat.op4_chat_format(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange ") == 1


def change(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer_version string, n_tokens long, sign int, n_docs string")


def test_rollup_batches_are_idempotent(spark):
    store = rollup.Rollup(spark, shared_path(spark, "r"))
    assert store.totals().count() == 0
    assert store.commit("1", change(spark, [("a", "en", "v1", 5, 1, "x"), ("a", "en", "v1", 7, None, "x"), (None, None, "v1", None, 1, "x"), ("b", "en", "v1", 3, 1, "x")]))
    fix = change(spark, [("a", "en", "v1", 5, -1, "x"), ("a", "en", "v2", 6, 1, "x"), ("b", "en", "v1", 3, -1, "x")])
    assert store.commit("2", fix) and not store.commit("2", fix) and store.commit("3", fix.limit(0))
    expected = {("a", "en", "v1", 1, 7), ("a", "en", "v2", 1, 6), (None, None, "v1", 1, 0)}
    assert {tuple(r) for r in store.totals().collect()} == expected
    assert {tuple(r) for r in store.compact(shared_path(spark, "r2")).totals().collect()} == expected
    assert store.committed() == {"1", "2", "3"}
    new = store.compact(shared_path(spark, "r3"))
    assert new.committed() == {"1", "2", "3"} and not new.commit("2", fix) and new.commit("4", fix.limit(0))
    assert {tuple(r) for r in new.totals().collect()} == expected and new.committed() == {"1", "2", "3", "4"}
    with pytest.raises(ValueError):
        store.commit("a/b", fix)
