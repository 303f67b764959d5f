"""The pivot index against a scan, and the memo's calls when tasks and runs fail."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.operators import memo, pivots, vector

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ROWS, QUESTIONS = "id long, embedding array<float>, kind string", "question_id long, embedding array<float>, want string"


def clustered(seed, n, centres, noise=0.05, dimensions=12):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=(centres, dimensions))
    return (middle[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dimensions))).astype(np.float32)


def listed(found):
    return sorted((r["question_id"], r["rank"], r["id"], round(r["similarity"], 6)) for r in found.collect())


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(clustered(1, 2000, 20))]
    data += [(5000 + i, data[7][1], "b") for i in range(900)]  # a third are copies
    data += [(9000, None, "a"), (9001, [], "a"), (9002, [0.0] * 12, "a"), (9003, [1.0, None] + [0.0] * 10, "a"), (9004, [1.0] * 5, "a")]
    return spark.createDataFrame(data, ROWS)


@pytest.fixture(scope="module")
def questions(spark):
    data = [(i, v.tolist(), "a" if i % 4 == 0 else None) for i, v in enumerate(clustered(2, 25, 20))]
    data += [(100, clustered(1, 8, 20)[7].tolist(), None), (101, None, None), (102, [1.0] * 5, None)]
    return spark.createDataFrame(data, QUESTIONS)


@pytest.mark.parametrize("k", [1, 10, 1200])
def test_pivots_find_what_a_scan_finds(spark, rows, questions, tmp_path, k):
    pivots.build(rows, str(tmp_path / "i"), 12, pivots=16, rings=4, others=["kind"])
    fits = questions.where(F.size("embedding") == 12)
    found = pivots.search(spark, str(tmp_path / "i"), questions, k, same=[("kind", "want")])
    assert listed(found.nearest) == listed(vector.batch_top_k(rows, fits, k, same=[("kind", F.col("want"))]))
    work = {r["question_id"]: r["rows_read"] for r in found.work.collect()}
    assert set(work) == {r["question_id"] for r in fits.collect()} and max(work.values()) <= 2900
    if k == 1:
        assert np.median(list(work.values())) < 2900 / 4  # clusters are left out


@pytest.mark.parametrize("n", [0, 1, 40])
def test_pivots_on_small_and_equal_tables(spark, tmp_path, n):
    rows = spark.createDataFrame([(i, [1.0, 2.0], "a") for i in range(n)], ROWS)
    wanted = spark.createDataFrame([(1, [2.0, 4.0], None), (2, [-1.0, 0.5], None), (3, [0.0, 0.0], None)], QUESTIONS)
    pivots.build(rows, str(tmp_path / "i"), 2)
    found = listed(pivots.search(spark, str(tmp_path / "i"), wanted, 5).nearest)
    assert found == listed(vector.batch_top_k(rows, wanted.where("question_id < 3"), 5)) and len(found) == 2 * min(n, 5)


def test_pivots_without_clusters_read_all_and_stay_exact(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(rng.normal(size=(600, 30)).astype(np.float32))], ROWS)
    wanted = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(rng.normal(size=(6, 30)).astype(np.float32))], QUESTIONS)
    pivots.build(rows, str(tmp_path / "i"), 30, pivots=8, rings=4)
    found = pivots.search(spark, str(tmp_path / "i"), wanted, 10)
    assert listed(found.nearest) == listed(vector.batch_top_k(rows, wanted, 10))


def counting(folder, kills=None, fails=None):
    """An embedder that notes each text it is asked for, fails at one text, and dies at another until it has done so once."""
    folder = str(folder)

    def embed(texts):  # no name of this module, which workers cannot import
        if fails in texts:
            raise OSError("busy")
        if kills in texts and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        with open(f"{folder}/asked", "a") as out:
            out.write("".join(f"{t}\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def asked(folder):
    path = f"{folder}/asked"
    return sorted(open(path).read().splitlines()) if os.path.exists(path) else []


def vectors(found):
    return sorted((r["id"], tuple(r["embedding"] or ()), r["error"]) for r in found.collect())


def test_memo_asks_for_each_text_once(spark, tmp_path):
    one = spark.createDataFrame([(i, f"text {i % 40:02}") for i in range(120)] + [(500, None), (501, "")], "id long, text string")
    two = one.unionByName(spark.createDataFrame([(900, "another")], "id long, text string")).withColumn("content_key", F.lit("clash"))
    model, store = counting(tmp_path), memo.Memo(spark, str(tmp_path / "memo"), "m/1")
    expected = sorted((r["id"], (float(len(r["text"] or "")), 1.0), None) for r in two.collect())
    assert vectors(store.embed(one, "text", "id", model, 7)) == [e for e in expected if e[0] != 900]
    assert asked(tmp_path) == sorted({f"text {i:02}" for i in range(40)} | {""})
    assert vectors(store.embed(two, "text", "id", model, 7)) == expected and len(asked(tmp_path)) == 42
    assert store.compact() > 0 and store.compact() == 0
    assert vectors(store.embed(two, "text", "id", model, 7)) == expected and len(asked(tmp_path)) == 42
    assert vectors(store.embed(two.limit(0), "text", "id", model, 7)) == [] and len(asked(tmp_path)) == 42
    memo.Memo(spark, str(tmp_path / "memo"), "m/2").embed(two, "text", "id", model, 7)
    assert len(asked(tmp_path)) == 84  # another model has its own vectors


def test_memo_asks_again_for_failed_calls_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i:02}") for i in range(30)], "id long, text string").coalesce(1)
    store = memo.Memo(spark, str(tmp_path / "memo"), "m")
    first = vectors(store.embed(rows, "text", "id", counting(tmp_path, fails="text 03"), 5))
    lost = [r[0] for r in first if r[2] == "OSError: busy"]
    assert 3 in lost and len(lost) <= 5 and all(r[1] == () for r in first if r[0] in lost)
    model = counting(tmp_path)
    assert all(r[2] is None for r in vectors(store.embed(rows, "text", "id", model, 5)))
    assert asked(tmp_path) == [f"text {i:02}" for i in range(30)]  # each once over both runs


SCRIPT = """
import sys
sys.path[:0] = [{root!r}, {root!r} + "/tests"]
from pyspark.sql import SparkSession
from test_index_memo import counting, memo, vectors
spark = SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = spark.createDataFrame([(i, f"text {{i:02}}") for i in range(60)], "id long, text string")
found = vectors(memo.Memo(spark, {folder!r} + "/memo", "m").embed(rows, "text", "id", counting({folder!r}, kills="text 41"), 4))
assert found == [(i, (7.0, 1.0), None) for i in range(60)], found
"""


def test_memo_retried_task_makes_no_call_twice(tmp_path):
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, folder=str(tmp_path))], env=env, timeout=240, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.exists(tmp_path / "died")
    assert asked(tmp_path) == [f"text {i:02}" for i in range(60)]
