"""Near-duplicates, decontamination, binary codes and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import decontaminate, hamming, near_dedup
from llm.common import table
from llm.graph import components

DATA = "/root/testdata/sf0.001"


def shingle_counts(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows, threshold=0.8):
    sets = {i: shingle_counts(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if jaccard(sets[a], sets[b]) >= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_signatures_are_unbiased():
    rng = random.Random(0)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(300)]
    other = [w if rng.random() > 0.03 else "new" + str(rng.random()) for w in base]
    loops, more = ["a", "b", "c", "d", "e", "f"] * 50, ["a", "b", "c", "d", "e", "f"] * 60
    for x, y in ((base, other), (loops, more), (base, loops)):
        sets = [near_dedup.multiset(" ".join(w)) for w in (x, y)]
        s = near_dedup.signatures(sets, 4096)
        exact = jaccard(*(shingle_counts(" ".join(w)) for w in (x, y)))
        assert abs((s[0] == s[1]).mean() - exact) < 0.04
        assert near_dedup.similarity(*(near_dedup.elements(" ".join(w)) for w in (x, y))) == exact


def test_classes_equal_brute_force(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes([tuple(r) for r in docs.collect()])


def chain(n, words=60):
    """Texts of which each is near the next only, and a group of copies of one base."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 999)}" for _ in range(words)]
    rows, text = [], list(base)
    for i in range(n):
        rows.append((i, " ".join(text)))
        text = list(text)
        text[(i * 7) % words] = f"n{i}"
    for i in range(n):
        text = list(base)
        text[rng.randrange(words)] = f"m{i}"
        rows.append((1000 + i, " ".join(text)))
    return rows


def test_chains_and_odd_rows(spark):
    rows = chain(30) + [(5000, None), (5001, ""), (5002, "one two"), (5003, "One  two"), (5004, "x " * 30_000), (5005, "x " * 28_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_classes(rows) and got[5003] == 5002 and got[5005] == 5004 and got[5001] == 5001
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = near_dedup.near_duplicates(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in twice if r["doc_id"]) == [(1, 1), (1, 1)] and len(twice) == 3


@pytest.mark.parametrize("small", [512, 8])
def test_group_of_copies_around_the_threshold(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 999)}" for _ in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.sample(range(0, 150, 10), rng.randint(1, 8)):
            text[at] = rng.choice(("left", "right"))
        rows.append((i, " ".join(text[rng.randint(0, 3) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) > 1


def test_dedup_stage_keeps_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "other"), (None, "a"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.dedup_stage(spark, docs, DATA)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None", "None"]


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def planted(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = "changed"
    return " ".join(words)


def test_planted_benchmark_passages(spark):
    rng = random.Random(4)
    items = {r["item_id"]: r["text"] for r in table(spark, DATA, "benchmark").collect()}
    clean = table(spark, DATA, "documents").select("doc_id", "text")
    search = decontaminate.searches(clean, table(spark, DATA, "benchmark"))[0]
    hosts = [r["text"] for r in clean.orderBy("doc_id").limit(20).collect()]
    for share in (0.0, 0.1, 0.2):
        texts = [f"{rng.choice(hosts)} {planted(rng, t, share)} {rng.choice(hosts)}" for t in items.values()]
        found = search.find(texts)
        assert sum(i in f for i, f in zip(items, found)) >= (0.98 if share < 0.2 else 0.9) * len(items)
    assert search.find([None, "", "word " * 70_000, "a"]) == [{}, {}, {}, {}]


def test_decontamination_equals_brute_force(spark):
    docs, benchmark = table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    items = [decontaminate.Item(r["item_id"], decontaminate.words_of(r["text"]), r["text"]) for r in benchmark.collect()]
    want = set()
    for r in docs.collect():
        words = decontaminate.words_of(r["text"])
        want |= {(r["doc_id"], i.item_id) for i in items if len(set(i.words) & set(words)) > 0.4 * len(set(i.words)) and any(i.match(words, at) for at in range(0, len(words), 16))}
    assert got <= want and len(got) >= 0.9 * len(want)
    stage = decontaminate.decontaminate_stage(spark, docs, DATA)
    assert {r["doc_id"] for r in stage.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0 and decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_decontamination_of_long_items(spark):
    """Long items don't take the directions of other items, and the last words of a cut item are no item."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(20_000)]
    words = [rng.choices(vocabulary, k=n) for n in (12, 300, 500) for _ in range(12)]
    tail = rng.choices(vocabulary, k=decontaminate.LONGEST + 3)

    def pairs(texts, items):
        frames = [spark.createDataFrame(list(enumerate(" ".join(w) for w in ws)), f"{c} long, text string") for c, ws in (("doc_id", texts), ("item_id", items))]
        return sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(*frames).collect())

    assert pairs([rng.choices(vocabulary, k=100) + w + rng.choices(vocabulary, k=100) for w in words], words) == [(k, k) for k in range(len(words))]
    assert pairs([tail[-3:], tail], [tail]) == [(1, 0)]


def test_decontamination_of_new_words_and_short_items(spark):
    """Words that no document has don't hide an item, nor do those around a short one."""
    rng = random.Random(12)
    docs, benchmark = table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "benchmark")
    known = [w for r in docs.orderBy("doc_id").limit(60).collect() for w in decontaminate.words_of(r["text"])]
    short = [(10_000 + k, " ".join(known[at : at + 2 + k % 6])) for k, at in enumerate(rng.sample(range(len(known) - 7), 60))]
    search = decontaminate.searches(docs, benchmark.select("item_id", "text").unionByName(spark.createDataFrame(short, "item_id long, text string")))[0]
    items = search.items
    for share in (0.0, 0.3, 0.4, 0.45):
        texts = []
        for item in items:
            words, keep = list(item.words), len(item.answer) if share > 0.3 else 0
            for i in rng.sample(range(len(words) - keep), min(len(words) - keep, int(share * len(words)))):
                words[i] = f"new{rng.random()}"
            texts.append([f"foreign{k}" for k in range(40)] + words + rng.sample(known, 40))
        found = search.find([" ".join(t) for t in texts])
        want = [any(item.match(t, at) for at in range(0, len(t), 4)) for item, t in zip(items, texts)]
        assert sum(want) > 40 and all(item.item_id in f for item, f, w in zip(items, found, want) if w)


def test_latent_directions_find_other_words(spark):
    """RANK directions, fewer than passages, tell windows of the words that go with an item's words, which plain cosine can't."""
    rng = random.Random(13)
    topics = [[(f"x{t}.{i}", f"y{t}.{i}") for i in range(24)] for t in range(40)]
    docs, items = [], []
    for k, topic in enumerate(topics):
        for _ in range(10):
            docs.append((len(docs), " ".join(w for pair in rng.sample(topic, 24) for w in rng.sample(pair, 2))))
        items += [(8 * k + j, " ".join(x for x, _ in rng.sample(topic, 16))) for j in range(8)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    (search,) = decontaminate.searches(*frames)
    assert search.passages.shape == (len(items), decontaminate.RANK) and decontaminate.RANK < 0.7 * len(items)
    columns, other = decontaminate._Columns(), 0
    for item_id, text in items:
        words = [w if i % 4 == 0 else "y" + w[1:] for i, w in enumerate(text.split())]
        plain = sum(w in text.split() for w in words) / 16  # all words are as rare as each other
        cols, ends = columns(words), np.array([16])
        near = {int(search.item_of[p]) for _, ps in search.latent_candidates(cols, np.array([0]), ends) for p in ps}
        assert plain < decontaminate.COSINE
        other += item_id in near and all(n // 8 == item_id // 8 for n in near)
    assert other >= 0.9 * len(items)


def test_decontamination_of_repeats_and_clashing_columns(spark):
    benchmark = table(spark, DATA, "benchmark")
    item = benchmark.orderBy("item_id").first()
    rows = [(1, item["text"]), (1, item["text"]), (None, item["text"]), (2, None), (3, ""), (None, "plain words"), (4, "plain words")]
    own = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(c).alias(c) for c in ("word", "row", "weight", "stride", "item_id", "lcs")))
    found = decontaminate.contaminated(own, benchmark.withColumn("doc_id", F.lit(9))).where(F.col("item_id") == item["item_id"]).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "None"]
    stage = decontaminate.decontaminate_stage(spark, own, DATA)
    assert stage.columns == own.columns and sorted((str(r["doc_id"]), r["text"]) for r in stage.collect()) == sorted((str(d), t) for d, t in rows[3:])
    twice = benchmark.where(F.col("item_id") == item["item_id"]).select(F.explode(F.array(F.lit(70_001), F.lit(70_002))).alias("item_id"), "text")
    assert {r["item_id"] for r in decontaminate.contaminated(own, twice).collect()} == {70_001, 70_002}


def test_there_and_back_equals_dense():
    rng = np.random.default_rng(5)
    texts = [list(rng.choice(list("abcdefgh"), n)) for n in (3, 16, 40, 1)]
    columns = decontaminate._Columns()
    rows, cols, values = decontaminate.weighted_rows(texts, 4, np.ones(decontaminate.HASHED), columns)
    dense = np.zeros((rows.max() + 1, decontaminate.HASHED), np.float32)
    dense[rows, cols] = values
    directions = rng.standard_normal((decontaminate.HASHED, 4)).astype(np.float32)
    found, sums = decontaminate.there_and_back(rows, cols, values, directions)
    assert list(found) == sorted(set(cols)) and np.allclose(sums, (dense.T @ (dense @ directions))[found], atol=1e-4)
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)


def test_lcs():
    assert decontaminate.lcs("a b c d".split(), "x a c y d".split()) == 3 and decontaminate.lcs(["a"], []) == 0


def test_hamming_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(size=(150, 20)), np.repeat(rng.normal(size=(1, 20)), 100, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("clash"))
    got = {}
    for r in hamming.search(df, df.where("vec_id % 100 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    bits = vectors > 0
    for q in (0, 100, 200):
        want = sorted((int((bits[q] != b).sum()), i) for i, b in enumerate(bits))[:5]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(want)]
    assert set(got) == {0, 100, 200}
    assert hamming.search(df.limit(0), df.limit(0)).count() == 0
    assert hamming.search(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).count() == 3


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, left, DATA)
        assert new.columns == docs.columns
        assert new.select("doc_id").exceptAll(left.select("doc_id")).count() == 0
        left = new
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert 0 < len(rows) < docs.count() and len({r["doc_id"] for r in rows}) == len(rows)


def test_directions_of_columns_in_use_take_no_more_than_these():
    """The same directions as of all columns, and no words kept in workers from task to task."""
    import tracemalloc

    use = np.zeros(decontaminate.HASHED, bool)
    use[::31] = True
    whole = np.random.default_rng(7).standard_normal((decontaminate.HASHED, decontaminate.RANK), dtype=np.float32)
    assert np.array_equal(decontaminate.random_directions(use), whole[use])
    tracemalloc.start()
    decontaminate.random_directions(use)
    assert tracemalloc.get_traced_memory()[1] < whole.nbytes / 4
    tracemalloc.reset_peak()
    before, columns = tracemalloc.get_traced_memory()[0], decontaminate._Columns()
    for at in range(0, 200_000, 10_000):
        columns([f"word{k}" for k in range(at, at + 10_000)])
    assert tracemalloc.get_traced_memory()[0] - before < 1 << 20
    tracemalloc.stop()
    assert columns(["a", "b", "a"]).tolist() == [decontaminate.column(w) for w in "aba"]
