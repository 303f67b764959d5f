"""Quality, toxicity and language: held-out accuracy, odd inputs, determinism."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import language, quality, toxicity
from llm.common import held_out, table

DATA = "/root/testdata/sf0.01"
ODD = [(None, "x"), (1, None), (2, ""), (3, "a " * 60_000), (4, "word"), (4, "word"), (5, "\x00 ퟿ 日本 😀"), (6, "123 !?")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").cache()


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select(F.lit(1).alias("score"), "doc_id", F.lit("label").alias("quality"), "text", F.lit("en").alias("held_out"))


def accuracy(rows, labels, column):
    pairs = [(r[column], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_held_out(spark):
    rows = spark.range(1000).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.9), (toxicity, "toxic", 0.95)])
def test_classifier(spark, docs, module, label, least):
    labels = table(spark, DATA, "labels")
    model = module.fit(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert accuracy(rows, {r["doc_id"]: r[label] for r in labels.collect()}, "predicted") >= least
    # Held-out labels are never seen.
    hidden = labels.withColumn(label, F.when(held_out(), 1 - F.col(label)).otherwise(F.col(label)))
    assert sorted(module.score(docs, module.fit(docs, hidden)).select("doc_id", "score").collect()) == sorted((r["doc_id"], r["score"]) for r in rows)
    strange = module.score(odd(spark), model).collect()
    assert len(strange) == len(ODD) and all(0 <= r["score"] <= 1 for r in strange)
    assert module.score(odd(spark).limit(0), model).count() == 0
    unlabelled = module.score(odd(spark), module.fit(docs, labels.limit(0))).collect()
    assert {r["score"] for r in unlabelled} == {0.5 if module is quality else 0.0}


def test_toxic_spans_are_words_of_the_text(spark, docs):
    model = toxicity.fit(docs, table(spark, DATA, "labels"))
    text = "A fine day, you IDIOT moron! Another fine day."
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).head()
    assert row["predicted"] == 1 and [text[s["start"] : s["end"]] for s in row["spans"]] == ["IDIOT moron!"]


def test_marginals_equal_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(4), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = [1, 3, 6, 2]
    e = rng.normal(size=sum(lengths)) * 3
    first = np.cumsum([0, *lengths[:-1]])
    got, want = field.marginals(e, first), []
    for at, n in zip(first, lengths):
        total, toxic = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            s = field.start[states[0]] + sum(e[at + i] * x for i, x in enumerate(states)) + sum(field.transitions[a, b] for a, b in zip(states, states[1:]))
            total += np.exp(s)
            toxic += np.exp(s) * np.array(states)
        want += list(toxic / total)
    assert np.allclose(got, want)
    long = rng.normal(size=1000)
    assert np.allclose(field.marginals(np.append(long, e), np.append(0, 1000 + first))[1000:], got)


def test_language(spark, docs):
    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    assert accuracy(rows, {r["doc_id"]: r["lang"] for r in docs.collect()}, "lang_pred") >= 0.97
    strange = {(r["doc_id"], r["lang_pred"]) for r in language.predict(odd(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (6, "und")} <= strange and not any(d in (3, 4, None) and lang == "und" for d, lang in strange)
    assert language.predict(odd(spark), language.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_temperature_is_inside_its_search(spark, docs):
    model = language.fit(docs)
    low, high = language.TEMPERATURES
    assert 2 * low < model.temperature < high / 2
    scored = [(model(r["text"][10:22]), r["lang"]) for r in docs.where(held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()]
    scored = [(lang == truth, p) for (lang, p), truth in scored if lang != language.UNKNOWN]
    right, mean = sum(ok for ok, _ in scored) / len(scored), sum(p for _, p in scored) / len(scored)
    assert right < 1 and abs(right - mean) < 0.1  # short pieces are told wrong as often as their scores say


def test_language_follows_the_regularised_leader():
    """Weights equal those of a plain loop over places and languages."""
    texts = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("das haus", "de"), ("a house", "en"), ("une maison", "fr")]
    model = language.LanguageModel(texts, np.ones(language.HASHED), 6)
    x = [model._row(*language.ngram_counts(t)) for t, _ in texts]
    y = [model.langs.index(lang) for _, lang in texts]
    kept, order = [k for k in range(6) if k % 5 != 4], np.random.default_rng(0)
    z, n, c = {}, {}, len(model.langs)

    def weight(i, j):
        if abs(z.get((i, j), 0.0)) <= language.L1:
            return 0.0
        sign = 1 if z[i, j] > 0 else -1
        return -(z[i, j] - sign * language.L1) / ((language.BETA + math.sqrt(n[i, j])) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for k in order.permutation(np.array(kept)):
            row = [*zip(x[k][0].tolist(), x[k][1].tolist()), (language.HASHED, 1.0)]
            w = {(i, j): weight(i, j) for i, _ in row for j in range(c)}
            e = [math.exp(sum(v * w[i, j] for i, v in row)) for j in range(c)]
            for i, v in row:
                for j in range(c):
                    g = v * (e[j] / sum(e) - (j == y[k]))
                    sigma = (math.sqrt(n.get((i, j), 0.0) + g * g) - math.sqrt(n.get((i, j), 0.0))) / language.ALPHA
                    z[i, j] = z.get((i, j), 0.0) + g - sigma * w[i, j]
                    n[i, j] = n.get((i, j), 0.0) + g * g
    plain = np.zeros_like(model.weights)
    for i, j in z:
        plain[i, j] = weight(i, j)
    assert np.allclose(plain, model.weights, atol=1e-5) and (model.weights == 0).mean() > 0.9
