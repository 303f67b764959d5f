"""Cosine similarity and exact top-k over array columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Questions that are compared side by side, rows of one scope that a task compares with them, and the digits by which similarities are ranked.
QUERY_BLOCK, ROW_BLOCK, RANK_DIGITS = 1024, 20_000, 9
NEAREST = "question_id long, id long, similarity double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null for null and zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def valid(vector: Column, dimensions: int) -> Column:
    return F.coalesce(F.size(vector) == dimensions, F.lit(False))


def top_k(rows: DataFrame, vector: Sequence[float], k: int, id_column: str = "id") -> DataFrame:
    """The k rows nearest to one vector, with `similarity` and `rank`; a partial top-k in each task, then a merge of those."""
    norm = float(np.sqrt(np.square(np.asarray(vector, float)).sum()))
    own = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    similarity = F.try_divide(dot(F.col("embedding"), literal(vector)), own * F.lit(norm))
    best = rows.where(F.col("embedding").isNotNull()).withColumn("similarity", similarity).where(F.col("similarity").isNotNull())
    order = [F.desc(F.round("similarity", RANK_DIGITS)), F.col(id_column)]
    # k rows at most, so the window runs over no more than that.
    return best.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def matches(wanted: list[str | None], values: list[str | None]) -> np.ndarray:
    """Which value each wanted one equals; null wants any."""
    number = {v: i for i, v in enumerate(dict.fromkeys(v for v in wanted if v is not None))}
    want = np.array([-1 if v is None else number[v] for v in wanted])
    have = np.array([number.get(v, -2) for v in values])
    return (want[:, None] == have) | (want[:, None] == -1)


def unit(matrix: np.ndarray, zero: float) -> np.ndarray:
    """Rows of length one; those of length zero are filled with `zero`."""
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.full_like(matrix, zero), where=size > 0)


def nearest(questions: np.ndarray, q: np.ndarray, bounds: list[tuple], row_ids: np.ndarray, rows: np.ndarray, values: list[list], k: int) -> pa.RecordBatch:
    """The k best of these rows for each question (unit vectors q); similarities that are no number don't count."""
    s = q @ unit(rows, np.nan).T
    for i, own in enumerate(values):
        s[~matches([b[i] for b in bounds], own)] = np.nan
    out_q, out_i, out_s = [], [np.zeros(0, np.int64)], [np.zeros(0)]
    for question, line in zip(questions, s):
        order = np.lexsort((row_ids, -np.round(line, RANK_DIGITS)))[:k]
        order = order[~np.isnan(line[order])]
        out_q += [question] * len(order)
        out_i.append(row_ids[order])
        out_s.append(line[order])
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_i), pa.int64()), pa.array(np.concatenate(out_s), pa.float64())], ["question_id", "id", "similarity"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("similarity", RANK_DIGITS)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scoped_top_k(rows: DataFrame, questions: DataFrame, k: int, scope: tuple[str, Column], id_column: str = "id", same: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """batch_top_k in which each question meets the rows of its scope only: those whose text column equals the question's.

    Rows and questions of a scope are dealt to blocks, ROW_BLOCK of the ones by
    QUERY_BLOCK of the others, and a pair of blocks is one task's work, so what
    is multiplied is the sum over scopes and a large scope is spread out. The
    number of questions is not bounded: none of them goes through the driver.
    A question without a scope, or with one that no row has, finds nothing.
    """
    name, of = scope
    bound = [c.alias(f"_same{i}") for i, (_, c) in enumerate(same)]
    asked = questions.select(of.alias("_scope"), F.col("question_id").cast("long").alias("question_id"), "embedding", *bound)
    whole = rows.select(F.col(name).alias("_scope"), F.col(id_column).cast("long").alias("id"), "embedding", *(F.col(c).alias(f"_same{i}") for i, (c, _) in enumerate(same)))
    usable = F.col("_scope").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & (F.size("embedding") > 0)
    asked, whole = asked.where(usable), whole.where(usable)
    per = lambda df, to, block: df.groupBy("_scope").agg(F.ceil(F.count("*") / block).cast("int").alias(to))
    blocks = per(asked, "q_blocks", QUERY_BLOCK).join(per(whole, "r_blocks", ROW_BLOCK), "_scope")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = whole.join(blocks, "_scope").withColumn("r", one("id", "r_blocks")).withColumn("q", every("q_blocks")).drop("q_blocks", "r_blocks")
    right = asked.join(blocks, "_scope").withColumn("q", one("question_id", "q_blocks")).withColumn("r", every("r_blocks")).drop("q_blocks", "r_blocks")
    key, width = ["_scope", "r", "q"], len(same)

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        sizes = [np.array([len(v) for v in t["embedding"]], int) for t in (mine, theirs)]
        found = []
        for n in np.intersect1d(*sizes).tolist():
            r, q = (t.filter(pa.array(size == n)) for t, size in zip((mine, theirs), sizes))
            matrix = [np.array(t["embedding"].to_pylist(), float) for t in (r, q)]
            bounds = list(zip(*(q[f"_same{i}"].to_pylist() for i in range(width)))) or [()] * q.num_rows
            found.append(nearest(q["question_id"].to_numpy(), unit(matrix[1], 0), bounds, r["id"].to_numpy(), matrix[0], [r[f"_same{i}"].to_pylist() for i in range(width)], k))
        return pa.Table.from_batches(found, pa.schema([("question_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())]))

    return ranked(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, NEAREST), k)


def batch_top_k(rows: DataFrame, questions: DataFrame, k: int, id_column: str = "id", same: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """(question_id, id, similarity, rank): of each question (question_id, embedding) the k nearest rows.

    Questions are a stated set, sent to the tasks in blocks. A task multiplies
    a batch of rows with a block and keeps the k best of each question, so that
    only k rows for each question and batch are shuffled. As in top_k, rows of
    another length than a question's, with null elements or of length zero are
    not among its nearest. Of each pair in `same`, a row's text column has to
    equal the question's, unless that is null.
    """
    spark = rows.sparkSession
    bound = [of.alias(f"_same{i}") for i, (_, of) in enumerate(same)]
    asked = [(r[0], r[1], r[2:]) for r in questions.where(F.col("embedding").isNotNull()).select("question_id", "embedding", *bound).orderBy("question_id").collect()]
    found = spark.createDataFrame([], NEAREST)
    whole = rows.where(~F.exists("embedding", lambda x: x.isNull())).select(F.col(id_column).cast("long").alias("id"), "embedding", *(F.col(c) for c, _ in same))
    by_length: dict[int, list] = {}
    for question in asked:
        if question[1] and None not in question[1]:
            by_length.setdefault(len(question[1]), []).append(question)
    for length, first in ((n, at) for n, same in by_length.items() for at in range(0, len(same), QUERY_BLOCK)):
        pairs, block = whole.where(F.size("embedding") == length), by_length[length][first : first + QUERY_BLOCK]
        shared = spark.sparkContext.broadcast(([i for i, _, _ in block], unit(np.array([v for _, v, _ in block], float), 0), [b for _, _, b in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, bounds = shared.value
            for batch in batches:
                if batch.num_rows:
                    m = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                    yield nearest(ids, q, bounds, np.asarray(batch.column(0)), m, [c.to_pylist() for c in batch.columns[2:]], k)

        found = found.unionByName(pairs.mapInArrow(run, NEAREST))
    return ranked(found, k)
