"""Exact top-k by cosine over an index of pivots, which leaves out what the triangle inequality rules out.

The angle between two vectors is a metric. Each row belongs to the cell of its
nearest pivot and, within the cell, to a ring of angles to that pivot. A
question at angle a to a pivot is at least max(a - hi, lo - a) away from every
row of a ring [lo, hi]. Rings are read in the order of that bound, in rounds
that each reach GROWTH times as many rows as before, and a question is done
when no ring that is left can hold a row as near as its kth. So the result is
that of a scan; what the index saves depends on how the vectors lie.

The index is a folder: `rows/cell=<n>` (id, embedding, ring, other columns) and
`directory` (one row a ring). Pivots are picked from a bounded sample; every row
is indexed, and the pick changes the rows that are read, never the result.

Defined cases: rows that are null, have null elements, another length than the
index, or no direction are not indexed and are nobody's nearest, as in a scan;
such questions find nothing. Equal similarities (RANK_DIGITS) go by id. Copies
of one vector are one ring, which is searched in blocks. An empty table gives an
index without rings. A question id that occurs twice is an error of the caller.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.vector import NEAREST, RANK_DIGITS, ranked, scoped_top_k, unit
from statuta.shared import cut, discard

#: Pivots, rings of each, vectors they are picked from, parts a cell is written in, and how the rows within reach grow by round.
PIVOTS, RINGS, SAMPLE, PARTS, GROWTH = 64, 16, 4096, 8, 4
#: What rounding of angles may cost: similarities this much below the kth are still read.
SLACK = 1e-7


class Found(NamedTuple):
    nearest: DataFrame
    work: DataFrame


def spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Unit vectors of the sample, each next the one farthest from those before; fewer if all others are copies of these."""
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(pivots, len(sample)) and near.min() < 1 - SLACK:
        picked.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[picked[-1]])
    return sample[picked]


def directed(dimensions: int) -> Column:
    """Whether `embedding` has this length, no null and a direction."""
    return F.coalesce((F.size("embedding") == dimensions) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0), F.lit(False))


def build(rows: DataFrame, path: str, dimensions: int, id_column: str = "id", pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE, others: Sequence[str] = ()) -> None:
    """Write the index of rows' `embedding` at path; `others` are columns that searches may compare.

    The sample (those of the smallest hashes of id, `sample` vectors at most)
    and the pivots are all that comes to the driver.
    """
    spark = rows.sparkSession
    whole = rows.select(F.col(id_column).cast("long").alias("id"), F.col("embedding").cast("array<float>"), *others).where(directed(dimensions))
    picked = whole.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    vectors = unit(np.array([r["embedding"] for r in picked], float).reshape(-1, dimensions), 0)
    shared = spark.sparkContext.broadcast(spread(vectors, pivots) if len(vectors) else vectors)  # pivots * dimensions numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = unit(np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1), 0)
            near = m @ shared.value.T
            cell = near.argmax(1) if batch.num_rows else np.zeros(0, int)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], [*batch.schema.names, "cell", "angle"])

    placed = cut(whole.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in whole.dtypes) + ", cell int, angle double"), "placed")
    steps = [i / rings for i in range(1, rings)]
    edges = placed.groupBy("cell").agg(F.percentile_approx("angle", steps).alias("edges") if steps else F.array().cast("array<double>").alias("edges"))
    ring = F.size(F.filter("edges", lambda e: e < F.col("angle")))
    ringed = placed.join(F.broadcast(edges), "cell").withColumn("ring", (F.col("cell") * rings + ring).cast("int"))  # pivots rows at most
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    ringed.drop("edges").repartition("cell", part).sortWithinPartitions("cell", "ring").write.partitionBy("cell").parquet(f"{path}/rows")
    # Angles of a ring come from the rows as written.
    sizes = spark.read.schema(ringed.drop("edges").schema).parquet(f"{path}/rows").groupBy("cell", "ring").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))
    pivot = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(shared.value)], "cell int, pivot array<double>")
    sizes.join(F.broadcast(pivot), "cell").coalesce(1).write.parquet(f"{path}/directory")  # pivots * rings rows at most
    discard(placed)


def ordered(questions: DataFrame, directory: list, others: Sequence[str]) -> DataFrame:
    """For each question all rings by ascending bound: `most`, the similarity none of their rows exceeds, and `before`, how many rows come earlier."""
    dimensions = len(directory[0]["pivot"])
    pivot = np.zeros((max(r["cell"] for r in directory) + 1, dimensions))
    for r in directory:
        pivot[r["cell"]] = r["pivot"]
    cell, ring, n = (np.array([r[c] for r in directory]) for c in ("cell", "ring", "n"))
    lo, hi = (np.array([r[c] for r in directory], float) for c in ("lo", "hi"))
    asked = questions.where(directed(dimensions)).select(F.col("question_id").cast("long").alias("question_id"), F.col("embedding").cast("array<float>"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = unit(np.array([batch.column(1)[i].as_py()], float), 0)[0]
                angle = np.arccos(np.clip(pivot @ q, -1, 1))[cell]
                most = np.cos(np.maximum(0, np.maximum(angle - hi, lo - angle)))
                order = np.lexsort((ring, -most))
                before = np.cumsum(n[order]) - n[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column(0)[i].as_py(), len(order)), pa.int64()), *(pa.array(v[order], t) for v, t in ((cell, pa.int32()), (ring, pa.int32()), (n, pa.int64()), (most, pa.float64()))), pa.array(before, pa.int64())],
                    ["question_id", "cell", "ring", "n", "most", "before"],
                )

    return asked.select("question_id", "embedding").mapInArrow(run, "question_id long, cell int, ring int, n long, most double, before long")


def search(spark: SparkSession, path: str, questions: DataFrame, k: int, same: Sequence[tuple[str, str]] = ()) -> Found:
    """nearest (question_id, id, similarity, rank), what batch_top_k finds, and work (question_id, rows_read, rings_read).

    questions (question_id, embedding). Of each pair in `same`, a column of the
    index has to equal the question's column, unless that is null. A round is
    one search of (question, ring) pairs, dealt out in blocks; only folders of
    open cells are read. To the driver come the directory and the open cells.
    """
    directory = spark.read.parquet(f"{path}/directory").collect()
    others = [of for _, of in same]
    if not directory:
        return Found(spark.createDataFrame([], f"{NEAREST}, rank int"), spark.createDataFrame([], "question_id long, rows_read long, rings_read long"))
    rows = spark.read.parquet(f"{path}/rows")
    asked = questions.select(F.col("question_id").cast("long").alias("question_id"), F.col("embedding").cast("array<float>").alias("embedding"), *others)
    rings = cut(ordered(questions, directory, others), "rings")
    found, read = cut(spark.createDataFrame([], f"{NEAREST}, rank int"), "nearest"), None
    low, high = 0, max(k, 1)
    while True:
        kth = found.where(F.col("rank") == k).select("question_id", F.round("similarity", RANK_DIGITS).alias("kth"))
        left = rings.where(F.col("before") >= low).join(kth, "question_id", "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - SLACK)).drop("kth")
        left = cut(left, "open")
        now = left.where(F.col("before") < high)
        cells = [r["cell"] for r in now.select("cell").distinct().collect()]  # pivots at most
        if cells:
            pairs = now.select("question_id", "ring").join(asked, "question_id")
            near = scoped_top_k(rows.where(F.col("cell").isin(cells)), pairs, k, ("ring", F.col("ring")), same=[(c, F.col(of)) for c, of in same])
            better = cut(ranked(found.drop("rank").unionByName(near.drop("rank")), k), "nearest")
            step = cut(now.groupBy("question_id").agg(F.sum("n").alias("rows_read"), F.count("*").alias("rings_read")), "work")
            discard(found)
            found, read = better, step if read is None else read.unionByName(step)
        elif left.isEmpty():
            discard(left)
            break
        discard(left)
        low, high = high, high * GROWTH
    discard(rings)
    read = spark.createDataFrame([], "question_id long, rows_read long, rings_read long") if read is None else read
    return Found(found, read.groupBy("question_id").agg(F.sum("rows_read").alias("rows_read"), F.sum("rings_read").alias("rings_read")))
