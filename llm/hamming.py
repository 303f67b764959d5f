"""Operator 7: exact top-k search by incremental multi-index hashing.

A vector's binary code is the signs of its components. It is cut into segments
of equal length, log2 of the number of codes at most, so that a value of a
segment has few codes however many there are; an index holds a row for each
segment of each distinct code. In round r every open query looks up all values
at distance r from its own in each segment; the codes found are verified by
their whole Hamming distance, and those farther than the kth so far are dropped
in the join. After round r a code at distance s * (r + 1) - 1 or less must have
been found (s segments; otherwise each would differ in more than r bits), so a
query whose kth verified distance is covered by that is finished. Rounds go on
until every query is.

Codes are indexed once with their k smallest ids, which are all that a result
ordered by distance and id can hold; so copies of a vector, however many, are
one index row and nothing is lost. Look-ups are shuffled equi-joins, since the
values looked up grow with the queries; values that many distinct codes share
are left to the adaptive split of skewed joins.

Defined cases: null vectors have no code and are neither found nor asked for;
zeros and NaN count as not positive; ties go to the smaller id; a query finds
itself; fewer than k rows give as many results; vectors of other lengths than
the first are an error; an empty table gives an empty result; only vec_id and
embedding are read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, table

K = 10


def codes(vectors: DataFrame, dims: int, bits: int) -> DataFrame:
    """(vec_id, code): the signs as an array of longs, one for each segment."""
    bit = lambda i: F.when(F.col("embedding")[i] > 0, F.lit(1 << (i % bits))).otherwise(0).cast("long")
    words = [reduce(lambda a, b: a + b, [bit(i) for i in range(w, min(w + bits, dims))]) for w in range(0, dims, bits)]
    checked = F.when(F.size("embedding") == dims, F.array(*words)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<long>"))
    return vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), checked.alias("code"))


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def distinct_codes(coded: DataFrame, k: int) -> DataFrame:
    """(code, ids): each code with its k smallest ids, which are found before the shuffle as far as possible."""
    order = Window.partitionBy("code").orderBy("vec_id")
    few = coded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return few.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def looked_up(open_: DataFrame, radius: int, bits: int, dims: int) -> DataFrame:
    """(query, bound, segment, value): all values at distance `radius` from a query's own; positions of changed bits ascend."""
    own = open_.select("query", "bound", F.posexplode("query").alias("segment", "value")).repartition("query", "segment")
    own = own.select("*", F.least(F.lit(bits), dims - F.col("segment") * bits).alias("width"), F.lit(0).alias("next"))
    for _ in range(radius):
        flips = own.where("next < width").withColumn("flip", F.explode(F.sequence("next", F.col("width") - 1)))
        own = flips.select("query", "bound", "segment", F.expr("value ^ shiftleft(1L, flip)").alias("value"), "width", (F.col("flip") + 1).alias("next"))
    return own.select("query", "bound", "segment", "value")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance): of each query the k nearest codes, by distance and then id."""
    spark = vectors.sparkSession
    seen = vectors.where(F.col("embedding").isNotNull()).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).head()
    if not seen["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    dims = seen["dims"]
    bits = ceil(dims / ceil(dims / min(60, max(4, log2(seen["n"])))))
    segments = ceil(dims / bits)
    distinct = cut(distinct_codes(codes(vectors, dims, bits), k), "codes")
    index = cut(distinct.select("code", F.col("ids")[0].alias("least"), F.posexplode("code").alias("segment", "value")), "index")
    asked = cut(codes(queries, dims, bits).groupBy("code").agg(F.collect_set("vec_id").alias("query_ids")), "asked")  # equal queries search once
    open_ = asked.select(F.col("code").alias("query"), F.lit(dims).alias("bound"))
    found = None
    done: list[DataFrame] = []
    order = Window.partitionBy("query").orderBy("distance", "least", "code")
    nearest = lambda df, n: df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")
    whole = Window.partitionBy("query")
    for radius in range(bits + 1):
        probes = looked_up(open_, radius, bits, dims).alias("p").hint("merge")  # they grow with the queries: no broadcast
        apart = distance(F.col("p.query"), F.col("i.code"))
        hits = probes.join(index.alias("i"), (F.col("p.segment") == F.col("i.segment")) & (F.col("p.value") == F.col("i.value")) & (apart <= F.col("p.bound")))
        hits = hits.select("query", "code", "least", apart.alias("distance"))
        hits = hits if found is None else hits.unionByName(found)
        reach = segments * (radius + 1) - 1  # farther codes may not have been found yet
        # A code can be found in each segment and before, so that of k * (segments + 1) rows k are different.
        best = nearest(nearest(hits, k * (segments + 1)).distinct(), k)
        full = F.count("*").over(whole) >= k
        bound = F.when(full, F.max("distance").over(whole)).otherwise(dims)
        best = cut(best.withColumns({"bound": bound, "closed": (full & (bound <= reach)) | F.lit(reach >= dims)}), "best")
        done.append(best.where("closed").drop("closed", "bound"))
        rest = best.where("NOT closed")
        bounds = rest.groupBy("query").agg(F.min("bound").alias("kth"))
        open_ = open_.join(done[-1], "query", "left_anti").join(bounds, "query", "left").select("query", F.coalesce("kth", "bound").alias("bound"))
        if reach >= dims or open_.isEmpty():
            break
        open_ = cut(open_, "open")
        found = rest.drop("closed", "bound")
    pairs = reduce(DataFrame.unionByName, done).join(distinct, "code").select("query", "distance", F.explode("ids").alias("vec_id"))
    last = Window.partitionBy("query").orderBy("distance", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.join(asked.withColumnRenamed("code", "query"), "query").select(F.explode("query_ids").alias("query_id"), "rank", "vec_id", "distance")


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP7_SQL = f"""
WITH bits AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL
), code AS (
  SELECT vec_id, CAST(list_aggregate(b, 'string_agg', '') AS BIT) AS code FROM bits
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
  FROM code q CROSS JOIN code c WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= {K}
"""
