"""Operator 3: near-duplicates by BagMinHash over weighted shingles.

A text's shingles are its runs of SHINGLE words (small letters, cut at white
space), each weighted by how often it occurs. Two texts are near-duplicates if
their multisets' Jaccard similarity is THRESHOLD or more.

BagMinHash: a shingle's weight is cut into the intervals [0, 1), [1, 2), [2, 4),
[4, 8) and so on. Each interval has a Poisson process in time, seeded by the
shingle and the interval, whose rate is the interval's width; each point
belongs to one of the signature's components and to a weight within the
interval, and counts if the text's weight reaches it. A component's value is
the time of its first point, so two texts agree in a component with the chance
of their weighted Jaccard similarity. A process is followed only until its
next point is later than all components' values so far.

Texts with equal multisets are one node from the start. Of the others, the
signatures are cut into BANDS bands of ROWS values, and nodes that share a
band meet in a bucket. Each node is compared on whole multisets with its
bucket's leader (the node that meets others most often); nodes of one leader
are a group, and of every comparison is kept by what the node differs from its
leader. Links make classes. What is left are groups of several classes, and
they are not expanded into their pairs:

A group has a reference set C, at first its leader. A node x differs from C by
D(x), the elements of C that it misses and those that it adds (the kth
occurrence of a shingle is an element of its own). For any C,
|x & y| = |C| - missing(x) - missing(y) + |D(x) & D(y)|, so differences are
enough to verify a pair. In groups of up to SMALL nodes this is done inside a
row, and only links come out. In larger ones C takes in what over half of
REFERENCE of the nodes add, and leaves what over half of them miss, which
keeps the differences small. Then either the first three terms are enough to link x and y; both are linked to the node of which these
terms leave most, and these links are taken from the counts. Or D(x) and D(y)
share elements, and how many at least follows from the numbers missed and
added by the nodes of other classes. Then x and y meet again in the group of
one of these elements (prefix filter), whose reference is still C. Such a
group lacks over half of the REFERENCE nodes, in general half of its parent,
so after a few rounds all groups are small. No link between nodes that share a
bucket is lost.

Texts that share a similarity of 0.8 share no bucket with a chance of
(1 - 0.8^6)^32 = 0.00006.

Defined cases: null and empty texts are in no group (class_id is their own
doc_id); texts of 1 to SHINGLE - 1 words have one shingle, the whole text; rows
of one doc_id are each classed by their own text; rows with a null doc_id have a
null class_id and link nothing; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, dealt, discard, table
from llm.graph import contracted, merged

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
#: Shingles whose signatures are made side by side.
BLOCK = 150_000
#: Nodes of a group, and elements in their differences, whose pairs between classes are compared inside one row.
SMALL, HELD = 512, 4_000_000
#: Nodes of a larger group from which a better reference is made.
REFERENCE = 31
#: Numbers of elements missed or added are told apart by this ratio where groups are summed up.
STEP = 1.125
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multiset(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of a text's shingles, and how often each occurs."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashed[k : len(words) - n + 1 + k])
    return np.unique(out, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """Times of first points, a row for each multiset; none may be empty."""
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    shingle = np.concatenate([h for h, _ in sets])
    parts = []
    level = 0
    live = np.arange(len(doc))
    while len(live):
        low = 0 if level == 0 else 1 << (level - 1)
        width = max(1, low)
        parts.append((live, np.full(len(live), level), np.full(len(live), low), np.full(len(live), width)))
        level += 1
        live = live[weight[live] > low + width]
    at, levels, lows, widths = (np.concatenate(x) for x in zip(*parts))
    seed = mix(shingle[at] + levels.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    doc, weight = doc[at], weight[at]
    time = np.zeros(len(at))
    gap = 1.0 / (m * widths)
    values = np.full((len(sets), m), np.inf)
    flat, latest = values.ravel(), np.full(len(sets), np.inf)
    step = 0
    partial = weight < lows + widths
    while len(seed):
        step = (step + int(_GOLDEN)) % 2**64
        r = mix(seed + np.uint64(step))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) * gap
        kept = time < latest[doc]
        if not kept.all():
            seed, doc, weight, time, gap, lows, widths, partial, r = (x[kept] for x in (seed, doc, weight, time, gap, lows, widths, partial, r))
        r = mix(r ^ np.uint64(0xE7037ED1A0B428DB))
        component = ((r >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        place = doc * m + component
        if partial.any():
            reached = ~partial | (lows + (r & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * widths < weight)
            np.minimum.at(flat, place[reached], time[reached])
        else:
            np.minimum.at(flat, place, time)
        latest = values.max(1)
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    bits = values.view(np.uint64).reshape(len(values), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, (len(values), BANDS))
    for k in range(ROWS):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, k])
    return out.view(np.int64)


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, content, bands): a number of the row's own in random order, a hash of the multiset (null
    without words or doc_id), and the band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("content", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33

        def made(rows: list, sets: list) -> pa.RecordBatch:
            nonlocal place
            full = [i for i, (h, _) in enumerate(sets) if len(h)]
            keys: list = [None] * len(sets)
            content: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_keys(signatures([sets[i] for i in full])).tolist()):
                    keys[i] = row
                    content[i] = content_of(*sets[i])
            nodes = mix(np.arange(place, place + len(sets), dtype=np.uint64) + _GOLDEN).view(np.int64)  # mix is one to one
            place += len(sets)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*zip(*rows), nodes, content, keys), schema)], schema=schema)

        for batch in batches:
            rows, sets, size = [], [], 0
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                sets.append(multiset(None if doc_id is None else text.as_py()))
                rows.append((doc_id, text_hash))
                size += len(sets[-1][0])
                if size > BLOCK:
                    yield made(rows, sets)
                    rows, sets, size = [], [], 0
            if rows:
                yield made(rows, sets)

    read = dealt(documents).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return read.mapInArrow(run, "doc_id long, text_hash long, node long, content binary, bands array<long>")


def content_of(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes() + counts.tobytes(), digest_size=16).digest()


def spread(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the kth occurrence of each shingle as an element of its own; so multisets overlap as these sets do."""
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort((np.repeat(hashes, counts) + place.astype(np.uint64) * _GOLDEN).view(np.int64))


def elements(text: str | None) -> np.ndarray:
    return spread(*multiset(text))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if not len(a) or not len(b):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of elements, thus of the multisets."""
    shared = overlap(a, b)
    return float(shared / max(1, len(a) + len(b) - shared))


def element_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, elements) of nodes (node, doc_id, content); the texts are shuffled once, and only these kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sets = [], []
            for k, (content, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                one = multiset(text.as_py())
                if content_of(*one) == content:  # else another text of the same doc_id
                    found.append(k)
                    sets.append(spread(*one))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found, pa.int64())), pa.array(sets, pa.list_(pa.int64()))], ["node", "elements"])

    texts = documents.select(F.col("doc_id").cast("long"), "text").join(nodes, "doc_id").select("node", "content", "text")
    return cut(texts.mapInArrow(run, "node long, elements array<long>"), "elements")


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each list as a view into the batch."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
    return (values[i:j] for i, j in zip(at, at[1:]))


def differences(led: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, size, less, more) for each node b with a leader a: the leader's size, what b misses of it, and what b adds.

    A leader of very many nodes is one key of the second join, which the
    adaptive split of skewed joins deals to several tasks. Repeated rows of a
    document give a node its elements more than once; one row of each is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, less, more = [], [], []
            for leader, own in zip(lists(batch.column(2)), lists(batch.column(3))):
                sizes.append(len(leader))
                less.append(np.setdiff1d(leader, own, assume_unique=True))
                more.append(np.setdiff1d(own, leader, assume_unique=True))
            arrays = [pa.array(sizes, pa.int64()), pa.array(less, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["a", "b", "size", "less", "more"])

    held = led.where("a <> b").join(sets.toDF("b", "own"), "b").join(sets.toDF("a", "leader"), "a")
    return held.select("a", "b", "leader", "own").mapInArrow(run, "a long, b long, size long, less array<long>, more array<long>")


def _linked(size: Column, shared: Column, threshold: float) -> Column:
    """size: of both sets together, so with what they share counted twice. As exact as a division of whole numbers."""
    return shared / F.greatest(F.lit(1), size - shared) >= threshold


def between(groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between nodes of a group (bucket, b, label, size, less, more) with different labels; groups have up to SMALL nodes."""

    def links(x: Column, nodes: Column) -> Column:
        both = lambda f, y: F.size(F.array_intersect(x[f], y[f]))
        own = lambda y: y["size"] - F.size(y["less"])

        def near(y: Column) -> Column:
            total = own(x) + F.size(x["more"]) + own(y) + F.size(y["more"])
            base = x["size"] - F.size(x["less"]) - F.size(y["less"])
            at_most = base + F.least(F.size(x["less"]), F.size(y["less"])) + F.least(F.size(x["more"]), F.size(y["more"]))
            return (x["b"] < y["b"]) & (x["label"] != y["label"]) & _linked(total, at_most, threshold) & _linked(total, base + both("less", y) + both("more", y), threshold)

        return F.transform(F.filter(nodes, near), lambda y: F.struct(x["b"].alias("a"), y["b"].alias("b")))

    held = groups.groupBy("bucket").agg(F.collect_list(F.struct("b", "label", "size", "less", "more")).alias("nodes"))
    return held.select(F.explode(F.flatten(F.transform("nodes", lambda x: links(x, F.col("nodes"))))).alias("link")).select("link.*").distinct()


def referred(groups: DataFrame) -> DataFrame:
    """The groups (bucket, n, b, size, less, more), after what over half of a group's first REFERENCE nodes by hash add has
    been put into its reference, and what over half of them miss been left out of it. Any reference gives right results."""
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("b"))
    picked = groups.select("bucket", "b").withColumn("place", F.row_number().over(order)).where(F.col("place") <= REFERENCE)
    held = groups.select("bucket", "b", "less", "more").join(picked.select("bucket", "b"), ["bucket", "b"]).groupBy("bucket").agg(F.collect_list("less").alias("less"), F.collect_list("more").alias("more"))

    def common(sets: str) -> Column:
        """What over half of the sets have: of all elements in order, those that come again half the sets later."""
        return F.array_distinct(F.element_at(F.transform(F.array(F.array_sort(F.flatten(sets))), lambda x: F.filter(x, lambda e, i: F.get(x, i + F.floor(F.size(sets) / 2).cast("int")) == e)), 1))

    flips = cut(held.select("bucket", common("less").alias("out"), common("more").alias("into")), "flips")
    held = groups.join(flips, "bucket")
    return held.select(
        "bucket", "n", "b", (F.col("size") + F.size("into") - F.size("out")).alias("size"),
        F.concat(F.array_except("less", "out"), F.array_except("into", "more")).alias("less"),
        F.concat(F.array_except("more", "into"), F.array_except("out", "less")).alias("more"),
    )


def with_gain(threshold: float) -> Column:
    """Linked nodes share at least minus half the sum of their gains of elements that they add or miss."""
    least = threshold / (1 + threshold)  # linked nodes share this part of the sum of their sizes
    return F.col("size") - 2 * F.size("less") - 2 * least * (F.col("size") - F.size("less") + F.size("more"))


def meet_again(known: DataFrame, threshold: float) -> DataFrame:
    """(bucket, old, b, label): nodes of a group that may be linked to one of another label share a bucket.

    known: rows of referred() with gain and label. The nodes of a group are
    summed up by label (that of the largest gain, or another) and by steps of
    the numbers they miss and add. For a node, each sum of other labels says how
    many elements two linked nodes share at least of those they add (`added`),
    and of both kinds (`needed`). Of what a node adds all but the last added - 1
    are given (prefix filter, by hash order); those it misses only if `added`
    may be none.
    """
    step = lambda x: F.floor(F.log(STEP, F.size(x) + F.lit(1.0)))
    tops = known.groupBy("bucket").agg(F.max(F.struct("gain", "label"))["label"].alias("top"))
    known = cut(known.join(tops, "bucket"), "known")
    kinds = known.groupBy("bucket", (F.col("label") == F.col("top")).alias("in_top"), step("less").alias("p"), step("more").alias("q")).agg(
        F.max("gain").alias("gain"), F.max(F.size("less")).alias("less"), F.max(F.size("more")).alias("more")
    )
    sums = cut(kinds.groupBy("bucket").agg(F.collect_list(F.struct("in_top", "gain", "less", "more")).alias("kinds")), "kinds")
    less, more, in_top = F.size("less"), F.size("more"), F.col("label") == F.col("top")

    def bounds(k: Column) -> Column:
        needed = F.ceil(-(F.col("gain") + k["gain"]) / 2 - 1e-9)
        added = needed - F.least(less, k["less"])
        return F.when((~in_top | ~k["in_top"]) & (added <= F.least(more, k["more"])), F.struct(added.alias("added"), needed.alias("needed")))

    found = F.filter(F.transform("kinds", bounds), lambda x: x.isNotNull())
    joined = known.join(sums, "bucket").withColumn("found", found).where(F.size("found") > 0)
    joined = joined.withColumns({"added": F.array_min(F.transform("found", lambda x: x["added"])), "needed": F.greatest(F.lit(1), F.array_min(F.transform("found", lambda x: x["needed"])))})
    prefix = lambda x, least: F.slice(x, F.lit(1), F.greatest(F.lit(0), F.size(x) - least + 1).cast("int"))
    adds = prefix(F.sort_array("more"), F.greatest(F.lit(1), F.col("added")))
    both = F.when(F.col("added") < 1, prefix(F.sort_array(F.concat("more", "less")), F.col("needed"))).otherwise(F.array().cast("array<long>"))
    kept = joined.select(F.col("bucket").alias("old"), "b", "label", F.explode(F.array_union(adds, both)).alias("element"))
    return kept.select(F.xxhash64("old", "element").alias("bucket"), "old", "b", "label")


def gathered(met: DataFrame, node: str, label: str | None = None) -> DataFrame:
    """met with the number n of rows in their bucket: those of buckets that have several nodes (several labels, if given); of buckets of the same nodes one."""
    same = ["n", "low", "high", "nodes"]
    aggregates = [F.count("*").alias("n"), F.min(node).alias("low"), F.max(node).alias("high"), F.bit_xor(F.xxhash64(node)).alias("nodes")]
    if label:
        aggregates += [F.min(label).alias("first"), F.max(label).alias("last")]
    buckets = met.groupBy("bucket").agg(*aggregates).where("first < last" if label else "low < high")
    kept = buckets.groupBy(*same).agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return met.join(kept, "bucket")


def classified(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, class, class_id) for every row: a number of its class, and the smallest doc_id of it."""
    prints = cut(fingerprints(documents), "fingerprints")
    # Equal multisets: one row's node stands for them.
    same = prints.where(F.col("content").isNotNull()).groupBy("content").agg(F.min("doc_id").alias("first"), F.min("node").alias("stands"), F.count("*").alias("n"))
    copies = cut(same.where("n > 1").drop("n"), "copies")
    stands = F.coalesce("stands", "node")
    joined = prints.join(copies, "content", "left")
    own = cut(
        joined.select("doc_id", "text_hash", stands.alias("node"), F.coalesce("first", "doc_id").alias("first"), *(F.when(stands == F.col("node"), F.col(c)).alias(c) for c in ("content", "bands"))),
        "own",
    )
    discard(prints, copies)
    singles = own.where(F.col("bands").isNotNull())
    members = cut(gathered(singles.select("node", F.explode("bands").alias("bucket")), "node"), "members")
    labels = _resolve(documents, singles.select("node", "doc_id", "content"), members, threshold)
    classes = labels.join(singles.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("class_id"))
    found = cut(labels.join(classes, "label").select("node", "label", "class_id"), "classes")
    return own.join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("class"), F.coalesce("class_id", "first").alias("class_id"))


def _resolve(documents: DataFrame, nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, label) of all nodes with a link; members: (bucket, node, n)."""
    weight = cut(members.groupBy("node").agg(F.sum("n").alias("weight")), "weight")
    sets = element_sets(documents, nodes.join(weight.select("node"), "node", "left_semi"))
    leading = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("a"))
    led = cut(members.join(leading, "bucket").select("a", F.col("node").alias("b")).distinct(), "led")
    differ = cut(differences(led, sets).dropDuplicates(["a", "b"]), "differ")
    discard(members, weight, sets, led)
    shared = F.col("size") - F.size("less")
    labels = contracted(differ.where(_linked(F.col("size") + shared + F.size("more"), shared, threshold)).select("a", "b"))
    none = F.array().cast("array<long>")
    leaders = differ.groupBy("a").agg(F.max("size").alias("size")).select(F.col("a").alias("bucket"), F.col("a").alias("b"), "size", none.alias("less"), none.alias("more"))
    groups = differ.withColumnRenamed("a", "bucket").unionByName(leaders)

    def labelled(groups: DataFrame) -> DataFrame:
        """With the label of each node's class so far."""
        return groups.join(labels.toDF("b", "known"), "b", "left").withColumn("label", F.coalesce("known", "b")).drop("known")

    # A group of two is verified already.
    groups = cut(gathered(labelled(groups), "b", "label").where("n > 2"), "groups")
    while True:
        sizes = groups.groupBy("bucket", "n").agg(F.sum(F.size("less") + F.size("more")).alias("held"))
        large = cut(sizes.where((F.col("n") > SMALL) | (F.col("n") > 2) & (F.col("held") > HELD)).select("bucket"), "large-groups")
        labels = merged(labels, between(groups.join(large, "bucket", "left_anti"), threshold))
        large = cut(labelled(groups.join(large, "bucket", "left_semi").drop("label")), "large")
        discard(groups)
        if large.isEmpty():
            return labels
        large = cut(referred(gathered(large.drop("n"), "b", "label")).withColumn("gain", with_gain(threshold)), "referred")
        most = large.groupBy("bucket").agg(F.max(F.struct("gain", "b")).alias("most"))
        enough = large.join(most, "bucket").where((F.col("gain") + F.col("most.gain") >= -1e-9) & (F.col("b") != F.col("most.b")))
        labels = merged(labels, enough.select(F.col("most.b").alias("a"), "b"))
        again = cut(meet_again(labelled(large), threshold), "again")
        met = gathered(again, "b", "label").select("bucket", "old", "b", "n", "label")
        rows = large.select(F.col("bucket").alias("old"), "b", "size", "less", "more")
        groups = cut(met.join(rows, ["old", "b"]).drop("old"), "groups")
        discard(large, again)


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) for every row: the smallest doc_id of its class."""
    return classified(documents, threshold).select("doc_id", "class_id")


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest doc_id, and of several such rows the one whose text has the
    smallest hash. Rows that are equal in doc_id and text are one; rows without an id stay; null and empty texts are
    classes of their own; other columns are kept as they are, whatever their names; an empty table stays empty."""
    kept = classified(docs).where(F.col("doc_id") == F.col("class_id")).groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"))
    keep = cut(kept.select("doc_id", "text_hash").distinct(), "keep")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = rows.join(keep, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return one.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
