"""Operator 11: collocations by growing contiguous patterns from frequent prefixes.

A document's pieces are words in a row. An occurrence of a prefix stands for
itself with the words that follow it in its piece, as far as the longest phrase
reaches: its window. The projection of the corpus deals the windows out by the
hash of their first word, BUCKET_BYTES of text to a bucket; a row holds, packed,
all windows of one bucket in one chunk of texts, so there are not as many rows
as occurrences.

A bucket is one task's work: pointers into its text are grouped by the word
they point at, and each frequent prefix is grown to the right, depth first, with
its own pointers moved on by a word. In a bucket of more than twice `group`
windows a prefix is very frequent. There the prefixes themselves are counted by
partial sums, and the windows are dealt out anew by the hash of one word more,
into as many buckets as they have times `group`; these go through the same
again. `group` is a WIDE-th of all words where that is more, so at most WIDE
buckets are too large at once, and only their numbers are broadcast.

Scores are exact: their products are decimals of 38 digits.

Defined cases: a null lang is `und`, a null or empty text has no word; repeated
rows count each; pieces without any mark can be as long as a text; an empty
table gives an empty result; columns besides lang and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, dealt, discard, table

MIN_COUNT, MAX_WORDS, TOP_K = 100, 5, 2000
#: A candidate goes if a longer one around it has so many hundredths of its occurrences.
COVERED = 100
#: Windows that one task mines by itself, and the most buckets that can have more.
GROUP, WIDE = 400_000, 2_000_000
#: Bytes of text whose windows make a bucket of the first projection.
BUCKET_BYTES = 4 << 20
#: Bytes of text that are projected at once.
CHUNK = 2 << 20
#: Ranges of hashes among which a language's best are sought before they meet.
SALTS = 64
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Marks and line ends end a piece, a tab is a space, and only A-Z have another case.
BYTES = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
PROJECTION = "lang string, bucket long, n long, windows binary"
PATTERN = "lang string, phrase string, words int, f long"


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and whether its line ends with it; words are apart by one space or line feed, which ends the text, too."""
    signs = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero((signs == 32) | (signs == 10)).astype(np.int32 if len(text) < 1 << 31 else np.int64)
    return np.append(ends.dtype.type(0), ends[:-1] + 1), ends, signs[ends] == 10


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, pieces, each with a line feed) of rows (lang, text), in chunks of one language."""
    waiting: dict[str, list[bytes]] = {}
    size: Counter[str] = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = (text.as_py() or "").encode().translate(BYTES) + b"\n"
            while raw:  # a long text goes in parts that end with a piece
                upto = raw.find(b"\n", CHUNK) + 1 or len(raw)
                part, raw = raw[:upto], raw[upto:]
                waiting.setdefault(lang, []).append(part)
                size[lang] += len(part)
                if size[lang] >= CHUNK:
                    yield lang, b"".join(waiting.pop(lang))
                    size[lang] = 0
    for lang, parts in waiting.items():
        yield lang, b"".join(parts)


def texts(documents: DataFrame) -> DataFrame:
    return dealt(documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"))


def packed(lang: str, numbers: np.ndarray, windows: Callable[[np.ndarray], list[bytes]]) -> pa.RecordBatch:
    """A row for each bucket, whose windows stand one behind the other; numbers: each window's bucket, windows: those at some places."""
    order = np.argsort(numbers, kind="stable")
    buckets, counts = np.unique(numbers, return_counts=True)
    pack = zstandard.ZstdCompressor(level=1).compress
    blobs = [pack(b"\n".join([*windows(places), b""])) for places in np.split(order, np.cumsum(counts)[:-1])] if len(order) else []
    columns = [pa.array([lang] * len(blobs), pa.string()), pa.array(buckets, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n", "windows"])


def unpacked(windows: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(windows.as_py())


def project(documents: DataFrame, buckets: int) -> DataFrame:
    """The windows of all words by the hash of the word: (lang, bucket, n, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in chunks(batches):
            pieces = (b" ".join(piece.split()) for piece in text.split(b"\n"))
            text = b"".join([piece + b"\n" for piece in pieces if piece])
            if not text:
                continue
            words = text.split()
            begin, ends, last = words_of(text)
            line_ends, at = np.flatnonzero(last), np.arange(len(words))
            stops = ends[np.minimum(at + MAX_WORDS - 1, line_ends[np.searchsorted(line_ends, at)])]
            hashes = {w: zlib.crc32(w) % buckets for w in set(words)}
            numbers = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
            del words, hashes
            yield packed(lang, numbers, lambda at: [text[a:b] for a, b in zip(begin[at].tolist(), stops[at].tolist())])

    return texts(documents).mapInArrow(run, PROJECTION)


def project_on(large: DataFrame, length: int) -> DataFrame:
    """Windows of large buckets (with their `parts`) by the hash of their first `length` words; shorter ones have nothing more to give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, bucket, blob, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                split = [(w, w.split(b" ", length)) for w in unpacked(blob).split(b"\n")[:-1]]
                windows = [(w, b" ".join(words[:length])) for w, words in split if len(words) >= length]
                # Buckets that get one number by chance are mined together, which does no harm.
                numbers = [(bucket * 1_000_003 + zlib.crc32(first) % parts + 1) & (1 << 62) - 1 for _, first in windows]
                yield packed(lang, np.array(numbers, np.int64), lambda at: [windows[i][0] for i in at.tolist()])

    return large.mapInArrow(run, PROJECTION)


def count_prefixes(large: DataFrame, length: int, min_count: int) -> DataFrame:
    """(lang, phrase, words, f) of the frequent prefixes of `length` words in large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch.column(0).to_pylist(), batch.column(3)):
                split = (w.split(b" ", length) for w in unpacked(blob).split(b"\n")[:-1])
                counts = Counter(b" ".join(words[:length]) for words in split if len(words) >= length)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "phrase": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    counted = large.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return counted.where(F.col("f") >= min_count).select("lang", "phrase", F.lit(length).alias("words"), "f")


def grow(text: bytes, words: tuple[np.ndarray, np.ndarray, np.ndarray], pointers: np.ndarray, prefix: str, length: int, min_count: int) -> Iterator[tuple[str, int, int]]:
    """(phrase, words, occurrences) of the frequent phrases that go on from a prefix of `length` words; pointers: the word behind each of its occurrences."""
    begin, end, last = words
    following = [text[a:b] for a, b in zip(begin[pointers].tolist(), end[pointers].tolist())]
    counts = {w: n for w, n in Counter(following).items() if n >= min_count}
    number = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter((number.get(w, -1) for w in following), np.int64, len(following))
    order = np.argsort(ids, kind="stable")
    at = len(ids) - sum(counts.values())  # the others come first
    for word, n in counts.items():
        phrase, mine = prefix + " " * (length > 0) + word.decode(), pointers[order[at : at + n]]
        at += n
        yield phrase, length + 1, n
        mine = mine[~last[mine]] + 1
        if length + 1 < MAX_WORDS and len(mine) >= min_count:
            yield from grow(text, words, mine, phrase, length + 1, min_count)


def mine(level: DataFrame, length: int, min_count: int) -> DataFrame:
    """Frequent phrases (lang, phrase, words, f) of `length` words and more in each bucket, one task's work, dealt by their first `length` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)))
        for (lang, _), same in groupby(rows, key=lambda r: r[:2]):
            text = b"".join([unpacked(blob) for *_, blob in same])
            words = words_of(text)
            first = np.append(0, np.flatnonzero(words[2])[:-1] + 1)
            if found := [x for x in grow(text, words, first, "", 0, min_count) if x[1] >= length]:
                phrases, lengths, counts = zip(*found)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "phrase": pa.array(phrases, pa.string()), "words": pa.array(lengths, pa.int32()), "f": pa.array(counts, pa.int64())})

    return level.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(run, PATTERN)


def frequent_phrases(documents: DataFrame, min_count: int = MIN_COUNT, group: int = GROUP, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(phrases (lang, phrase, words, f) of 1 to MAX_WORDS words with f >= min_count, words of each language (lang, n))."""
    size = documents.agg(F.sum(F.octet_length("text")).alias("bytes")).head()["bytes"] or 0
    level, key = cut(project(documents, 1 + size // bucket_bytes), "projection"), ["lang", "bucket"]
    totals = cut(level.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    group = max(group, (totals.agg(F.sum("n").alias("n")).head()["n"] or 0) // WIDE)
    found = []
    for length in range(1, MAX_WORDS + 1):
        sizes = level.groupBy(*key).agg(F.sum("n").alias("f")).where(F.col("f") > 2 * group)
        wide = cut(sizes.select(*key, F.ceil(F.col("f") / group).cast("int").alias("parts")), "wide")  # WIDE rows at most, by their sizes
        found.append(cut(mine(level.join(F.broadcast(wide), key, "left_anti").select(*level.columns), length, min_count), "phrases"))
        if wide.isEmpty():
            break
        large = level.join(F.broadcast(wide), key).select(*level.columns, "parts")
        found.append(cut(count_prefixes(large, length, min_count), "phrases"))
        if length < MAX_WORDS:
            deeper = cut(project_on(large, length + 1), "projection")
            discard(level)
            level = deeper
    discard(level)
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases, totals


def exact_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) of long columns."""
    wide = "cast({} as decimal(20, 0))".format
    return F.expr(f"cast((cast(1000 as decimal(4, 0)) * cast({wide(a)} * {wide(n)} as decimal(34, 0))) div cast({wide(left)} * {wide(right)} as decimal(38, 0)) as long)")


def part(words: Column, first: Column | int, count: Column) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def collocations(documents: DataFrame, min_count: int = MIN_COUNT, k: int = TOP_K, covered: int = COVERED, group: int = GROUP, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's k best phrases of 2 to MAX_WORDS words."""
    phrases, totals = frequent_phrases(documents, min_count, group, bucket_bytes)
    candidates = phrases.where(F.col("words") >= 2).withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.col("w"), 1, F.col("k")).alias("first"), part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"]).join(totals, "lang")
    lowest = F.min(F.struct(exact_score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest)
    # What lies in a longer candidate lies, word by word, in one longer by a word with no fewer occurrences than that.
    longer = candidates.where(F.col("words") >= 3)
    inside = longer.select("lang", "f", F.explode(F.array(part(F.col("w"), 1, F.col("words") - 1), part(F.col("w"), 2, F.col("words") - 1))).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= k).drop("salt", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= k)  # of SALTS * k rows at most
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lines AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lines),
phrases AS (
  SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (SELECT unnest(range(1, 6)) AS words) WHERE i + words - 1 <= len(w) GROUP BY 1, 2, 3
), totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM phrases WHERE words = 1 GROUP BY 1),
frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM phrases WHERE f >= 100),
cuts AS (
  SELECT lang, phrase, f AS a, words, w, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest, k
  FROM frequent, (SELECT unnest(range(1, 5)) AS k) WHERE k < words
), scored AS (
  SELECT c.lang, c.phrase, c.words, a, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score, k
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.first JOIN frequent r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM frequent x WHERE x.lang = c.lang AND x.words > c.words AND x.f * 100 >= 100 * c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
