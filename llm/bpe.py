"""Operator 5: byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is split by the pattern of the rank file; each match is merged on its
own. Over the byte positions of a match stands a segment tree. A leaf holds
the rank of the pair that starts at its position (or NONE), packed with the
position, so that the root is the leftmost minimum. A merge takes the root,
joins the pair, and updates three leaves: the merged position, its live left
neighbour and the consumed position. Each update walks one path to the root.

Matches of the same tree height are merged together as rows of one numpy
array, each with its own tree. Matches longer than LANES_UP_TO bytes get a
tree of their own, in linear memory and n log n time.

Defined cases: null and empty texts have no ids; texts of any length are
encoded whole; repeated rows and ids are each encoded; an empty table gives an
empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from llm.common import dealt, table

NONE = np.int64(1) << 40
#: Matches of up to so many bytes are merged side by side.
LANES_UP_TO = 64
#: Words whose ids a worker keeps, and words that are encoded at once.
CACHE_WORDS, LANE_WORDS = 400_000, 20_000
#: White space before a space: only then the pattern's matches can reach over a space.
ACROSS = re.compile(r"\s ")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairRanks:
    """Rank of the token that two tokens make, as an open-addressing table in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            ((ranks[word[:i]] << 32) | ranks[word[i:]], rank)
            for word, rank in ranks.items()
            for i in range(1, len(word))
            if word[:i] in ranks and word[i:] in ranks
        ]
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([v for _, v in pairs], np.int64)
        self.bits = max(4, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where no token is made. An id under 0 stands for no token."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Encoder:
    """Ids of texts, as a rank file gives them, and bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.pair = PairRanks(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = {rank: word for word, rank in ranks.items()}
        self.whole = ranks
        self.cache: dict[str, bytes] = {}

    def merge_lanes(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; the words have from 1 to LANES_UP_TO bytes, and one tree each."""
        n = len(words)
        size = 1 << max(1, (max(map(len, words)) - 1).bit_length())
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
        ids = np.where(np.arange(size) < lengths[:, None], self.byte[raw], -1)
        shift = np.int64(size.bit_length())
        tree = np.full((n, 2 * size), NONE << shift, np.int64)
        tree[:, size : 2 * size - 1] = (self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1) << shift) | np.arange(size - 1)
        for level in range(size.bit_length() - 2, -1, -1):
            at = 1 << level
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
        after = np.tile(np.arange(1, size + 1), (n, 1))  # the next live position; size: none
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows, 1] < NONE << shift]
            if not len(rows):
                break
            root = tree[rows, 1]
            at, rank = root & ((1 << shift) - 1), root >> shift
            gone = after[rows, at]
            then, prev = after[rows, gone], before[rows, at]
            ids[rows, at], ids[rows, gone] = rank, -1
            after[rows, at] = then
            has = then < size
            before[rows[has], then[has]] = at[has]
            right = np.where(has, ids[rows, np.minimum(then, size - 1)], -1)
            left = np.where(prev >= 0, ids[rows, np.maximum(prev, 0)], -1)
            self._update(tree, rows, size + at, (self.pair(rank, right) << shift) | at)
            self._update(tree, rows, size + gone, NONE << shift)
            some = prev >= 0
            p = prev[some]
            self._update(tree, rows[some], size + p, (self.pair(left[some], rank[some]) << shift) | p)
        return [row[row >= 0] for row in ids]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value) -> None:
        tree[rows, leaf] = value
        for _ in range((tree.shape[1] // 2).bit_length() - 1):
            leaf = leaf >> 1
            tree[rows, leaf] = np.minimum(tree[rows, 2 * leaf], tree[rows, 2 * leaf + 1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word, with one tree over its bytes."""
        n = len(word)
        size = 1 << (n - 1).bit_length()
        start = self.byte[np.frombuffer(word, np.uint8)]
        leaves = np.full(size, NONE, np.int64)
        leaves[: n - 1] = self.pair(start[:-1], start[1:])
        shift, none = size.bit_length(), int(NONE)
        level = (leaves << shift) | np.arange(size)
        levels = [level]
        while len(level) > 1:
            levels.append(level := np.minimum(level[::2], level[1::2]))
        tree = [0] + [x for level in reversed(levels) for x in level.tolist()]
        ids, after, before = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        one = np.empty(2, np.int64), np.empty(2, np.int64)

        def put(at: int, rank: int) -> None:
            at_leaf = size + at
            tree[at_leaf] = (rank << shift) | at
            at_leaf >>= 1
            while at_leaf:
                a, b = tree[2 * at_leaf], tree[2 * at_leaf + 1]
                tree[at_leaf] = a if a < b else b
                at_leaf >>= 1

        while (root := tree[1]) >> shift < none:
            at, rank = root & ((1 << shift) - 1), root >> shift
            gone = after[at]
            then, prev = after[gone], before[at]
            ids[at], ids[gone], after[at] = rank, -1, then
            if then < n:
                before[then] = at
            one[0][:] = rank, ids[prev] if prev >= 0 else -1
            one[1][:] = ids[then] if then < n else -1, rank
            made = self.pair(*one).tolist()
            put(gone, none)
            put(at, made[0])
            if prev >= 0:
                put(prev, made[1])
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        """Ids of each match of the pattern, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(matches)
        by_height: dict[int, list[tuple[int, bytes]]] = {}
        for i, match in enumerate(matches):
            word = match.encode()
            rank = self.whole.get(word)
            if rank is not None and len(word) == 1:
                out[i] = np.uint32(rank).tobytes()
            elif len(word) > LANES_UP_TO:
                out[i] = self.merge_long(word).astype("<u4").tobytes()
            else:
                by_height.setdefault((len(word) - 1).bit_length(), []).append((i, word))
        for lanes in by_height.values():
            for first in range(0, len(lanes), LANE_WORDS):
                part = lanes[first : first + LANE_WORDS]
                for (i, _), ids in zip(part, self.merge_lanes([w for _, w in part])):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        """Put the words' ids into the cache. No match of the pattern reaches over a word's ends."""
        words = [w for w in words if w not in self.cache]
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        split = [self.pattern.findall(w) for w in words]
        matches = list({m for ms in split for m in ms})
        known = dict(zip(matches, self.encode_matches(matches)))
        self.cache.update((w, b"".join([known[m] for m in ms])) for w, ms in zip(words, split))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers.

        A space that follows no white space always begins a match, so most
        texts are cut at spaces and only new words are split by the pattern.
        """
        cut = []
        for text in texts:
            if ACROSS.search(text) or text.startswith(" "):
                cut.append(self.pattern.findall(text))
            else:
                first, *rest = text.split(" ")
                cut.append([first, *(" " + w for w in rest)])
        out, at = [], 0
        while at < len(cut):  # some texts at a time, so that their words fit into the cache
            new: set[str] = set()
            upto = at
            while upto < len(cut) and (upto == at or len(new) < CACHE_WORDS // 4):
                new.update(cut[upto])
                upto += 1
            if not new <= self.cache.keys():
                missing = new - self.cache.keys()
                if len(self.cache) + len(missing) > CACHE_WORDS:
                    self.cache.clear()
                    missing = new
                self.learn(missing)
            get = self.cache.__getitem__
            out += [b"".join(map(get, words)) for words in cut[at:upto]]
            at = upto
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each rank file and Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def encode(documents: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with keep_ids the ids and the decoded bytes."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                ids = bpe.encode_batch([t or "" for t in part.column(1).to_pylist()])
                decoded = [bpe.decode(x) for x in ids] if keep_ids else map(bpe.decode, ids)
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return dealt(documents.select(documents["doc_id"].cast("long"), "text")).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
