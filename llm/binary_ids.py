"""Operator 8: token ids in binary files, byte-aligned with separate control bytes.

Ids are replaced by their rank of frequency over all documents (ties: smaller
id first), so that most fit into one byte. A rank takes from 1 to 4 bytes; two
bits of a control byte hold the length of each of four ranks, and all control
bytes stand before the data. Reading looks each control byte up in a table of
256 rows of four lengths.

Files hold whole documents in ascending doc_id order, and files follow each
other by name: `part-<range>-<n>.svb`. A file is

    b"SVB1", documents (u4), ids in the range before this file (u8),
    doc_id (i8 each), ids (u4 each), data bytes (u4 each),
    control bytes of each document, data bytes of each document.

The texts are tokenised once; the ids are written as Parquet, counted by id
(the vocabulary bounds the counts), encoded, dealt out by ranges of doc_id and
sorted there. A task writes a file beside its place and then renames it if none
is there, and a repeated task writes the same bytes, so lost executors do no
harm.

Defined cases: a null or empty text has the end id only; a null doc_id comes
first and is read back as null; repeated doc_ids are ordered by their ids'
bytes; an empty table has no files; only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, dealt, discard, shared_path, table

END_ID = 0
MAGIC = b"SVB1"
#: Ids in a range of doc_ids, and in a file, before a new one is begun.
RANGE_IDS, FILE_IDS = 4_000_000, 8_000_000
#: Stands for a null doc_id in a file.
NULL_ID = -(1 << 63)
#: Lengths of the four ranks of each control byte.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
PLACE = np.arange(4, dtype=np.uint8)
#: Words in each of the two generations that a worker keeps.
CACHE_WORDS = 700_000
#: Longest word that is kept.
KEPT_CHARS = 100
#: Bytes of texts that are looked up together, and new words that are encoded as one text.
PART_BYTES, TEXT_WORDS = 4_000_000, 20_000
#: Plain words that go through the merges together: more than the library's own cache takes as one.
JOINED_WORDS = 64
#: A space and letters, of scripts all versions of Unicode agree on: one match of the pattern.
PLAIN = "^ [A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+$"
#: Words before and after which others may stand: from white space to something that is none for certain.
JOINABLE = "(?s)^[ \t\n\r].*[!-~\xc0-\u024f]$"
#: Kinds of bytes: 1 white space, 2 signs, 3 letters and digits, 0 any other.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 2
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 3
KIND[[9, 10, 13, 32]] = 1


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


BYTE_SIGNS = byte_signs()


def cuts(data: np.ndarray) -> np.ndarray:
    """True for each byte of UTF-8 texts at which a match of the pattern begins, whatever the texts go on with.

    That is white space after anything else, and an ASCII sign after a letter
    or digit. Where a character might be white space, or no letter, there is no
    cut, which does no harm.
    """
    kind = KIND[data]
    before, here = kind[:-1], kind[1:]
    out = np.zeros(len(data), bool)
    out[1:] = (here == 1) & (before >= 2) | (here == 2) & (before == 3)
    at = np.flatnonzero(((here == 1) | (here == 2)) & (data[:-1] >= 0x80)) + 1  # after a character of 2 to 4 bytes
    d, c, b, a = (data[np.maximum(at - k, 0)] for k in (1, 2, 3, 4))
    letter = (c >= 0xC3) & (c <= 0xC8) & ~((c == 0xC3) & ((d == 0x97) | (d == 0xB7)))  # U+00C0 to U+023F but two
    solid = (c >= 0xC3) & (c <= 0xDF) | (b == 0xE0) | (b >= 0xE4) & (b <= 0xEF) | (a >= 0xF0)
    solid |= (b == 0xE1) & (c >= 0xB4) | (b == 0xE3) & (c >= 0x81) | (b == 0xE2) & ((c >= 0x82) | (c == 0x80) & (d >= 0x90) & (d <= 0xA7))
    out[at] = np.where(kind[at] == 1, solid, letter)
    return out


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    v, n = ranks.astype("<u4"), len(ranks)
    most = max(1, -(-int(v.max(initial=0)).bit_length() // 8))  # bytes of the longest
    used = np.ones((n, most), bool)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    for k in range(1, most):
        used[:, k] = v >> 8 * k > 0
        codes[:n] += used[:, k]
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.tobytes(), np.compress(used.ravel(), v.view(np.uint8).reshape(-1, 4)[:, :most].ravel()).tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[lengths[:, None] > PLACE] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def file_bytes(docs: list[tuple[int, int, bytes, bytes]], before: int) -> bytes:
    """docs: doc_id, ids, control bytes, data bytes."""
    ids, counts, controls, data = zip(*docs)
    return b"".join([
        MAGIC, struct.pack("<IQ", len(docs), before), np.array(ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes(),
        np.array([len(d) for d in data], "<u4").tobytes(), *controls, *data,
    ])


def read_file(raw: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, ids in the range before it, and its ranks, for each document of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a file of token ids")
    n, before = struct.unpack_from("<IQ", raw, 4)
    ids = np.frombuffer(raw, "<i8", n, 16)
    counts = np.frombuffer(raw, "<u4", n, 16 + 8 * n)
    sizes = np.frombuffer(raw, "<u4", n, 16 + 12 * n)
    control = 16 + 16 * n
    data = control + int(((counts.astype(np.int64) + 3) // 4).sum())
    for doc_id, count, size in zip(ids.tolist(), counts.tolist(), sizes.tolist()):
        k = (count + 3) // 4
        yield (None if doc_id == NULL_ID else doc_id), before, unpack(raw[control : control + k], raw[data : data + size], count)
        control, data, before = control + k, data + size, before + count


class Ids:
    """Ids of texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    A byte-level tokenizer without normaliser splits texts by its pattern. So
    texts are cut where a match begins for certain, all at once in their
    bytes; the words of many texts are looked up once each, and new words are
    encoded by the library, many as one text, and kept. Plain words need its
    merges alone. The bytes of a token tell where words end among the ids; as
    tokens only grow by merges, no merge has reached over a word's end if no
    token does, and else words are encoded one by one. Texts that hold an
    added token, and texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        self.by_word = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_word = self.by_word and not any(a.split() != [a] for a in self.added)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a sign of a byte-level token is a byte
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))
        model = made["model"]
        unset = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.by_merges = model.get("type") == "BPE" and unset
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _shared_out(self, ids: np.ndarray, words: list[str]) -> list[bytes] | None:
        """The ids of words that follow each other, by word; None if a token reaches over a word's end."""
        ends = np.cumsum(self.bytes_of[ids])
        want = np.cumsum(pc.binary_length(pa.array(words, pa.large_string())).to_numpy())
        upto = np.searchsorted(ends, want) + 1
        if len(ends) < len(words) or upto[-1] != len(ends) or (ends[upto - 1] != want).any():
            return None
        raw, upto = ids.tobytes(), (4 * upto).tolist()
        return [raw[a:b] for a, b in zip([0, *upto], upto)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with white space and end with none: as one text, if no token reaches over a word's end."""
        return self._shared_out(np.frombuffer(self._encode(["".join(words)])[0], "<u4"), words) or self._encode(words)

    def _merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words."""
        tokenize, ids = self.tokenizer.model.tokenize, []
        for at in range(0, len(words), JOINED_WORDS):
            signs = "".join(words[at : at + JOINED_WORDS]).encode().decode("latin-1").translate(BYTE_SIGNS)
            ids += [t.id for t in tokenize(signs)]
        return self._shared_out(np.array(ids, "<u4"), words) or self._encode_words(words)

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of new words."""
        column, left, out = pa.array(words, pa.large_string()), np.ones(len(words), bool), [b""] * len(words)
        for pattern, encode in ((PLAIN, self._merge_words), (JOINABLE, self._encode_words)):
            if pattern is PLAIN and not self.by_merges:
                continue
            fit = left & pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
            left &= ~fit
            rows = np.flatnonzero(fit).tolist()
            for at in range(0, len(rows), TEXT_WORDS):
                part = rows[at : at + TEXT_WORDS]
                for i, x in zip(part, encode([words[i] for i in part])):
                    out[i] = x
        rows = np.flatnonzero(left).tolist()
        for i, x in zip(rows, self._encode([words[i] for i in rows])):
            out[i] = x
        return out

    def _look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut, one after another, and where each text's end."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begins = cuts(data)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        places = np.append(np.flatnonzero(begins), len(data))
        known = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        words = known.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, words))
        fresh = [i for i, x in enumerate(found) if x is None]
        if fresh:
            new = [words[i] for i in fresh]
            ids = list(map(self.old.get, new))
            rows = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(rows, self._learn([new[i] for i in rows])):
                ids[i] = x
            for i, x in zip(fresh, ids):
                found[i] = x
            self.young.update(zip(new, ids))
            for w in [w for w in new if len(w) > KEPT_CHARS]:
                del self.young[w]
        each = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = known.indices.to_numpy()
        n = each[word]
        ends = np.append(0, np.cumsum(n))
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat((np.cumsum(each) - each)[word] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(places, offsets[1:])]

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Texts (none null), ids of these, one after another, and where each text's end, for some texts at a time."""
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
            part = texts.slice(at, upto - at)
            whole = np.full(len(part), not self.by_word)
            for a in self.added if self.by_word else []:
                whole |= pc.match_substring(part, a).to_numpy(zero_copy_only=False)
            if not whole.any():
                ids, ends = self._look_up(part)
            else:
                ids, ends = self._look_up(pc.if_else(pa.array(whole), "", part))
                each = np.split(ids, ends[:-1])
                rows = np.flatnonzero(whole)
                for i, x in zip(rows.tolist(), self._encode(part.take(pa.array(rows)).to_pylist())):
                    each[i] = np.frombuffer(x, "<u4")
                ids, ends = np.concatenate(each), np.cumsum(list(map(len, each)))
            yield len(part), ids, ends
            at = upto

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for _, ids, ends in self.parts(pa.array(texts, pa.large_string())) for x in np.split(ids, ends[:-1])]


_tokenizers: dict[str, Ids] = {}


def tokenizer(path: str) -> Ids:
    if path not in _tokenizers:
        _tokenizers[path] = Ids(path)
    return _tokenizers[path]


def token_ids(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, wide, ids): ids with the end id, in 2 bytes each, or in 4 if one needs it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            at = 0
            for n, ids, ends in encode.parts(pc.fill_null(batch.column(1), "")):
                flat, ends = np.insert(ids, ends, END_ID), ends + np.arange(1, n + 1)
                wide = np.maximum.reduceat(flat, np.append(0, ends[:-1])) > 0xFFFF
                raw = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(np.split(flat, ends[:-1]), wide)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(wide), pa.array(raw, pa.binary())], ["doc_id", "wide", "ids"])
                at += n

    return dealt(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, wide boolean, ids binary")


def frequencies(ids: DataFrame) -> list[tuple[int, int]]:
    """(id, count) over all documents, most frequent first; as many as ids of the vocabulary occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for wide in (False, True):
                raw = b"".join(x for x, w in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()) if w == wide)
                if raw:
                    found = np.bincount(np.frombuffer(raw, "<u4" if wide else "<u2"))
                    if len(found) > len(total):
                        total = np.pad(total, (0, len(found) - len(total)))
                    total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = ids.select("wide", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return sorted(((r["id"], r["n"]) for r in counts), key=lambda x: (-x[1], x[0]))


def write_files(ids: DataFrame, folder: str) -> DataFrame:
    """Write the files, and `ranks` (a Parquet table of rank and id) beside them; (part, ids) for each range. ids is a table of cut(), and deleted."""
    spark = ids.sparkSession
    counts = frequencies(ids)
    spark.createDataFrame([(rank, i) for rank, (i, _) in enumerate(counts)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max((i for i, _ in counts), default=0) + 1, np.uint32)
    rank_of[[i for i, _ in counts]] = np.arange(len(counts))
    shared = spark.sparkContext.broadcast(rank_of)  # 4 bytes for each id of the vocabulary
    ranges = max(1, -(-sum(n for _, n in counts) // RANGE_IDS))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, "<u4" if w else "<u2") for w, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            both = [pack(shared.value[x]) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array([c for c, _ in both], pa.binary()), pa.array([d for _, d in both], pa.binary())],
                ["doc_id", "n", "control", "data"],
            )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(f"{folder}/ids")
        docs: list[tuple[int, int, bytes, bytes]] = []
        total, held, file = 0, 0, 0

        def close() -> None:
            nonlocal docs, total, held, file
            if docs:
                aside = f"{root}/_{part}-{file}-{attempt}"
                with store.open_output_stream(aside) as out:
                    out.write(file_bytes(docs, total))
                place = f"{root}/part-{part:06d}-{file:06d}.svb"
                if store.get_file_info(place).type == fs.FileType.NotFound:
                    store.move(aside, place)
                else:  # an earlier attempt wrote the same bytes
                    store.delete_file(aside)
                docs, total, held, file = [], total + held, 0, file + 1

        for batch in batches:
            for doc_id, n, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held + n > FILE_IDS:
                    close()
                docs.append((NULL_ID if doc_id is None else doc_id, n, control, data))
                held += n
        close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total], pa.int64())], ["part", "ids"])

    store, root = fs.FileSystem.from_uri(f"{folder}/ids")
    store.create_dir(root, recursive=True)
    encoded = cut(ids.mapInArrow(packed, "doc_id long, n long, control binary, data binary"), "packed")  # ranges are sampled before rows are dealt
    discard(ids)
    placed = encoded.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "control", "data")
    done = cut(placed.mapInArrow(save, "part long, ids long"), "ranges")
    discard(encoded)
    return done


def read_files(spark: SparkSession, folder: str, ranges: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_bytes) from the files."""
    id_of = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    sums = sorted((r["part"], r["ids"]) for r in ranges.collect())  # a row for each range
    before = dict(zip((p for p, _ in sums), np.cumsum([0, *(n for _, n in sums)]).tolist()))
    shared = spark.sparkContext.broadcast((id_of, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, base = shared.value
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                part = int(path.rpartition("/")[2].split("-")[1])
                rows = [(doc_id, base[part] + start, len(ranks), zlib.crc32(ids[ranks].tobytes())) for doc_id, start, ranks in read_file(raw)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not sum(n for _, n in sums):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.svb").load(f"{folder}/ids")
    return files.select("path", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = cut(token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "token-ids")
    folder = shared_path(spark, "binary-ids")
    return read_files(spark, folder, write_files(ids, folder))
