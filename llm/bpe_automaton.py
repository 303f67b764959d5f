"""Operator 13: BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts just the sequences that BPE makes. It
is compiled by a gadget for each merge (u, v) -> w, in the order of the merges.
At first there is one state with an arc for each byte. The gadget gives what
lies behind u a state of its own, takes the arc v from it, and lets an arc w go
from every state with an arc u to a copy of the state that v led to. So all
arcs of one label lead to one state, which is named after the label here, and
the automaton has one state more than tokens.

States are kept as differences: the arcs a gadget took from a state, and the
state it was copied from with the number of the gadget. Whether a state has an
arc is worked out from these when it is first asked, and then stands in the
transition table.

A word is encoded byte by byte. For each prefix there is one path that ends at
its end. Its last arc is the longest token there whose arc leaves the state
that was reached where the token begins; tokens that end at a byte come from
a goto table over the tokens' bytes. So work grows with a word's length alone.
Decoding follows the arcs and emits their labels' bytes.

Two token sequences that are each what BPE makes can still not stand together
if a merge joins them, which the taken arcs say; this holds if both parts of a
merge are made by earlier merges, and each token by one, which `compile`
checks.

Defined cases: null and empty texts have no ids; texts of any length are
encoded whole; repeated rows and ids are each encoded; an empty table gives an
empty result; columns besides doc_id and text are not read. Added tokens in a
text are single ids, as the library has them.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import ACROSS
from llm.common import dealt, table

#: The state before the first token.
START = -1
NEVER = 1 << 60
#: Words in each of the two generations that a worker keeps, and entries of its transition table; what is over is worked out again.
CACHE_WORDS, CACHE_ARCS = 500_000, 2_000_000
#: Matches of up to so many characters are kept.
KEPT_CHARS = 100
# Fixed value: the pattern that byte-level pre-tokenizers split texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class Automaton:
    """labels: the bytes of each token id; merges: pairs of token ids with the id they make, first merge first."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.size = {t: len(word) for t, word in labels.items()}
        self.first: dict[int, int] = {}  # the left part of a token, whose arcs the token's go beside
        self.copied: dict[int, int] = {}  # the state that a token's state was copied from
        self.born = {t: -1 for t, word in labels.items() if len(word) == 1}  # the gadget that made a token's arcs
        self.taken: dict[int, dict[int, int]] = {}  # arcs taken from a state, and by which gadget
        self._compile(merges)
        self.arcs: dict[int, bool] = {}
        self._tokens_trie()

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        if len(self.born) != 256:
            raise ValueError("a token is needed for each byte")
        for k, (u, v, w) in enumerate(merges):
            if u not in self.born or v not in self.born:
                raise ValueError(f"merge {k} joins a token that no earlier merge makes")
            if w in self.born:
                raise ValueError(f"merge {k} makes a token that there is already")
            self._gadget(k, u, v, w)

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if self.has(u, v, k - 1):
            self.taken.setdefault(u, {})[v] = k
            self.born[w] = k
        else:  # u and v never follow each other, so no arc is added
            self.born[w] = NEVER
        self.first[w], self.copied[w] = u, v

    def removal(self, state: int, arc: int) -> int:
        """The gadget that took an arc from a state or from what it was copied from before; NEVER if none did."""
        until = NEVER
        while True:
            k = self.taken.get(state, {}).get(arc, NEVER)
            if k < until:
                return k
            if state not in self.copied:
                return NEVER
            until, state = min(until, self.born[state]), self.copied[state]

    def has(self, state: int, arc: int, after: int = NEVER - 1) -> bool:
        """Whether an arc leaves a state after that gadget."""
        if state == START:
            return self.born[arc] <= after
        while True:
            if self.removal(state, arc) <= after or self.born[arc] > after:
                return False
            if arc not in self.first:
                return True
            arc, after = self.first[arc], self.born[arc]

    def _tokens_trie(self) -> None:
        """Goto, fail links, and at each node the longest token that ends there and the next shorter one."""
        self.goto: dict[int, int] = {}
        own, fail, nodes = [START], [0], 1
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for t, word in sorted(self.labels.items()):
            if self.born.get(t, NEVER) == NEVER:
                continue
            at = 0
            for depth, b in enumerate(word):
                then = self.goto.get(at << 8 | b)
                if then is None:
                    then = self.goto[at << 8 | b] = nodes
                    nodes += 1
                    own.append(START)
                    fail.append(0)
                    by_length.setdefault(depth, []).append((at, b, then))
                at = then
            own[at] = t
        self.longest, self.shorter, self.fail = own, {}, fail
        for depth in sorted(by_length):
            for at, b, then in by_length[depth]:
                if at:
                    fail[then] = self.step(fail[at], b)
                below = own[fail[then]]
                if own[then] == START:
                    own[then] = below
                else:
                    self.shorter[own[then]] = below

    def step(self, node: int, byte: int) -> int:
        key = node << 8 | byte
        to = self.goto.get(key)
        if to is None:
            to = self.goto[key] = self.step(self.fail[node], byte) if node else 0
        return to

    def encode(self, words: list[bytes]) -> Iterator[array]:
        """The ids of each word. What a word shares with the front of the one before it is not gone over again, so sorted words go fastest."""
        goto, arcs, longest, shorter, size = self.goto, self.arcs, self.longest, self.shorter, self.size
        before, nodes, ends = b"", [0], [START]  # the goto node and the last token of each prefix's path
        for word in words:
            at = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                at += 1
            del nodes[at + 1 :], ends[at + 1 :]
            node, before = nodes[at], word
            for b in word[at:]:
                to = goto.get(node << 8 | b)
                node = self.step(node, b) if to is None else to
                at += 1
                token = longest[node]
                while True:
                    state = ends[at - size[token]]
                    allowed = arcs.get(state << 32 | token)
                    if allowed is None:
                        allowed = self._fill(state, token)
                    if allowed:
                        break
                    token = shorter[token]
                nodes.append(node)
                ends.append(token)
            out = []
            while at:
                token = ends[at]
                out.append(token)
                at -= size[token]
            yield array("I", out[::-1])

    def _fill(self, state: int, token: int) -> bool:
        """Enter a transition into the table."""
        if len(self.arcs) >= CACHE_ARCS:
            self.arcs.clear()
        made = self.arcs[state << 32 | token] = self.has(state, token)
        return made


class Transducer:
    """Texts to ids and back, for a byte-level BPE tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, pre = made["model"], made.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or made.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normaliser is needed")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("plain merges are needed")
        self.added = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made.get("added_tokens", [])):
            raise ValueError("added tokens that take in what stands around them are not supported")
        byte_of = {ord(sign): b for b, sign in byte_signs().items()}
        vocabulary = {token: i for token, i in model["vocab"].items() if token not in self.added}
        labels = {i: bytes(map(byte_of.__getitem__, map(ord, token))) for token, i in vocabulary.items()}
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.automaton = Automaton(labels, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        self.labels = labels | {i: content.encode() for content, i in self.added.items()}
        self.pattern = regex.compile(PATTERN)
        # Of added tokens that begin at one place the longest counts.
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.special = {content: array("I", [i]).tobytes() for content, i in self.added.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        """A space behind anything but white space begins a match, so most texts are cut there and the words' ids kept."""
        if text.startswith(" ") or ACROSS.search(text):
            return self.pattern.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + w for w in rest]]

    def _learn(self, words: set[str]) -> None:
        """Put the ids of new words into the young generation, each match of the pattern on its own."""
        young, old = self.young, self.old
        cut = [(w, self.pattern.findall(w)) for w in words]
        matches = {m for _, parts in cut for m in parts}
        young.update((m, old[m]) for m in matches if m in old)
        fresh = sorted(m for m in matches if m not in young)
        young.update(zip(fresh, (ids.tobytes() for ids in self.automaton.encode([m.encode() for m in fresh]))))
        for word, parts in cut:
            if len(parts) != 1:
                young[word] = b"".join([young[m] for m in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []  # the words of each text; an added token is an item of its own
        for text in texts:
            if self.marks is None or not any(t in text for t in self.added):
                parts.append(self._split(text))
                continue
            words, at = [], 0
            for mark in self.marks.finditer(text):
                words += [*self._split(text[at : mark.start()]), mark[0]]
                at = mark.end()
            parts.append([*words, *self._split(text[at:])])
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        young.update(self.special)
        new = {w for words in parts for w in words if w not in young}
        young.update((w, old[w]) for w in new if w in old)
        self._learn({w for w in new if w not in young})
        out = [b"".join(map(young.__getitem__, words)) for words in parts]
        for word in [w for w in young if len(w) > KEPT_CHARS] if any(len(w) > KEPT_CHARS for w in new) else ():
            del young[word]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of the arcs' labels; bytes that are no UTF-8 become replacement signs."""
        path = array("I")
        path.frombytes(ids)
        return b"".join(map(self.labels.__getitem__, path)).decode("utf-8", "replace")


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each file and Python worker."""
    if path not in _made:
        _made[path] = Transducer(path)
    return _made[path]


def encode(documents: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with keep_ids the ids and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = transducer(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids = made.encode([t or "" for t in part.column(1).to_pylist()])
                rows = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())}
                decoded = [made.decode(x) for x in ids] if keep_ids else map(made.decode, ids)
                rows["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())
                if keep_ids:
                    rows |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), **rows})

    return dealt(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
