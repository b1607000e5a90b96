"""Byte-level BPE encoding and decoding by segment trees.

A rank file lists byte strings; a string's rank is its id and says how early it is merged. A text is cut by a pattern and
each match is merged on its own: over the byte positions of a match stands a segment tree whose leaves hold the rank of
the pair that begins there, packed above the position, so that the root is the leftmost pair of least rank. A merge
renews three leaves (the pair, its right half, and the pair before it) and their paths to the root.

Short matches are merged together, a row of a matrix for each tree; a longer one has a tree of its own, so a match of n
bytes takes n logarithmic steps however long it is. The rank file is read by the driver alone and travels with the tasks.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, pieces_of, small_batches

#: Bytes of the matches that share a matrix; a row of the next power of two for each.
CLASSES = (8, 16, 32, 64)
#: Matches that a worker keeps with their ids, the first it meets; the others are merged anew in each batch.
KEPT = 300_000
#: Matches of a text that are held at once.
HELD = 1 << 19
NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, checked, read by the driver."""
    with open(path, "rb") as f:
        data = f.read()
    parse(data)
    return data


def parse(data: bytes) -> list[bytes]:
    """The byte string of each id. All 256 single bytes must be among them, and ids must be 0, 1, 2 and so on."""
    found = {}
    for line in data.splitlines():
        if line.strip():
            text, _, rank = line.partition(b" ")
            found[int(rank)] = base64.b64decode(text)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ids must be 0 to n - 1, each once")
    strings = [found[i] for i in range(len(found))]
    if not {bytes([b]) for b in range(256)} <= set(strings):
        raise ValueError("a single byte has no rank")
    return strings


class Merger:
    """The merges of a rank file."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.ids = {s: i for i, s in enumerate(strings)}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.n = np.int64(len(strings))
        self.pairs: dict[int, int] = {}
        for s, rank in self.ids.items():
            for cut in range(1, len(s)):
                left, right = self.ids.get(s[:cut]), self.ids.get(s[cut:])
                if left is not None and right is not None:
                    self.pairs[left * len(strings) + right] = rank
        self._hashed()

    def _hashed(self) -> None:
        """The pairs again, by open addressing, for lookups of whole arrays."""
        self.bits = max(4, (4 * len(self.pairs)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int64)
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        ranks = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        at = self._slot(keys)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self.slots[at[first]] < 0]
            self.slots[at[first]], self.ranks[at[first]] = keys[first], ranks[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 of one that doesn't merge; a negative id is none."""
        keys = left * self.n + right
        at, found = self._slot(keys), np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            held = self.slots[at[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[(held >= 0) & ~hit]
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
        return found

    def merge_many(self, words: list[bytes], size: int) -> list[bytes]:
        """Packed ids of words of at most ``size`` bytes, a power of two; a segment tree a row."""
        rows, shift = np.arange(len(words)), np.int64(size.bit_length())
        length = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(len(words), size)
        place = np.arange(size)
        inside = place < length[:, None]
        # one column more on either side stands for no neighbour
        ids = np.full((len(words), size + 2), -1, np.int64)
        ids[:, 1 : size + 1] = np.where(inside, self.single[raw], -1)
        after = np.tile(np.arange(1, size + 3), (len(words), 1))
        before = np.tile(np.arange(-1, size + 1), (len(words), 1))
        pair = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), size + 1)[:, 1:]
        tree = np.full((len(words), 2 * size), NONE)
        tree[:, size:] = np.where(pair >= 0, (pair << shift) | place, NONE)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        open_ = rows[tree[:, 1] < NONE]
        while len(open_):
            least = tree[open_, 1]
            here, merged = (least & ((1 << int(shift)) - 1)) + 1, least >> shift
            gone = after[open_, here]
            last, first = after[open_, gone], before[open_, here]
            ids[open_, here], ids[open_, gone] = merged, -1
            after[open_, here], before[open_, last] = last, here
            new = self.rank(merged, ids[open_, last])
            old = self.rank(np.where(first > 0, ids[open_, np.maximum(first, 0)], -1), merged)
            tree[open_, size + gone - 1] = NONE
            tree[open_, size + here - 1] = np.where(new >= 0, (new << shift) | (here - 1), NONE)
            some = first > 0
            tree[open_[some], size + first[some] - 1] = np.where(old[some] >= 0, (old[some] << shift) | (first[some] - 1), NONE)
            nodes = np.stack([size + gone - 1, size + here - 1, size + np.where(some, first, here) - 1])
            while nodes[0, 0] > 1:
                nodes //= 2
                tree[open_, nodes] = np.minimum(tree[open_, 2 * nodes], tree[open_, 2 * nodes + 1])
            open_ = open_[tree[open_, 1] < NONE]
        kept = ids[:, 1:-1]
        packed = kept[kept >= 0].astype("<u4").tobytes()
        ends = np.cumsum((kept >= 0).sum(axis=1)) * 4
        return [packed[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if words else []

    def merge_long(self, word: bytes) -> bytes:
        """Packed ids of one word of any length."""
        n, size = len(word), 1 << max(1, (len(word) - 1).bit_length())
        shift = size.bit_length()
        ids = self.single[np.frombuffer(word, np.uint8)]
        leaves = np.full(2 * size, NONE)
        pair = self.rank(ids[:-1], ids[1:])
        leaves[size : size + n - 1] = np.where(pair >= 0, (pair << np.int64(shift)) | np.arange(n - 1), NONE)
        level = size
        while level > 1:
            level //= 2
            leaves[level : 2 * level] = np.minimum(leaves[2 * level : 4 * level : 2], leaves[2 * level + 1 : 4 * level : 2])
        tree, ids = array("q", leaves.tobytes()), array("q", ids.tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        none, place, pairs, width = int(NONE), (1 << shift) - 1, self.pairs, len(self.strings)

        def put(leaf: int, value: int) -> None:
            node = size + leaf
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                value = other if other < value else value
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        while (least := tree[1]) != none:
            here, merged = least & place, least >> shift
            gone = after[here]
            last, first = after[gone], before[here]
            ids[here], ids[gone], after[here] = merged, -1, last
            put(gone, none)
            new = -1
            if last < n:
                before[last] = here
                new = pairs.get(merged * width + ids[last], -1)
            put(here, new << shift | here if new >= 0 else none)
            if first >= 0:
                old = pairs.get(ids[first] * width + merged, -1)
                put(first, old << shift | first if old >= 0 else none)
        kept = np.frombuffer(ids, np.int64)
        return kept[kept >= 0].astype("<u4").tobytes()

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of each word: its own id where the word has one, else those of its merges."""
        found: dict[str, bytes] = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            coded = w.encode()
            if (whole := self.ids.get(coded)) is not None:
                found[w] = whole.to_bytes(4, "little")
            elif len(coded) > CLASSES[-1]:
                found[w] = self.merge_long(coded)
            else:
                by_size.setdefault(next(c for c in CLASSES if c >= len(coded)), []).append((w, coded))
        for size, many in by_size.items():
            for i in range(0, len(many), 1 << 15):
                part = many[i : i + (1 << 15)]
                found.update(zip((w for w, _ in part), self.merge_many([c for _, c in part], size), strict=True))
        return found


@lru_cache(maxsize=2)
def merger(data: bytes) -> Merger:
    return Merger(parse(data))


@lru_cache(maxsize=2)
def _kept(data: bytes, pattern: str) -> dict[str, bytes]:
    return {}


def encode_texts(data: bytes, pattern: str, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    made, kept, cut = merger(data), _kept(data, pattern), regex.compile(pattern)

    def coded(lists: list[list[str]]) -> list[bytes]:
        own = made.encode_words(set().union(*lists).difference(kept))
        kept.update(own)
        packed = [b"".join(map(kept.__getitem__, words)) for words in lists]
        if len(kept) > KEPT:
            for w in own:
                del kept[w]
        return packed

    found: list[bytes] = []
    for i, j in pieces_of(texts):
        if j - i == 1 and len(texts[i]) > HELD:
            words = (m.group() for m in cut.finditer(texts[i]))
            found.append(b"".join(coded([part])[0] for part in iter(lambda: list(islice(words, HELD)), [])))
        else:
            found += coded([cut.findall(t) for t in texts[i:j]])
    return found


def decode_ids(data: bytes, packed: list[bytes]) -> list[bytes]:
    """The bytes that packed ids stand for."""
    table = merger(data).strings
    return [b"".join(map(table.__getitem__, np.frombuffer(p, "<u4").tolist())) for p in packed]


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``docs`` (text and any others) with ids, n_tokens and decoded.

    ids are packed as little-endian unsigned 32-bit numbers, the layout of token files; decoded holds the bytes that they
    give back, which need not be UTF-8 in parts but are the text's as a whole. Every match of ``pattern`` is coded on its
    own; special tokens are ordinary text. Null text is empty and has no ids. Texts and matches of any length are
    coded whole. Repeated rows are coded each. Columns of docs named as a result are replaced; no rows give none.
    """
    docs = clear(docs, "ids", "n_tokens", "decoded")
    names = docs.columns
    added = [F.lit(b"").alias("ids"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(b"").alias("decoded")]
    schema, at = docs.select("*", *added).schema, names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encode_texts(ranks, pattern, [t or "" for t in batch.column(at).to_pylist()])
            columns = [batch.column(i) for i in range(len(names))]
            columns += [
                pa.array(ids, pa.binary()),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array(decode_ids(ranks, ids), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small_batches(docs.sparkSession, 256)
    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, ranks: bytes, column: str = "ids") -> DataFrame:
    """``coded`` with decoded: the bytes of the packed ids in ``column``; null ids give none."""
    coded = clear(coded, "decoded")
    names, schema = coded.columns, coded.select("*", F.lit(b"").alias("decoded")).schema
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            texts = decode_ids(ranks, [p or b"" for p in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], schema.names)

    small_batches(coded.sparkSession, 256)
    return coded.mapInArrow(run, schema)
