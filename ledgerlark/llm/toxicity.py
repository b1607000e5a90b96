"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks, trained on sentences.

The kernel of two words sums over common subsequences of three symbols, each weighted by a decay to the
length of its gaps in either word, so a word with inserted or missing characters stays close to the original;
both words have unit length under it. Sentences carry the label of their document, and the sentence is the unit of
training: the first machine sees the sums of a sentence's words, the later ones its most toxic word, as the one before
values it. Only a sentence or two of a toxic document need be toxic; of each the best one counts at least.

A word's value under the machine is a sum over its own subsequences, as the landmarks' parts add up to one
weight per subsequence. Scoring values each distinct word of a batch once, exactly, and is linear in the text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import clear, pieces_of, small_batches, text_of

DECAY = 0.6
#: The two offsets of each kind of subsequence: at most five positions from first to last symbol.
OFFSETS = [(i, j) for i in range(1, 5) for j in range(i + 1, 6)]
BITS = 7
SYMBOLS = 1 << BITS
FEATURES = SYMBOLS**3
#: The weight of a subsequence by how far its last symbol is from the first, from two positions on.
GAPS = np.array([DECAY**g for g in range(4)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(5).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)


def _symbol(code: int) -> int:
    """a-z (either case) are 1-26, other letters 27-127, so that those of one alphabet differ; 0 is no letter."""
    low = chr(code).lower()
    if not low.isalpha():
        return 0
    return ord(low[0]) - 96 if "a" <= low[0] <= "z" else 27 + ord(low[0]) % 101


_TABLE = np.array([_symbol(c) for c in range(0x20000)], np.uint8)
#: What ends a sentence when white space follows.
_STOPS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)


class Spelled:
    """The words of some texts as symbols; each word is followed by a boundary symbol (0).

    A word is a run without white space; what isn't a letter is left out, so that characters put between
    letters don't part them, and a run of single characters is one word. start and length are those of each word
    among ``symbol``, text the number of its text, sentence the number of its sentence among all.
    """

    def __init__(self, texts: list[str]):
        code = [np.frombuffer(t.encode("utf-32-le", "replace") + b"\n\0\0\0", np.uint32) for t in texts]
        ends = np.cumsum([len(c) for c in code], dtype=np.int64)
        code = np.concatenate(code) if code else np.zeros(0, np.uint32)
        space = (code == 32) | ((code >= 9) & (code <= 13))
        text_end = np.zeros(len(code), bool)
        text_end[ends - 1] = True
        before, after = np.roll(space, 1), np.roll(space, -1)
        lone = ~space & before & after
        parted = space & ~(np.roll(lone, 1) & np.roll(lone, -1) & ~text_end)
        symbol = _TABLE[np.minimum(code, len(_TABLE) - 1)]
        at = np.flatnonzero(parted | ((symbol > 0) & ~space))
        mark = parted[at]
        # of several boundaries in a row one stays, and none before the first word
        single = ~(mark & np.concatenate([[True], mark[:-1]])) if len(mark) else mark
        at, mark = at[single], mark[single]
        self.symbol = np.where(mark, 0, symbol[at]).astype(np.uint8)
        edge = np.flatnonzero(mark)
        self.start = np.concatenate([[0], edge[:-1] + 1]).astype(np.int64)[: len(edge)]
        self.length = edge - self.start
        place = at[edge]
        self.text = np.searchsorted(ends, place, side="right")
        stop = np.isin(code[np.maximum(place - 1, 0)], _STOPS) | (code[place] == 10) | (code[place] == 13)
        new = np.concatenate([[False], stop[:-1] | (np.diff(self.text) > 0)])[: len(edge)]
        self.sentence = np.cumsum(new)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A word of each kind, and the kind of each word."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.length + 1
        place = np.arange(len(self.symbol)) - np.repeat(self.start, size)
        power = np.cumprod(np.full(int(size.max()), _BASE))
        hashes = np.add.reduceat(_RANDOM[self.symbol] * power[place], self.start)
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        return first, kind

    def spelling(self, word: int) -> bytes:
        return self.symbol[self.start[word] : self.start[word] + self.length[word]].tobytes()


class Listed(Spelled):
    """Words given by their symbols."""

    def __init__(self, words: list[bytes]):
        self.symbol = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.length + 1) - self.length - 1


def vectors(spelled: Spelled, words: np.ndarray, entries: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """The unit vectors of ``words``, some at a time: the places among ``words`` of those at hand, then of each entry
    the word (counted within those at hand), the subsequence and the weight, in order.

    A boundary stands at both ends of a word. Words of one length are the rows of one matrix, sorted by row.
    """
    for size in np.unique(spelled.length[words]):
        same = np.flatnonzero(spelled.length[words] == size)
        kinds = [(p, q) for p, q in OFFSETS if q < size + 2]
        width = max(sum(int(size) + 2 - q for _, q in kinds), 1)
        for i in range(0, len(same), max(1, entries // width)):
            part = same[i : i + max(1, entries // width)]
            s = np.zeros((len(part), size + 2), np.uint32)
            s[:, 1:-1] = spelled.symbol[spelled.start[words[part]][:, None] + np.arange(size)]
            n = int(size) + 2
            found = [((s[:, : n - q] << BITS | s[:, p : n - q + p]) << BITS | s[:, q:]) << 2 | (q - 2) for p, q in kinds]
            code = np.sort(np.concatenate(found, axis=1), axis=1) if found else np.zeros((len(part), 1), np.uint32)
            key = code >> 2
            begins = np.ones(code.shape, bool)
            begins[:, 1:] = key[:, 1:] != key[:, :-1]
            at = np.flatnonzero(begins)
            weight, row = np.add.reduceat(GAPS[code & 3].ravel(), at), at // code.shape[1]
            norm = np.sqrt(np.bincount(row, weight * weight, len(part)))
            yield part, row, key.ravel()[at], weight / norm[row]


def word_values(spelled: Spelled, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The machine's value of each of ``words``, without bias: the weights of its subsequences."""
    found = np.zeros(len(words))
    for part, row, key, value in vectors(spelled, words):
        found[part] = np.bincount(row, weight[key] * value, len(part))
    return found


class Landmarks:
    """Nyström features: kernels with the landmark words, turned so that their products give the kernel among these."""

    def __init__(self, spelled: Spelled, words: np.ndarray):
        parts = [(key, part[row], value) for part, row, key, value in vectors(spelled, words)]
        key, mark, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        self.keys, slot, self.n = np.unique(key[order], return_inverse=True, return_counts=True)
        self.first, self.mark, self.value = np.cumsum(self.n) - self.n, mark[order], value[order]
        self.basis = np.zeros((len(self.keys), len(words)))
        self.basis[slot, self.mark] = self.value
        kernel, vector = np.linalg.eigh(self.basis.T @ self.basis)
        good = kernel > 1e-6 * kernel.max()
        self.root = vector[:, good] / np.sqrt(kernel[good])

    def features(self, spelled: Spelled, words: np.ndarray) -> np.ndarray:
        m, found = self.basis.shape[1], np.zeros((len(words), self.root.shape[1]), np.float32)
        for part, row, key, value in vectors(spelled, words, 1 << 16):
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            use = self.keys[slot] == key
            row, slot, value = row[use], slot[use], value[use]
            n = self.n[slot]
            entry = np.repeat(np.arange(len(slot)), n)
            at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + self.first[slot][entry]
            kernel = np.bincount(row[entry] * m + self.mark[at], value[entry] * self.value[at], len(part) * m)
            found[part] = kernel.reshape(len(part), m) @ self.root
        return found

    def weights(self, w: np.ndarray) -> np.ndarray:
        """One weight per subsequence of a machine on the features."""
        return self.basis @ (self.root @ w)


class Sentences:
    """Sentences of labelled texts: ``words`` has the kinds of their words, one sentence after the other."""

    def __init__(self, texts: list[str], label: np.ndarray, most: int, random: np.random.Generator):
        kinds: dict[bytes, int] = {}
        runs, sizes, owners = [], [], []
        for i, j in pieces_of(texts):
            spelled = Spelled(texts[i:j])
            first, kind = spelled.distinct()
            ids = np.array([kinds.setdefault(spelled.spelling(w), len(kinds)) for w in first], np.int64)[kind]
            begin = np.flatnonzero(np.diff(spelled.sentence, prepend=-1))
            size, text = np.diff(np.append(begin, len(ids))), spelled.text[begin]
            # of a text with more sentences a random choice
            rank = np.empty(len(begin), np.int64)
            order = np.lexsort((random.random(len(begin)), text))
            rank[order] = np.arange(len(begin)) - np.searchsorted(text, text)
            keep = rank < most
            runs.append(ids[np.repeat(keep, size)])
            sizes.append(size[keep])
            owners.append(text[keep] + i)
        self.spelled = Listed(list(kinds))
        self.words, self.size, self.owner = (np.concatenate(x) for x in (runs, sizes, owners))
        self.start = np.cumsum(self.size) - self.size
        self.toxic = label[self.owner] == 1

    def documents_with(self, toxic: bool, label: np.ndarray) -> np.ndarray:
        """In how many texts of a class each kind of word stands."""
        n = len(self.spelled.start)
        pairs = np.unique(np.repeat(self.owner, self.size) * n + self.words)
        return np.bincount(pairs[(label[pairs // n] == 1) == toxic] % n, minlength=n)

    def sums(self, which: np.ndarray, marks: Landmarks) -> np.ndarray:
        """The features of whole sentences: the sums of their words', over the root of the number of words."""
        found = []
        for i in range(0, len(which), 500):
            part = which[i : i + 500]
            words = np.concatenate([self.words[self.start[s] : self.start[s] + self.size[s]] for s in part])
            kinds, at = np.unique(words, return_inverse=True)
            size = self.size[part]
            total = np.add.reduceat(marks.features(self.spelled, kinds)[at], np.cumsum(size) - size)
            found.append(total / np.sqrt(size)[:, None])
        return np.concatenate(found)

    def best(self, value: np.ndarray) -> np.ndarray:
        """The kind of each sentence's most toxic word, by the ``value`` of each kind."""
        sentence = np.repeat(np.arange(len(self.size)), self.size)
        return self.words[np.lexsort((value[self.words], sentence))[np.cumsum(self.size) - 1]]


def fit(
    texts: list[str],
    label: np.ndarray,
    n_landmarks: int = 500,
    rounds: int = 4,
    max_sentences: int = 40,
    first_sentences: int = 8000,
    hard: int = 6000,
    plain: int = 3000,
) -> dict:
    """The model of labelled texts of both classes.

    Of each text at most ``max_sentences`` sentences are used, by a random choice. The landmarks are the words
    that most favour toxic texts, by the excess of the texts that have them over its expectation in standard
    deviations, and as many random words. The first machine is fitted on at most ``first_sentences`` sentences of
    each class as sums of words. Each of ``rounds`` later ones is fitted on words: of every toxic text the most toxic
    word of its best sentence, and of all its sentences that the machine before took for toxic, with one symbol put in, too;
    of the clean sentences the ``hard`` most toxic words and ``plain`` random ones. Texts without any words give a
    model that takes nothing for toxic.
    """
    random = np.random.default_rng(11)
    found = {"keys": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -1.0}
    s = Sentences(texts, label, max_sentences, random)
    if s.toxic.any() and not s.toxic.all():
        found |= _trained(s, label, random, n_landmarks, rounds, first_sentences, hard, plain)
    weight = _dense(found["keys"], found["weights"])
    seen = [text_features(texts[i:j], weight, found["bias"]) for i, j in pieces_of(texts)]
    found["combine"] = linear.fit_rising(np.concatenate(seen), label, RISING)
    return found


def _trained(
    s: Sentences, label: np.ndarray, random: np.random.Generator, n_landmarks: int, rounds: int, first_sentences: int, hard: int, plain: int
) -> dict:
    has, clean = s.documents_with(True, label), s.documents_with(False, label)
    kinds = s.spelled
    expected = (has + clean) * label.mean()
    ranked = np.argsort(-(has - expected) / np.sqrt(expected + 1.0), kind="stable")
    some = np.concatenate([ranked[: n_landmarks // 2], random.permutation(len(has))[: n_landmarks // 2]])
    marks = Landmarks(kinds, np.unique(some))
    toxic, other = np.flatnonzero(s.toxic), np.flatnonzero(~s.toxic)
    rows = np.concatenate([random.permutation(x)[:first_sentences] for x in (toxic, other)])
    machine = _machine(s.sums(rows, marks), np.where(s.toxic[rows], 1.0, -1.0), np.full(len(rows), 0.5), 5)
    everywhere = np.flatnonzero(clean)
    for k in range(rounds):
        value = word_values(kinds, np.arange(len(has)), _dense(marks.keys, marks.weights(machine[:-1]))) + machine[-1]
        best = s.best(value)
        order = np.lexsort((-value[best[toxic]], s.owner[toxic]))
        chosen = toxic[order[np.unique(s.owner[toxic][order], return_index=True)[1]]]
        if k:
            chosen = np.union1d(chosen, toxic[value[best[toxic]] > 0])
        positive = np.unique(best[chosen])
        held, times = np.unique(best[other], return_counts=True)
        near = np.argsort(-value[held], kind="stable")[:hard]
        often = np.zeros(len(has))
        often[held] = times
        negative = np.union1d(held[near], random.permutation(everywhere)[:plain])
        # a word on both sides is clean by the number of clean sentences that it is the best of
        stretched = Listed([_stretched(kinds.spelling(w), random) for w in positive])
        rows = np.concatenate(
            [marks.features(kinds, positive), marks.features(stretched, np.arange(len(positive))), marks.features(kinds, negative)]
        )
        sign = np.repeat([1.0, 1.0, -1.0], [len(positive), len(positive), len(negative)])
        cost = np.concatenate([np.repeat([20.0, 5.0], len(positive)), np.clip(2.0 * often[negative], 2.0, 20.0)])
        machine = _machine(rows, sign, cost, 12)
    return {"keys": marks.keys.astype(np.int64), "weights": marks.weights(machine[:-1]), "bias": float(machine[-1])}


def _machine(rows: np.ndarray, sign: np.ndarray, cost: np.ndarray, epochs: int) -> np.ndarray:
    index = np.arange(rows.shape[1])
    return linear.fit_hinge([(index, r.astype(float)) for r in rows], sign, rows.shape[1], cost, epochs=epochs)


def _dense(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    table = np.zeros(FEATURES, np.float32)
    table[keys] = weights
    return table


def _stretched(word: bytes, random: np.random.Generator) -> bytes:
    """The word with one letter put in between its symbols."""
    at = int(random.integers(1, len(word))) if len(word) > 1 else len(word)
    return word[:at] + bytes([int(random.integers(1, 27))]) + word[at:]


#: How many of the text features never lower a score.
RISING = 5


def text_features(texts: list[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """How toxic each text's words and sentences are: the largest value of a word, the mean of the three largest, that of
    the three most toxic sentences, how many sentences are toxic, and how many for the words there are; the number of words.
    A text without words has the values of clean words."""
    spelled = Spelled(texts)
    first, kind = spelled.distinct()
    value = (word_values(spelled, first, weight) + bias)[kind]
    n = len(texts)
    begin = np.flatnonzero(np.diff(spelled.sentence, prepend=-1))
    sentence = np.maximum.reduceat(value, begin) if len(begin) else np.zeros(0)
    owner = spelled.text[begin]
    words, sentences = _largest(value, spelled.text, n), _largest(sentence, owner, n)
    toxic, total = np.bincount(owner[sentence > 0], minlength=n), np.bincount(spelled.text, minlength=n)
    rate = np.log1p(300.0 * toxic / (total + 30.0))
    return np.column_stack([words[0], words.mean(0), sentences.mean(0), np.log1p(toxic), rate, np.log1p(total) / 4])


def _largest(value: np.ndarray, owner: np.ndarray, n: int, k: int = 3) -> np.ndarray:
    """The k largest values of each of n owners; -1 at least, and where there are fewer."""
    order = np.lexsort((-value, owner))
    owner, value = owner[order], value[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    found = np.full((k, n), -1.0)
    for j in range(k):
        found[j, owner[rank == j]] = np.maximum(value[rank == j], -1.0)
    return found


def text_scores(texts: list[str], model: dict) -> np.ndarray:
    """The probability that each text is toxic."""
    weight, w = _dense(model["keys"], model["weights"]), model["combine"]
    found = [text_features(texts[i:j], weight, model["bias"]) @ w[:-1] + w[-1] for i, j in pieces_of(texts)]
    return linear.probability(np.concatenate(found) if found else np.zeros(0), 1.0, 0.0)


def train(
    docs: DataFrame, labels: DataFrame, trains: Column, max_toxic: int = 2000, max_clean: int = 4000, **how
) -> dict | None:
    """Fit on at most so many labelled rows of each class for which ``trains`` (of doc_id) holds.

    The samples are those with the least hashes of doc_id; they are bounded, so they are broadcast to the
    documents and fitted in one task. ``how`` goes to ``fit``. None if a class is absent.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        model = fit(list(rows["text"]), rows["label"].to_numpy(), **how) if rows["label"].nunique() == 2 else None
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & trains)
    once = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    some = [once.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    picked = F.broadcast(some[0].unionByName(some[1]))
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(picked, "doc_id").dropDuplicates(["doc_id"])
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "model binary").first()
    return pickle.loads(found.model) if found else None


def toxicity_scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` (text and any others) with score, the probability of label 1, and predicted (1 from 0.5 on).

    Scores depend on the whole text alone; null text is empty, and the empty text has a score like any other.
    Without a model (no labelled rows of both classes) every score is 0. Columns of docs that are
    named as a result are replaced. No rows give no rows.
    """
    docs = clear(docs, "score", "predicted")
    width = len(docs.columns)
    schema = docs.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            score = text_scores(texts, model) if model else np.zeros(len(texts))
            columns = [batch.column(i) for i in range(width)]
            columns += [pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
