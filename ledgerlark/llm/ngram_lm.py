"""Language-model scoring with a weighted backoff automaton over word n-grams.

The states are the contexts of the training corpus, of ``order - 1`` words at most, the begin of a text among them. A
state has an arc for each word seen after it and a failure arc to the context without its first word; the empty
context has an arc for every word. A text is scored by one traversal from left to right: the state is carried, an arc
that exists gives its weight, else the failure arc's weight is added and the next shorter context is tried.

The model grows with the corpus, so no task holds it. Documents are dealt into blocks of bounded size; a
block sends its distinct n-grams, packed and cut into shards by hash, and a shard adds the counts of all blocks
and answers each with the totals of the very n-grams it sent, in their order. A block then builds the part
of the automaton that its own texts can reach, with exactly the weights of the whole one. A message holds
the n-grams that a block has for a shard, and none is sent for none: there are never more messages than
distinct n-grams of blocks, however many blocks and shards there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import pieces_of, text_of

#: Text of a block, and text whose n-grams are a shard's, at least: what one task holds.
LEAST_BYTES = 12 << 20
#: Text of a message, about. A block has a message for each shard, so their size follows from the input's.
MESSAGE_BYTES = 6000
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Exponents at which shards sum powers of context counts, to fit how fast contexts meet new words.
EXPONENTS = np.linspace(0.0, 1.0, 41)


@dataclass
class Grams:
    """The n-grams of one length of a block's texts; each ends at a token."""

    keys: np.ndarray  # distinct hashes, sorted
    at: np.ndarray  # of each token; -1 where the text has begun too late
    context: np.ndarray  # of each key, the key of the n-gram without the last word; -1 is the begin of a text
    suffix: np.ndarray  # of each key, the key of the n-gram without the first word


@dataclass
class Tokens:
    """The tokens of a block's texts, each text with its end, and their n-grams by length from 1 on."""

    text: np.ndarray  # number of the text of each token
    grams: list[Grams]

    def counts(self, trained: np.ndarray) -> list[np.ndarray]:
        """Training counts of the n-grams, from texts for which ``trained`` holds."""
        use = trained[self.text]
        return [np.bincount(g.at[use & (g.at >= 0)], minlength=len(g.keys)) for g in self.grams]


def tokens(texts: list[str], order: int = 2) -> Tokens:
    parts, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in pieces_of(texts):
        w = flat.words(texts[i:j])
        # the end of each text stands after its words
        after = np.searchsorted(w.text, np.arange(j - i), side="right")
        parts.append(np.insert(w.hashes(), after, END))
        owners.append(np.insert(w.text, after, np.arange(j - i)) + i)
    words, text = np.concatenate(parts), np.concatenate(owners)
    place = np.arange(len(text)) - np.searchsorted(text, text)
    keys, at = np.unique(words, return_inverse=True)
    none = np.zeros(len(keys), np.int64)
    grams, value = [Grams(keys, at, none, none)], words
    for n in range(2, order + 1):
        # of the begin alone there is a context of one
        begin = BEGIN if n == 2 else np.uint64(0)
        before = np.where(place == 0, begin, np.append(begin, value[:-1])[: len(value)])
        whole = place >= n - 2
        value = np.where(whole, flat.mix(before * flat.BASE + words), np.uint64(0))
        keys, kind = np.unique(value[whole], return_inverse=True)
        at = np.full(len(text), -1)
        at[whole] = kind
        shorter = grams[-1].at
        context, suffix = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        context[kind] = np.where(place == 0, -1, np.append(-1, shorter[:-1])[: len(text)])[whole]
        suffix[kind] = shorter[whole]
        grams.append(Grams(keys, at, context, suffix))
    return Tokens(text, grams)


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard of each key, by its high bits, so that sorted keys have sorted shards."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest of them takes."""
    values = values.astype("<u8")
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    whole = np.zeros((n, 8), np.uint8)
    if n:
        whole[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return whole.reshape(-1).view("<u8")


SENT = "block int, shard int, sizes array<int>, keys array<binary>, counts array<binary>, check bigint"
#: For each length of n-grams: tokens, distinct ones, those seen once and twice, and sums of powers of their counts.
TOLD = "array<struct<tokens:bigint,types:bigint,once:bigint,twice:bigint,powers:array<double>>>"


def _schema(ddl: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(),
        "bigint": pa.int64(),
        "array<int>": pa.list_(pa.int32()),
        "array<binary>": pa.list_(pa.binary()),
        TOLD: pa.list_(
            pa.struct([*[(c, pa.int64()) for c in ("tokens", "types", "once", "twice")], ("powers", pa.list_(pa.float64()))])
        ),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split(" ", 1) for column in ddl.split(", "))])


def _check(keys: list[np.ndarray]) -> int:
    """A checksum of n-grams that is that of several messages if combined by exclusive or."""
    return int(np.bitwise_xor.reduce(np.concatenate(keys)).view(np.int64)) if any(map(len, keys)) else 0


def _send(table: pa.Table, n: int, order: int) -> pa.Table:
    """A block's distinct n-grams with its own training counts, a row for each shard that has any."""
    block = table["block"][0].as_py()
    t = tokens(table["text"].to_pylist(), order)
    counts = t.counts(table["trains"].to_numpy(zero_copy_only=False).astype(bool))
    edges = [np.searchsorted(_shards(g.keys, n), np.arange(n + 1)) for g in t.grams]
    rows = []
    for s in np.flatnonzero(np.sum([np.diff(e) for e in edges], axis=0)):
        parts = [slice(e[s], e[s + 1]) for e in edges]
        keys = [g.keys[p] for g, p in zip(t.grams, parts, strict=True)]
        steps = [_packed(np.diff(k, prepend=np.uint64(0))) for k in keys]  # sorted keys as differences
        own = [_packed(c[p]) for c, p in zip(counts, parts, strict=True)]
        rows.append({"block": block, "shard": int(s), "sizes": [len(k) for k in keys], "keys": steps, "counts": own, "check": _check(keys)})
    return pa.Table.from_pylist(rows, _schema(SENT))


ANSWER = f"block int, shard int, sizes array<int>, counts array<binary>, check bigint, told {TOLD}"


def _answer(table: pa.Table) -> pa.Table:
    """The totals of a shard's n-grams for each block that sent them; the shard's statistics go with the first."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    totals, told = [[] for _ in rows], []
    for k in range(len(rows[0]["sizes"])):
        sizes = [r["sizes"][k] for r in rows]
        keys = [np.cumsum(_unpacked(r["keys"][k], n), dtype=np.uint64) for r, n in zip(rows, sizes, strict=True)]
        own = np.concatenate([_unpacked(r["counts"][k], n) for r, n in zip(rows, sizes, strict=True)])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        whole = np.zeros(int(at.max(initial=-1)) + 1, np.uint64)
        np.add.at(whole, at, own)
        seen = whole[whole > 0]
        ends = np.cumsum([0, *sizes])
        for i in range(len(rows)):
            totals[i].append(_packed(whole[at[ends[i] : ends[i + 1]]]))
        powers = [float((seen.astype(np.float64) ** e).sum()) for e in EXPONENTS]
        once, twice = int((seen == 1).sum()), int((seen == 2).sum())
        told.append({"tokens": int(seen.sum()), "types": len(seen), "once": once, "twice": twice, "powers": powers})
    found = [{"block": r["block"], "shard": r["shard"], "sizes": r["sizes"], "counts": c, "check": r["check"]} for r, c in zip(rows, totals, strict=True)]
    found[0]["told"] = told
    return pa.Table.from_pylist(found, _schema(ANSWER))


@dataclass
class Statistics:
    """What is counted over the whole corpus: training tokens, words, and for n-grams from two on discount and exponent."""

    n_tokens: int
    n_words: int
    discounts: list[float]
    exponents: list[float]

    @classmethod
    def of(cls, told: list[dict]) -> Statistics:
        """From the rows of ``totals``."""
        told = sorted(told, key=lambda r: r["k"])
        discounts, exponents = [], []
        for before, own in zip(told, told[1:], strict=False):
            once, twice = own["once"], own["twice"]
            discounts.append(min(max(once / (once + 2.0 * twice), 0.05), 0.95) if once else 0.5)
            # contexts seen c times met about c**e words; e makes these add up to the number of n-grams
            exponents.append(float(np.interp(own["types"], before["powers"], EXPONENTS)))
        return cls(told[0]["tokens"], told[0]["types"], discounts, exponents)


def totals(answers: DataFrame) -> DataFrame:
    """One row: the sums of what all shards told, an array with a struct for each length of n-grams."""
    rows = answers.where("told is not null").select(F.posexplode("told").alias("k", "told"))
    sums = [F.sum(f"told.{c}").alias(c) for c in ("tokens", "types", "once", "twice")]
    powers = F.array(*[F.sum(F.get("told.powers", F.lit(i))) for i in range(len(EXPONENTS))]).alias("powers")
    each = rows.groupBy("k").agg(*sums, powers)
    return each.agg(F.collect_list(F.struct("k", "tokens", "types", "once", "twice", "powers")).alias("known"))


@dataclass
class Automaton:
    """The part of the automaton that some texts reach; all weights are log10 probabilities, by length of the n-gram."""

    known: np.ndarray  # training counts of words
    arcs: list[np.ndarray]  # of the states; minus infinity where a state has no such arc
    failures: list[np.ndarray]  # of the state before each n-gram, from two on; 0 of what is no state

    @classmethod
    def build(cls, t: Tokens, counts: list[np.ndarray], known: Statistics) -> Automaton:
        words = counts[0].astype(np.float64)
        lower = (words + 1.0) / (known.n_tokens + known.n_words + 1.0)
        arcs, failures = [np.log10(lower)], []
        end = int(np.searchsorted(t.grams[0].keys, END))
        for g, c, shorter, discount, exponent in zip(t.grams[1:], counts[1:], counts, known.discounts, known.exponents, strict=False):
            # the begin of a text is a context as often as the end is a token
            context = np.where(g.context < 0, words[end] if end < len(words) else 0.0, shorter[g.context].astype(np.float64))
            state = context > 0
            share = np.where(state, discount * np.maximum(context, 1.0) ** (exponent - 1.0), 1.0)
            less = share * lower[g.suffix]
            lower = np.where(c > 0, (1.0 - share) * c.astype(np.float64) / np.maximum(context, 1.0) + less, less)
            with np.errstate(divide="ignore"):
                arcs.append(np.log10(np.where(c > 0, lower, 0.0)))
            failures.append(np.log10(share))
        return cls(counts[0], arcs, failures)

    def traverse(self, t: Tokens) -> np.ndarray:
        """The weight of each token: the failure arcs' from its longest context down to one that has an arc, and that arc's."""
        weight, open_ = np.zeros(len(t.text)), np.ones(len(t.text), bool)
        for g, arc, failure in zip(t.grams[:0:-1], self.arcs[:0:-1], self.failures[::-1], strict=False):
            here = np.flatnonzero(open_ & (g.at >= 0))
            own = arc[g.at[here]]
            taken = ~np.isneginf(own)
            weight[here] += np.where(taken, own, failure[g.at[here]])
            open_[here[taken]] = False
        return weight + np.where(open_, self.arcs[0][t.grams[0].at], 0.0)


def score(docs: DataFrame, trains: Column, order: int = 2, block_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    The model learns from rows for which ``trains`` (of doc_id) is true; a null counts as false. Tokens are the
    words, A-Z lower-cased, and one end for each text. base_score is the add-one unigram log10 probability;
    score is that of the automaton over n-grams of up to ``order`` words. Every row is scored on its own whole text; null
    text is empty and has the end alone. Repeated rows are learned and scored each; those of different partitions
    of ``docs`` go to different blocks. Without training rows every token has probability one in both. No rows
    give no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", text_of(docs).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    # blocks and shards of this size have messages of MESSAGE_BYTES: it grows with the root of the input
    own = max(LEAST_BYTES, math.isqrt(MESSAGE_BYTES * size))
    n, shards = (max(1, -(-size // (b or own))) for b in (block_bytes, shard_bytes))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def send(table: pa.Table) -> pa.Table:
        return _send(table, shards, order)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        t, m = tokens(table["text"].to_pylist(), order), table.num_rows
        known = Statistics.of(answers["known"][0].as_py())
        own = sorted(answers.select(["shard", "sizes", "counts", "check"]).to_pylist(), key=lambda r: r["shard"])
        sizes = [sum(r["sizes"][k] for r in own) for k in range(order)]
        if sizes != [len(g.keys) for g in t.grams] or reduce(xor, (r["check"] for r in own), 0) != _check([g.keys for g in t.grams]):
            raise ValueError("a block has other texts than when its n-grams were sent")
        counts = [np.concatenate([_unpacked(r["counts"][k], r["sizes"][k]) for r in own]) for k in range(order)]
        model = Automaton.build(t, counts, known)
        word = t.grams[0].at
        columns = [
            table["doc_id"],
            pa.array(~table["trains"].to_numpy(zero_copy_only=False).astype(bool)),
            pa.array(np.bincount(t.text, minlength=m), pa.int64()),
            pa.array(np.bincount(t.text, model.known[word] > 0, m).astype(np.int64)),
            pa.array(np.full(m, known.n_tokens), pa.int64()),
            pa.array(np.bincount(t.text, model.arcs[0][word], m)),
            pa.array(np.bincount(t.text, model.traverse(t), m)),
        ]
        return pa.table(columns, names=names)

    # the totals are added after the answers have travelled, so they don't travel with each
    answers = blocks.groupBy("block").applyInArrow(send, SENT).groupBy("shard").applyInArrow(_answer, ANSWER)
    dealt = answers.drop("told").repartition("block").join(F.broadcast(totals(answers)))
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(finish, schema)
