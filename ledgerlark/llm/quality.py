"""Quality classifier: Naive Bayes support vectors on n-gram indicators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat, linear
from .common import clear, pieces_of, small_batches, text_of

BITS = 17
SIZE = 1 << BITS


def indicators(texts: list[str]) -> Iterator[np.ndarray]:
    """The hashed n-grams that occur in each text.

    n-grams of bytes (1 to 4) see spelling and symbols; n-grams of word shapes (1 to 3) see shouting, markup and
    repetition: a shape holds which kinds of characters a word has, and whether it repeats one of the
    two words before it.
    """
    w = flat.words(texts)
    kinds = np.zeros(256, np.uint8)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 1, 2, 4, 1
    kinds[33:48], kinds[58:65], kinds[91:97], kinds[123:127] = 8, 16, 16, 32
    kinds[[44, 46]] = 64
    shape = np.zeros(0, np.uint64)
    if len(w.start):
        at, first = w.inner
        shape = np.bitwise_or.reduceat(kinds[w.raw[at]], first).astype(np.uint64)
        h = w.hashes()
        for back in (1, 2):
            same = np.zeros(len(h), np.uint64)
            same[back:] = (h[back:] == h[:-back]) & (w.text[back:] == w.text[:-back])
            shape |= same << np.uint64(7 + back)
    word_at = np.searchsorted(w.text, np.arange(len(texts) + 1))
    data = flat.LOWERED[w.raw].astype(np.uint64)
    for i in range(len(texts)):
        seen = np.zeros(SIZE, bool)
        seen[0] = True  # every text has the empty n-gram
        part, own = data[w.text_at[i] : w.text_at[i + 1]], shape[word_at[i] : word_at[i + 1]]
        for salt, values, most in ((1, part, 4), (5, own, 3)):
            gram = np.zeros(len(values), np.uint64)
            for n in range(min(most, len(values))):
                gram = gram[: len(values) - n] * np.uint64(2048) + values[n:] + np.uint64(1)
                seen[(gram * flat.BASE + np.uint64((salt + n) << 48)) >> np.uint64(64 - BITS)] = True
        yield np.flatnonzero(seen).astype(np.int32)


def fit(grams: list[np.ndarray], label: np.ndarray, cost: float = 1.0) -> dict:
    """The model of rows of n-grams: weights per n-gram (ratio times hinge weight), bias and logistic curve."""
    counts = np.ones((2, SIZE))
    for g, y in zip(grams, label, strict=True):
        counts[y][g] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = []
    for g in grams:
        v = ratio[g]
        rows.append((g, v / max(np.linalg.norm(v), 1e-9)))
    share = np.array([(label == 0).mean(), (label == 1).mean()])
    weight = linear.fit_hinge(rows, np.where(label == 1, 1.0, -1.0), SIZE, cost / np.maximum(2 * share[label], 1e-3))
    margin = np.array([weight[g] @ v + weight[-1] for g, v in rows])
    a, b = linear.platt(margin, label)
    return {"ratio": ratio.astype(np.float32), "weight": weight.astype(np.float32), "curve": (a, b)}


def margins(grams: Iterator[np.ndarray], model: dict) -> list[float]:
    ratio, weight, found = model["ratio"], model["weight"], []
    for g in grams:
        v = ratio[g]
        found.append(float(weight[g] @ v) / max(float(np.linalg.norm(v)), 1e-9) + float(weight[-1]))
    return found


def sample_labels(labels: DataFrame, column: str, trains: Column, max_rows: int) -> DataFrame:
    """At most ``max_rows`` training rows (doc_id, label 0 or 1), those with the least hashes of doc_id.

    A doc_id that repeats counts once, with its larger label; rows without a doc_id or label don't count.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & trains)
    once = usable.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, trains: Column, max_rows: int = 6000) -> dict | None:
    """Fit on at most ``max_rows`` labelled rows for which ``trains`` (of doc_id) holds; None if a class is absent.

    The sample is bounded, so it is broadcast to the documents and fitted in one task.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            grams = pa.array([g for i, j in pieces_of(texts) for g in indicators(texts[i:j])], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], grams], ["doc_id", "label", "grams"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        model = fit(list(rows["grams"]), rows["label"].to_numpy()) if rows["label"].nunique() == 2 else None
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    small_batches(docs.sparkSession)
    picked = F.broadcast(sample_labels(labels, "quality", trains, max_rows))
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(picked, "doc_id").select("doc_id", "label", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(gather, f"doc_id {kind}, label int, grams array<int>").dropDuplicates(["doc_id"])
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "model binary").first()
    return pickle.loads(found.model) if found else None


def quality_scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` (text and any others) with score, the probability of label 1, and predicted (1 from 0.5 on).

    Scores depend on the whole text alone; null text is empty, and the empty text has a score like any other.
    Without a model (no labelled rows of both classes) every score is 0.5. Columns of docs that are
    named as a result are replaced. No rows give no rows.
    """
    docs = clear(docs, "score", "predicted")
    width = len(docs.columns)
    schema = docs.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            score = np.full(len(texts), 0.5)
            if model:
                grams = (g for i, j in pieces_of(texts) for g in indicators(texts[i:j]))
                score = linear.probability(np.array(margins(grams, model)), *model["curve"])
            columns = [batch.column(i) for i in range(width)]
            columns += [pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
