"""Toxicity by multiple-instance learning: sentence scores joined by a leaky noisy-or."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled documents to train on, at most about so many (by hash of their ids), and words in the model.
TRAIN_DOCUMENTS, MAX_FEATURES = 20_000, 2_000
# A word is a feature if its share among toxic and other documents differs by so many standard errors.
MIN_Z, MIN_DOCUMENTS = 5.0, 3
STEPS, RATE, SHRINK = 300, 0.1, 1e-4
PREDICT_AT = 0.7

_ENDS = re.compile(rb"[.!?\n]+")
# ASCII letters and digits in lower case, bytes of other characters as they are, all else blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_in(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class SentenceModel:
    """Log odds that a sentence is toxic: bias plus the weights of its feature words. ``leak`` is the
    probability of a toxic label without any offending sentence."""

    weights: dict[bytes, float]
    bias: float
    leak: float

    def sentence(self, text: bytes) -> float | None:
        """Score of a sentence, or None if it has no feature word and so no evidence."""
        found = set(words_in(text)) & self.weights.keys()
        if not found:
            return None
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[w] for w in found)))))

    def document(self, text: bytes) -> tuple[float, list[tuple[str, float]]]:
        """Noisy-or over the sentences, and those that score 0.5 or more."""
        clean, offending = 1 - self.leak, []
        if not self.weights.keys().isdisjoint(words_in(text)):
            for part in _ENDS.split(text):
                p = self.sentence(part)
                if p is not None:
                    clean *= 1 - p
                    if p >= 0.5:
                        offending.append((part.strip().decode("utf-8", "replace"), p))
        return 1 - clean, offending


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = told.count()
    if n > bound:
        told = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    # About ``bound`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(told), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _word_shares(rows: DataFrame) -> DataFrame:
    """word, toxic (number of toxic documents with it), clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text, y in zip(batch.column(0), batch.column(1)):
                for w in set(words_in((text.as_py() or "").encode())):
                    seen.setdefault(w, [0, 0])[y.as_py() == 0] += 1
            counts = [pa.array([c[k] for c in seen.values()], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), *counts], names=["word", "toxic", "clean"])

    parts = rows.mapInArrow(run, "word binary, toxic bigint, clean bigint")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _bags(rows: DataFrame, features: list[bytes]) -> DataFrame:
    """toxic, sentences: the features of each sentence that has any, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(features)}
        for batch in batches:
            bags = []
            for text in batch.column(0):
                sentences = ({number[w] for w in words_in(s) if w in number} for s in _ENDS.split((text.as_py() or "").encode()))
                bags.append([sorted(s) for s in sentences if s])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["toxic", "sentences"])

    return rows.mapInArrow(run, "toxic int, sentences array<array<int>>")


def _fit(labels: np.ndarray, bags: list[list[list[int]]], features: list[bytes]) -> SentenceModel:
    """Maximum likelihood of the documents' labels under the noisy-or, by Adam on all parameters."""
    bag = np.array([i for i, b in enumerate(bags) for _ in b], np.int64)
    row = np.array([i for i, s in enumerate(s for b in bags for s in b) for _ in s], np.int64)
    col = np.array([w for b in bags for s in b for w in s], np.int64)
    theta = np.concatenate([np.full(len(features), 1.0), [-2.0, -3.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    positive = labels == 1
    for t in range(1, STEPS + 1):
        z = np.bincount(row, theta[col], len(bag)) + theta[-2]
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + np.exp(-theta[-1]))
        log_clean = np.log1p(-leak) - np.bincount(bag, np.logaddexp(0, z), len(labels))
        clean = np.exp(log_clean)
        # Slope of the loss by the log odds of each cause: p for a clean document, else -p clean / toxic.
        pull = np.where(positive, -clean / np.maximum(1 - clean, 1e-12), 1.0)
        by_z = pull[bag] * p
        grad = np.concatenate([np.bincount(col, by_z[row], len(features)), [by_z.sum()], [(pull * leak).sum()]])
        grad = grad / max(len(labels), 1) + SHRINK * np.concatenate([theta[:-2], [0, 0]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = dict(zip(features, theta[:-2].tolist()))
    return SentenceModel(weights, float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCUMENTS) -> SentenceModel:
    """Model from the labels of documents that are not held out. Feature words are those whose document
    shares differ clearly between the labels, counted in the tasks; what reaches the driver is bounded by
    ``bound`` documents and MAX_FEATURES words. Without labels of both kinds there is no feature and the
    leak is the share of toxic labels (0.5 without any)."""
    rows = _training_rows(docs, labels, bound)
    sums = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    n, n_toxic = sums[0], sums[1] or 0
    if n_toxic in (0, n):
        return SentenceModel({}, 0.0, n_toxic / n if n else 0.5)
    p, q = F.col("toxic") / n_toxic, F.col("clean") / (n - n_toxic)
    mean = (F.col("toxic") + F.col("clean")) / n
    z = (p - q) / F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-9)) * (1 / n_toxic + 1 / (n - n_toxic)))
    known = _word_shares(rows).where(F.col("toxic") + F.col("clean") >= MIN_DOCUMENTS).withColumn("z", z)
    strong = known.where(F.abs("z") >= MIN_Z).orderBy(F.desc(F.abs("z")), "word").limit(MAX_FEATURES).collect()
    features = [bytes(r["word"]) for r in strong]
    table = _bags(rows, features).toArrow()
    return _fit(table["toxic"].to_numpy(), table["sentences"].to_pylist(), features)


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (sentences with a score of 0.5 or more, as text and score) for each
    row of ``docs`` (doc_id, text), trained on ``labels`` (doc_id, toxic).

    The score of a whole text is the noisy-or of its sentences' scores and a leak. Only words of the text
    are inputs. Null and empty texts score the leak. Repeated rows and null ids get a row each; an id with several labels
    is toxic if one is. An empty table gives no rows."""
    model = train(docs, labels, bound)
    kind = docs.schema["doc_id"].dataType.simpleString()
    offence = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [model.document((t.as_py() or "").encode()) for t in batch.column(1)]
            score = pa.array([s for s, _ in told], pa.float64())
            found = pa.array([[{"sentence": x, "score": p} for x, p in o] for _, o in told], offence)
            yield pa.RecordBatch.from_arrays([batch.column(0), score, found], names=["doc_id", "score", "offending"])

    schema = f"doc_id {kind}, score double, offending array<struct<sentence:string,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
        "offending",
    )
