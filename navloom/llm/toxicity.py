"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every document is a set of hashed features: its lower-cased words (runs of letters and digits),
its pairs of neighbouring words, and its skip-grams (a word and the next but one). FTRL-proximal
keeps a learning rate for each coordinate and sets weights that do not earn their L1 penalty to
zero, so the model is a short list of (index, weight), bounded by 2**BITS entries.

Defined results: a null or empty text has no feature and gets the score of the intercept.
Repeated rows each get the same result. A null doc_id is never learned from and is not held out.
Without a labelled row of each class every score is (ones + 1) / (rows + 2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.sample import fold, give_back, labelled_sample, lean
from navloom.llm.text import U64, blocks, find_chars, hash_runs, mix, sequence_hash, string_buffer
from navloom.session import ready

BITS = 20
FOLDS = 5


@dataclass(frozen=True)
class ToxicityModel:
    """The weights that are not zero, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed index, document) of each unigram, bigram and skip-gram."""
    chars = find_chars(data, offsets, "alnum")
    h = hash_runs(chars.code, chars.start, chars.end)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(chars.first))
    shift = U64(64 - BITS)
    yield (h >> shift).astype(np.int64), doc
    if len(h) > 1:
        inside = doc[1:] == doc[:-1]
        yield (sequence_hash(h, 2)[inside] >> shift).astype(np.int64), doc[1:][inside]
    if len(h) > 2:
        inside = doc[2:] == doc[:-2]
        skip = mix(h[:-2] * U64(0xD6E8FEB86659FD93) + h[2:])
        yield (skip[inside] >> shift).astype(np.int64), doc[2:][inside]


def feature_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The set of feature indices of each document."""
    key = np.unique(np.concatenate([(doc << BITS) | index for index, doc in _features(data, offsets)]))
    cut = np.searchsorted(key, np.arange(len(offsets), dtype=np.int64) << BITS)
    index = (key & ((1 << BITS) - 1)).astype(np.uint32)
    return [index[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def raw_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of each document's feature set; only features with a weight are made unique."""
    out = []
    for index, doc in _features(data, offsets):
        hit = np.flatnonzero(weights[index])
        out.append((doc[hit] << BITS) | index[hit])
    key = np.unique(np.concatenate(out))
    return np.bincount(key >> BITS, weights[key & ((1 << BITS) - 1)], len(offsets) - 1)


def ftrl(rows: list[np.ndarray], y: np.ndarray, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, ones: float = 1.0) -> ToxicityModel:
    """FTRL-proximal, one row after another (McMahan et al. 2013); a row of label 1 weighs `ones` times a row of label 0."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, seen = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))), 1.0

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -60, 60))) - y[i]
            g *= ones if y[i] else 1.0
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
            seen += g * g
            bias -= 0.05 * g / np.sqrt(seen)
    every = np.flatnonzero(np.abs(z) > l1)
    return ToxicityModel(every.astype(np.uint32), weights(every).astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 12000) -> ToxicityModel:
    """Fit on at most `most_rows` labelled rows outside the held-out fold; the feature sets are made on the executors."""
    sample = labelled_sample(docs, labels, "toxic", most_rows, lambda c: fold(c, FOLDS) != 0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = feature_sets(*string_buffer(block.column(2)))
            yield pa.record_batch([block.column(0), block.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "label", "at"])

    table = sample.mapInArrow(lean(rows), "doc_id long, label int, at binary").toArrow()
    y, order = np.array(table["label"], float), np.argsort(np.array(table["doc_id"], np.int64), kind="stable")
    if not len(y) or not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel(np.zeros(0, np.uint32), np.zeros(0, np.float32), float(np.log(p / (1 - p))))
    sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["at"]]  # views of the table
    model = ftrl([sets[i] for i in order], y[order])
    del table, sets
    give_back()
    return model


def toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """`docs` (any columns, with text) and score, predicted; columns of docs with these names are replaced."""
    spark = ready(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(model)  # at most 2**BITS (index, weight) pairs, 8 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = m.dense()
        for block in blocks(batches, "text"):
            raw = raw_scores(*string_buffer(block.column(block.schema.get_field_index("text"))), weights)
            p = 1 / (1 + np.exp(-np.clip(raw + m.bias, -60, 60)))
            yield pa.record_batch([*block.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*block.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double", "predicted int"])
    return docs.mapInArrow(lean(score), schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out")
    return toxicity(docs, model).select("doc_id", held, "score", "predicted")
