"""Quality rules: base counters, and a calibrated n-gram classifier that gives the verdict.

Method: logistic regression over hashed word and character n-grams, fitted on labelled quality
rows, its probability calibrated on rows that were not fitted (Platt scaling), scored in Arrow
batches against a fixed threshold.

Defined results: a null or empty text has no words, all counters 0, base_failed true and kept
false. Repeated rows each get the same result. An empty table gives an empty result. Without a
labelled row of each class the classifier is a constant, (ones + 1) / (rows + 2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from navloom.llm.sample import fold, give_back, labelled_sample, lean
from navloom.llm.text import IS_SEPARATOR, U64, Words, blocks, code_points, find_words, hash_words, mix, run_sums, sequence_hash, string_buffer
from navloom.session import ready

BITS = 18
# The symbols that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_NEWLINE = np.zeros(256, bool)
_IS_NEWLINE[10] = True


@dataclass(frozen=True)
class QualityModel:
    """score(x) = scale * (bias + w . x) + shift, through the logistic function."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw + self.bias) + self.shift, -60, 60)))


def _ngrams(data: np.ndarray, offsets: np.ndarray, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: hashed index, whether the n-gram lies within one document, first of each document."""
    h = hash_words(words)
    doc = words.doc
    shift = U64(64 - BITS)
    yield (h >> shift).astype(np.int32), np.ones(len(h), bool), words.first
    pair = np.zeros(len(h), U64)
    inside = np.zeros(len(h), bool)
    if len(h) > 1:
        pair[:-1] = sequence_hash(h, 2)
        inside[:-1] = doc[1:] == doc[:-1]
    yield (pair >> shift).astype(np.int32), inside, words.first
    code, first = code_points(data, offsets)
    whose = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    g = code.astype(np.uint32) * np.uint32(0x85EBCA6B)
    for n in (1, 2, 3):
        if n > 1:
            g = g * np.uint32(0x9E3779B1)
            g[: len(g) - n + 1] += code[n - 1 :] * np.uint32(0x85EBCA6B)
        inside = np.zeros(len(code), bool)
        if len(code) >= n:
            inside[: len(code) - n + 1] = whose[n - 1 :] == whose[: len(code) - n + 1]
        m = (g ^ (g >> np.uint32(15))) * (np.uint32(0x2C1B3C6D) + np.uint32(2 * n))
        yield (m >> np.uint32(32 - BITS)).astype(np.int32), inside, first


def raw_scores(data: np.ndarray, offsets: np.ndarray, words: Words, weights: np.ndarray) -> np.ndarray:
    """For each document the sum over kinds of n-gram of the mean weight."""
    out = np.zeros(len(offsets) - 1)
    for index, inside, first in _ngrams(data, offsets, words):
        got = weights[index]
        got[~inside] = 0
        out += run_sums(got, first) / np.maximum(run_sums(inside, first), 1)
    return out


def features(data: np.ndarray, offsets: np.ndarray, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each document: each n-gram counts 1 / (n-grams of its kind in the document)."""
    keys, values = [], []
    for index, inside, first in _ngrams(data, offsets, words):
        n = np.maximum(run_sums(inside, first), 1)
        whose = np.repeat(np.arange(len(first) - 1), np.diff(first))
        keys.append((whose[inside].astype(np.int64) << BITS) | index[inside])
        values.append((1 / n)[whose[inside]])
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(at, np.concatenate(values), len(key))
    cut = np.searchsorted(key, np.arange(len(offsets), dtype=np.int64) << BITS)
    index = (key & ((1 << BITS) - 1)).astype(np.uint32)
    return [(index[a:b], value[a:b].astype(np.float32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def counters(data: np.ndarray, offsets: np.ndarray, words: Words) -> dict[str, np.ndarray]:
    """The base counters of each document."""
    n = len(offsets) - 1
    n_words = np.diff(words.first)
    separators = len(data) and np.bincount(np.repeat(np.arange(n), np.diff(offsets))[IS_SEPARATOR[data]], minlength=n)
    points = run_sums((data & 0xC0) != 0x80, offsets, np.int64)
    out = {"n_words": n_words, "word_chars": points - separators, "n_symbols": run_sums(_IS_SYMBOL[data], offsets, np.int64)}
    # Lines: those with a word that equal an earlier line of their document.
    lines = find_words(data, offsets, _IS_NEWLINE)
    filled = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    key = mix(hash_words(lines, 2) + lines.doc.astype(U64) * U64(0x9E3779B97F4A7C15))[filled]
    where = lines.doc[filled]
    _, unique = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[unique] = False
    out["n_dup_lines"] = np.bincount(where[later], minlength=n).astype(np.int64)
    # Words that lie in a 3-word window which the document has twice or more.
    doc = words.doc
    covered = np.zeros(len(doc), bool)
    if len(doc) >= 3:
        inside = doc[2:] == doc[:-2]
        key = mix(sequence_hash(hash_words(words, 3), 3) + doc[:-2].astype(U64) * U64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(inside)
        order = at[np.argsort(key[at], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[k : len(doc) - 2 + k] |= twice
    out["n_repeat_words"] = run_sums(covered, words.first, np.int64)
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def fit_logistic(index: np.ndarray, value: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 1.0, l2: float = 1e-6, block: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression with per-coordinate (AdaGrad) rates; classes weigh the same.

    Row i has the n-grams index[first[i]:first[i + 1]]; a round goes over about `block` of them at a time.
    """
    used = np.zeros(1 << BITS, bool)
    used[index] = True
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    cuts = np.unique(np.concatenate([np.searchsorted(first, np.arange(0, first[-1], block)), [len(y)]])).tolist()
    w, b, seen, seen_b = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-12), 1e-12
    for _ in range(rounds):
        g, total, flat = l2 * w, 0.0, w.astype(np.float32)
        for i, j in zip([0, *cuts], cuts, strict=False):
            if i == j:
                continue
            at, v, own = index[first[i] : first[j]], value[first[i] : first[j]], first[i : j + 1] - first[i]
            p = 1 / (1 + np.exp(-np.clip(run_sums(v * flat[at], own) + b, -60, 60)))
            error = (p - y[i:j]) * weight[i:j]
            g += np.bincount(at, v * np.repeat(error.astype(np.float32), np.diff(own)), len(w))
            total += error.sum()
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        seen_b += total**2
        b -= 0.1 * rate * total / np.sqrt(seen_b)
    return np.where(used, w, 0).astype(np.float32), float(b)


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(scale, shift) that maximise the likelihood, with Platt's smoothed targets."""
    ones, zeros = y.sum(), (1 - y).sum()
    if not ones or not zeros:
        return 1.0, 0.0
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    unit = max(float(np.std(raw)), 1e-6)
    x = np.stack([raw / unit, np.ones_like(raw)], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * theta)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-3) / unit), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, test_folds: int = 5) -> QualityModel:
    """Fit on at most `most_rows` labelled rows outside fold 0 of `test_folds` (that fold is left for measuring)."""
    sample = labelled_sample(docs, labels, "quality", most_rows, lambda c: fold(c, test_folds) != 0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 19):
            data, offsets = string_buffer(block.column(2))
            got = features(data, offsets, find_words(data, offsets))
            yield pa.record_batch([block.column(0), block.column(1), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["doc_id", "label", "at", "value"])

    table = sample.mapInArrow(lean(rows), "doc_id long, label int, at binary, value binary").toArrow()
    y, ids = np.array(table["label"], float), np.array(table["doc_id"], np.int64)
    if not len(y) or not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    held = mix(ids.view(U64)) % U64(5) == 0
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    # All rows in flat arrays, by id, those that are not fitted last.
    order = np.lexsort((ids, held))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sizes = np.concatenate([np.diff(string_buffer(c)[1]) for c in table["at"].chunks]) // 4
    first = np.concatenate([[0], np.cumsum(sizes[order])])
    index, value = np.empty(first[-1], np.int32), np.empty(first[-1], np.float32)
    row = 0
    for batch in table.select(["at", "value"]).to_batches():
        for at, v in zip(batch.column(0), batch.column(1), strict=True):
            a, b = first[place[row]], first[place[row] + 1]
            index[a:b], value[a:b] = np.frombuffer(at.as_buffer(), np.uint32), np.frombuffer(v.as_buffer(), np.float32)
            row += 1
    del table
    give_back()
    y, held = y[order], held[order]
    n = int((~held).sum())
    weights, bias = fit_logistic(index[: first[n]], value[: first[n]], first[: n + 1], y[:n])
    raw = np.array([weights[index[a:b]] @ value[a:b] for a, b in zip(first[:-1], first[1:], strict=True)])
    scale, shift = platt(raw[held] + bias, y[held])
    del index, value
    give_back()
    return QualityModel(weights, bias, scale, shift)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """`docs` (any columns, with text) and: the counters, base_failed, kept, and the calibrated probability `quality`.

    Columns of docs named like a result column are replaced by it. The base rules and the verdict read the whole text.
    """
    spark = ready(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    docs = docs.drop(*names)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS float32 weights, a fixed 1 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in blocks(batches, "text", 2 << 20):
            data, offsets = string_buffer(block.column(block.schema.get_field_index("text")))
            words = find_words(data, offsets)
            c = counters(data, offsets, words)
            failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])
            p = m.probability(raw_scores(data, offsets, words, m.weights))
            new = [*(pa.array(c[k]) for k in names[:5]), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
            yield pa.record_batch([*block.columns, *new], [*block.schema.names, *names])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), SCHEMA])
    return docs.mapInArrow(lean(score), schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """The counters, the base rule and the calibrated verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality(docs, model)
    return out.select("doc_id", *[x.split()[0] for x in SCHEMA.split(", ")])
