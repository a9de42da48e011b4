"""Language identification: word-first backoff.

A word (a run of letters, lower-cased) that was seen in training is scored by its log frequency
in each language. An unseen word falls back to the longest character n-grams of it that were seen:
the mean log frequency over its known 4-grams, else 3-grams, else 2-grams, else single letters.
A document's score for a language is the sum over its words; the answer is the best language and
its share after a softmax of the mean score.

Defined results: a null text, or one without a letter, gives `und` and score 0. Repeated rows get
the same result. Ties go to the first language in alphabetical order. A null doc_id is never
learned from. Without training rows every text with a letter gives `und` and score 0.

Bounds, all documented parameters of `fit`: `rows_per_language` rows are learned from for each language
(so a rare language is learned as well as a frequent one), `most_words` and `most_grams` entries are kept
for each language and order, and `most_entries` in all, of which each language and order may have an equal
part. The model stores the languages that have an entry, not a row for every language, so it grows with
entries alone, and scoring a block takes memory for its words and for at most 2**22 (document, language) cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.sample import fold
from navloom.llm.text import U64, blocks, find_chars, hash_runs, mix, string_buffer
from navloom.session import ready

ORDERS = (4, 3, 2, 1)
FOLDS, HELD_OUT = 3, 1
CELLS = 1 << 22  # documents times languages that are scored at once
_EDGE = np.uint32(0x110000)  # stands before and after a word, and is no code point


@dataclass(frozen=True)
class Table:
    """Of one order: sorted hashes; the languages of each with what its log frequency there is above `rest`, that of absent ones."""

    keys: np.ndarray
    first: np.ndarray  # of each key's entries, and at last their number
    language: np.ndarray
    above: np.ndarray
    rest: np.ndarray  # of each language

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, found) of each key."""
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def entries(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of `row`, language, above) of all entries of the rows."""
        which, at = _expand(self.first[row], self.first[row + 1])
        return which, self.language[at], self.above[at]


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for all j in low[i]:high[i]."""
    n = high - low
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - (np.cumsum(n) - n)[i] + low[i]


@dataclass(frozen=True)
class LanguageModel:
    """A table for each order: 0 for words, n for n-grams."""

    languages: tuple[str, ...]
    tables: dict[int, Table]


def _grams(code: np.ndarray, start: np.ndarray, end: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word between edge marks (single letters: without), and the word of each."""
    edge = order > 1
    size = end - start + 2 * edge
    first = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(start)), size)
    at = np.arange(first[-1]) - first[:-1][word] - edge + start[word]
    padded = np.full(len(at), _EDGE, np.uint32)
    real = (at >= start[word]) & (at < end[word])
    padded[real] = code[at[real]]
    n = len(padded) - order + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(n, U64)
    for k in range(order):
        h = h * U64(0x9E3779B97F4A7C15) + padded[k : n + k].astype(U64) + U64(1)
    inside = word[order - 1 :] == word[:n]
    return mix(h + U64(order))[inside], word[:n][inside]


def _unique_words(block: pa.RecordBatch) -> tuple[object, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = string_buffer(block.column(block.schema.get_field_index("text")))
    chars = find_chars(data, offsets, "letter")
    key, which, inverse = np.unique(hash_runs(chars.code, chars.start, chars.end), return_index=True, return_inverse=True)
    return chars, key, which, inverse


def fit(docs: DataFrame, learn=None, rows_per_language: int = 5000, most_words: int = 50000, most_grams: int = 50000, most_entries: int = 4_000_000) -> LanguageModel:
    """Count words and n-grams by language over about `rows_per_language` labelled documents of each language at most.

    Which documents: those whose id hashes below that share of the language's rows, so the choice depends on ids
    alone. For each order and language the `most_words` or `most_grams` most frequent entries are kept (of equally
    frequent ones at the bound those with smaller hashes), or most_entries / (orders * languages) where that is less.
    The counts are made and cut on the executors, in one pass that is checkpointed; the driver sees counts of counts
    and the kept entries.
    """
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        docs = docs.where(learn(F.col("doc_id")))
    rows = docs.groupBy("lang").agg(F.count("*").alias("n")).toArrow().to_pylist()  # a row for each language
    languages = tuple(sorted(r["lang"] for r in rows))
    shares = [(r["lang"], languages.index(r["lang"]), min(2**63 - 1, 2**63 * rows_per_language // r["n"])) for r in rows]
    shares = spark.createDataFrame(shares, "lang string, of int, most long")
    docs = docs.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= F.col("most")).select("of", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            names, lang = np.unique(np.asarray(block.column(0)), return_inverse=True)
            chars, _, which, inverse = _unique_words(block)
            of_word = np.repeat(lang, np.diff(chars.first))
            pair, times = np.unique(inverse.astype(np.int64) * len(names) + of_word, return_counts=True)
            first = which[pair // len(names)]
            start, end, of = chars.start[first], chars.end[first], pair % len(names)
            parts = [(0, hash_runs(chars.code, start, end), of, times)]
            for order in ORDERS:
                gram, word = _grams(chars.code, start, end, order)
                parts.append((order, gram, of[word], times[word]))
            for order, key, of, times in parts:
                _, one, back = np.unique(mix(key + of.astype(U64) * U64(0xD6E8FEB86659FD93)), return_index=True, return_inverse=True)
                if len(one):
                    n = np.bincount(back, times, len(one)).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(n), order, np.int32)), pa.array(names[of[one]], pa.int32()), pa.array(key[one].view(np.int64)), pa.array(n)], ["size", "of", "gram", "n"])

    counts = docs.mapInArrow(count, "size int, of int, gram long, n long").groupBy("size", "of", "gram").agg(F.sum("n").alias("n")).checkpoint()
    # The n-th largest count of each language and order, without one task that sees all of it: counts of counts first.
    times = counts.groupBy("size", "of", "n").agg(F.count("*").alias("m")).toArrow()
    size, of, n, m = (np.asarray(times[c]) for c in ("size", "of", "n", "m"))
    order = np.lexsort((-n, of, size))
    size, of, n, m = (x[order] for x in (size, of, n, m))
    every = np.zeros((1 + max(ORDERS), len(languages)))
    np.add.at(every, (size, of), n * m)
    least = []
    part = most_entries // ((1 + len(ORDERS)) * max(1, len(languages)))
    new = np.flatnonzero(np.diff(size, prepend=-1) | np.diff(of, prepend=-1)).tolist()
    for a, b in zip(new, [*new[1:], len(n)][: len(new)], strict=True):
        room = max(1, min(most_words if size[a] == 0 else most_grams, part))
        got = np.cumsum(m[a:b])
        k = min(int(np.searchsorted(got, room)), b - a - 1)  # the last count that is kept, wholly or in part
        left = room - int(got[k] - m[a + k])
        least.append((int(size[a]), int(of[a]), int(n[a + k]), min(2**63 - 1, 2**63 * left // int(m[a + k]))))
    least = F.broadcast(spark.createDataFrame(least, "size int, of int, least long, most long"))
    kept = counts.join(least, ["size", "of"]).where((F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (F.shiftrightunsigned("gram", 1) <= F.col("most"))))
    table = kept.select("size", "of", "gram", "n").toArrow()
    sizes, ofs, grams, numbers = (np.asarray(table[c]) for c in ("size", "of", "gram", "n"))
    tables = {}
    for size in (0, *ORDERS):
        mine = np.flatnonzero(sizes == size)
        mine = mine[np.lexsort((ofs[mine], grams[mine].view(U64)))]
        key, first = np.unique(grams[mine].view(U64), return_index=True)
        rest = np.log(0.1 / (every[size] + 0.1 * max(len(key), 1)))
        above = np.log((numbers[mine] + 0.1) / 0.1).astype(np.float32)
        tables[size] = Table(key, np.append(first, len(mine)), ofs[mine].astype(np.int32), above, rest)
    return LanguageModel(languages, tables)


def word_entries(model: LanguageModel, code: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, language, above): of each word the longest unit that is known (-1: none), and its entries from first[word] on.

    A word that is known by n-grams has the mean over its known ones.
    """
    at, found = model.tables[0].look_up(key)
    order = np.where(found, 0, -1)
    which, lang, above = model.tables[0].entries(at[found])
    parts = [(np.flatnonzero(found)[which], lang, above.astype(np.float64))]
    left = np.flatnonzero(~found)
    for size in ORDERS:
        if not len(left):
            break
        gram, word = _grams(code, start[left], end[left], size)
        at, known = model.tables[size].look_up(gram)
        word, at = word[known], at[known]
        if len(word):
            n = np.bincount(word, minlength=len(left))
            which, lang, above = model.tables[size].entries(at)
            parts.append((left[word[which]], lang, above / n[word[which]]))
            order[left[n > 0]] = size
            left = left[n == 0]
    word, lang, above = (np.concatenate(x) for x in zip(*parts, strict=True))
    sort = np.argsort(word, kind="stable")
    return order, np.searchsorted(word[sort], np.arange(len(key) + 1)), lang[sort], above[sort]


def mean_scores(model: LanguageModel, order: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], word: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The mean score of the documents' words (their places in `order`) for every language."""
    first, lang, above = entries
    n = len(model.languages)
    which, at = _expand(first[word], first[word + 1])
    out = np.bincount(doc[which] * n + lang[at], above[at], docs * n).reshape(docs, n)
    for size, table in model.tables.items():
        out += np.bincount(doc[order[word] == size], minlength=docs)[:, None] * table.rest
    return out / np.maximum(np.bincount(doc, minlength=docs), 1)[:, None]


def language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` (any columns, with text) and lang_pred, score; columns of docs with these names are replaced."""
    spark = ready(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)  # at most most_entries entries

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in blocks(batches, "text"):
            chars, key, which, inverse = _unique_words(block)
            n = np.diff(chars.first)
            best, share = np.full(len(block), -1), np.zeros(len(block))
            if m.languages and len(key):
                order, *entries = word_entries(m, chars.code, chars.start[which], chars.end[which], key)
                step = max(1, CELLS // len(m.languages))
                for a in range(0, len(block), step):
                    own = n[a : a + step]
                    mean = mean_scores(m, order, entries, inverse[chars.first[a] : chars.first[a + len(own)]], np.repeat(np.arange(len(own)), own), len(own))
                    e = np.exp(mean - mean.max(1, keepdims=True))
                    best[a : a + step], share[a : a + step] = np.where(own > 0, mean.argmax(1), -1), np.where(own > 0, e.max(1) / e.sum(1), 0.0)
            names = np.array([*m.languages, "und"], object)[best]
            yield pa.record_batch([*block.columns, pa.array(names.tolist(), pa.string()), pa.array(share)], [*block.schema.names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "score double"])
    return docs.mapInArrow(score, schema)


def op3_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, lambda c: fold(c, FOLDS) != HELD_OUT)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return language(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")
