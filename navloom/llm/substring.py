"""Substring deduplication by recompression.

Rounds of recompression parse every document into phrases, level by level. Words get 64-bit names; a
token run (neighbours with one name) is named as a run and its members keep their borders; then, round
by round, names are split into left and right ones by one bit, and each left name followed by a right
one becomes a pair with a new name, a hash of the two. A name is a function of what it stands for,
so equal runs and pairs get equal names in all documents and partitions: the naming is global without
exchanging a dictionary. Equal substrings get equal symbols inside: whether a border stands after r
rounds depends on 2**(r-1) + 1 words on each side, and a phrase of r rounds has at most 2**r words.

Every span of words is named by its symbols: the phrases of the highest level but one that lie surely
inside (those far enough from the rim), and the words at the rims that are left. Spans with equal words
have equal phrases there, so they have equal names; the symbols of a whole block are kept as sums, from
which any span's name is read in one step.

1. reveal: every border of the highest level (anchor) names the span around it. These names meet in a
   Spark round that tells which are shared. Only names with one partial count for each block of documents
   are shuffled, so a passage in a third of all documents is one row a block. Every window of `size` words
   has an anchor in a middle zone, equal windows at the same place, and the span lies inside the window;
2. verify: a window all of whose zone anchors are shared is a candidate; the 96-bit name of its symbols
   and rims meets its equals in a second Spark round, and equal names are compared by (doc_id, start): all
   but the earliest are repeats. The rims give the exact edges;
3. cut: the words covered by a repeat are removed.

Shuffled rows are packed: one row for each block or partition that sends and partition that gets.
The texts are shuffled once, by document, for steps 2 and 3 together. Nothing is collected.

Defined results: a null or empty text has no words and keeps none. Rows without an id count as one
document with the largest id, 2**63 - 1, and keep their null; rows that share an id count as one document, and of equal windows at the
same start neither is earlier, so repeated rows get the same result. Documents with fewer than
`size` words lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.sample import lean
from navloom.llm.text import U64, Words, blocks, find_words, hash_words, mix, string_buffer
from navloom.session import ready, shuffle_partitions

_ID = "__navloom_id"
_MARKS = "__navloom_marks"
_RUN = U64(0x5851F42D4C957F2D)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LEFT, _MIDDLE, _RIGHT = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)


def zone(size: int) -> tuple[int, int, int]:
    """(rounds, before, after): an anchor's key is the words [anchor - before, anchor + after).

    A window has 2**rounds anchor places in its zone, as many as the longest phrase has words, and
    an anchor's surroundings, 2**(rounds-1) + 1 words on each side, lie within its key.
    """
    rounds = 0
    while 2 ** (rounds + 2) + 2 <= size + 1:
        rounds += 1
    before = (size + 1 - 2**rounds) // 2
    return rounds, before, size + 1 - 2**rounds - before


def levels(names: np.ndarray, first: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, symbol) of the phrases of documents whose words have these names, after 0, 1 ... `rounds` rounds."""
    n = len(names)
    border = np.zeros(n + 1, bool)  # never crossed: between documents and inside runs
    border[first] = True
    inside = np.zeros(n + 1, bool)
    inside[1:n] = names[1:] == names[:-1]
    inside &= ~border
    symbols = np.where(inside[:n] | inside[1:], mix(names ^ _RUN), names)
    border |= inside
    start = np.arange(n)
    out = [(start, names)]
    for r in range(rounds):
        left = (symbols >> U64(11 + r)) & U64(1) == 1
        pair = left[:-1] & ~left[1:] & ~border[start[1:]]
        at = np.flatnonzero(pair)
        symbols = symbols.copy()
        symbols[at] = mix(symbols[at] * U64(0x9E3779B97F4A7C15) + symbols[at + 1] + U64(r))
        keep = np.ones(len(start), bool)
        keep[at + 1] = False
        start, symbols = start[keep], symbols[keep]
        out.append((start, symbols))
    return out


def anchors(names: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """Positions of the phrase borders of the highest level."""
    return levels(names, first, rounds)[-1][0]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, U64)
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _POWERS[base] = known = (np.cumprod(up), np.cumprod(down))
    return known


class Sums:
    """Sums over a sequence of names, from which a hash of any part is read in one step."""

    def __init__(self, names: np.ndarray, base: int):
        up, self.down = _powers(base, len(names) + 1)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(names * up[: len(names)], dtype=U64)])

    def part(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A hash of names[low:high] for each low and high; equal parts have equal hashes wherever they stand."""
        return mix((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(U64))


class Spans:
    """Names of spans of words by the symbols of one level inside and the words at the rims."""

    def __init__(self, names: np.ndarray, parsed: list[tuple[np.ndarray, np.ndarray]], base: int):
        level = max(0, len(parsed) - 2)
        start, symbols = parsed[level]
        self.rim = 2 ** (level - 1) + 1 if level else 0  # borders and symbols that far inside are the span's own
        borders = np.zeros(len(names) + 2, np.int64)
        borders[start + 1] = 1
        self.rank = np.cumsum(borders)  # phrases that start before a position
        self.start = start
        self.words, self.symbols = Sums(names, base), Sums(symbols, base)

    def name(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        a, b = self.rank[low + self.rim], self.rank[high - self.rim + 1] - 1 if self.rim else self.rank[high]
        if not self.rim:
            return self.words.part(low, high)
        # Spans have a border between their rims: phrases of the level are shorter than that.
        b = np.maximum(b, a)
        first, last = self.start[a], self.start[b]
        return mix(self.words.part(low, first) * _LEFT + self.symbols.part(a, b) * _MIDDLE + self.words.part(last, high) * _RIGHT)


def _parse(text: pa.Array, rounds: int) -> tuple[Words, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    data, offsets = string_buffer(text)
    words = find_words(data, offsets)
    names = hash_words(words, 5)
    return words, names, levels(names, words.first, rounds) if len(names) else [(np.zeros(0, np.int64), names)] * (rounds + 1)


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers that mostly ascend by little: differences, byte plane by byte plane, compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _by_part(part: np.ndarray, parts: int, doc: np.ndarray, start: np.ndarray, key: list[np.ndarray]) -> Iterator[list]:
    """[part, packed ids, packed starts, keys] for each part that has entries."""
    order = np.argsort(part, kind="stable")
    part, doc, start, key = part[order], doc[order], start[order].astype(np.uint32), [k[order] for k in key]
    there, first = np.unique(part, return_index=True)
    for p, a, b in zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        yield [p, _squeeze(doc[a:b]), _squeeze(start[a:b]), b"".join(k[a:b].tobytes() for k in key)]


def _unpack(rows: Iterator[pa.RecordBatch], kinds: list[str]) -> Iterator[tuple]:
    """(ids, starts, keys) of each packed row; keys are one array for each of `kinds`, or the raw bytes of a row of marks."""
    for batch in rows:
        for i, s, k in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            doc, start = _unsqueeze(i, "i8"), _unsqueeze(s, "u4")
            if len(k) != len(doc) * sum(np.dtype(x).itemsize for x in kinds):
                yield doc, start, k
                continue
            keys, at = [], 0
            for kind in kinds:
                width = np.dtype(kind).itemsize * len(doc)
                keys.append(np.frombuffer(k[at : at + width], kind))
                at += width
            yield doc, start, keys


_PACKED = "part int, id binary, start binary, key binary"


def _packed(rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "id", "start", "key"])


def _marks(parts: int, doc: np.ndarray, start: np.ndarray, check: np.ndarray | None) -> list[list]:
    """Marks (start and, with a window's mark, 16 bits of its name) of documents, packed by the part that a document's id names."""
    if not len(doc):
        return []
    return list(_by_part((mix(doc.view(U64)) % U64(parts)).astype(np.int32), parts, doc, start, [] if check is None else [check.astype(np.uint16)]))


def gathered(packed: DataFrame) -> DataFrame:
    """(_ID, _MARKS): a row for each document with marks: their packed starts, after the checks if they have them."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list] = [[], [], []]
        for d, s, k in _unpack(batches, ["u2"]):
            for out, x in zip(got, (d, s, k[0] if k else None), strict=True):
                out.append(x)
        if not got[0]:
            return
        doc, start = np.concatenate(got[0]), np.concatenate(got[1])
        check = np.concatenate(got[2]) if got[2][0] is not None else np.zeros(0, np.uint16)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        check = check[order] if len(check) else check
        ids, first = np.unique(doc, return_index=True)
        ends = np.append(first, len(doc)).tolist()
        for i in range(0, len(ids), 1024):
            marks = [np.uint32(len(check[a:b])).tobytes() + check[a:b].tobytes() + _squeeze(start[a:b]) for a, b in zip(ends[i : i + 1024], ends[i + 1 : i + 1025], strict=False)]
            yield pa.record_batch([pa.array(ids[i : i + 1024]), pa.array(marks, pa.binary())], [_ID, _MARKS])

    parts = shuffle_partitions(packed.sparkSession)
    return packed.repartitionById(parts, "part").mapInArrow(lean(merge), f"{_ID} long, {_MARKS} binary")


def _marked(column: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word position in the block, check or 0) of each mark in the column; marks beyond a document are left out."""
    places, checks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
    for i, marks in enumerate(column.to_pylist()):
        if marks:
            n = int.from_bytes(marks[:4], "little")
            start = _unsqueeze(marks[4 + 2 * n :], "u4").astype(np.int64)
            check = np.frombuffer(marks[4 : 4 + 2 * n], np.uint16) if n else np.zeros(len(start), np.uint16)
            fits = start < first[i + 1] - first[i]
            places.append(first[i] + start[fits])
            checks.append(check[fits])
    return np.concatenate(places), np.concatenate(checks)


def _check(names: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """16 bits of the words of each window, by which a mark is told from those of other rows with its id."""
    return Sums(names, _BASES[1]).part(at, at + size) & U64(0xFFFF)


def _starts(doc_of: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at - first[doc_of[at]]


def repeats(docs: DataFrame, size: int) -> DataFrame:
    """(_ID, marks): for each document with repeats, the packed starts of its repeated windows.

    docs: (_ID, text) and other columns; the second step shuffles them by _ID.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rounds, before, after = zone(size)

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words, names, parsed = _parse(block.column(1), rounds)
            doc_of, at = words.doc, parsed[-1][0]
            at = at[(at >= words.first[doc_of[at]] + before) & (at + after <= words.first[1:][doc_of[at]])] if len(at) else at
            if not len(at):
                continue
            key = Spans(names, parsed, _BASES[0]).name(at - before, at + after)
            ids, starts = np.asarray(block.column(0))[doc_of[at]], _starts(doc_of, words.first, at)
            _, one, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            rows = list(_by_part((mix(key[one]) % U64(parts)).astype(np.int32), parts, ids[one], starts[one], [key[one].astype(np.uint32), (key[one] >> U64(32)).astype(np.uint8)]))
            twice = np.flatnonzero(times[back] > 1)
            if len(twice):
                rows.append([int(key[0] % U64(parts)), _squeeze(ids[twice]), _squeeze(starts[twice].astype(np.uint32)), b""])
            yield _packed(rows)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, keys = [], [], []
        for d, s, k in _unpack(batches, ["u4", "u1"]):
            if not k:
                yield _packed(_marks(parts, d, s, None))
            else:
                doc.append(d)
                start.append(s)
                keys.append(k[0].astype(np.uint64) | (k[1].astype(np.uint64) << U64(32)))
        if doc:
            doc, start, key = np.concatenate(doc), np.concatenate(start), np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            if twice.any():
                yield _packed(_marks(parts, doc[twice], start[twice], None))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words, names, parsed = _parse(block.column(1), rounds)
            if len(names) < size:
                continue
            doc_of, at = words.doc, parsed[-1][0]
            missing = np.zeros(len(names) + 1, np.int64)
            missing[at] = 1
            missing[_marked(block.column(2), words.first)[0]] = 0
            missing = np.concatenate([[0], np.cumsum(missing[:-1])])
            p = np.arange(len(names) - size + 1)
            whole = doc_of[p] == doc_of[p + size - 1]
            p = p[whole & (missing[p + size - after + 1] == missing[p + before])]
            if not len(p):
                continue
            one, two = (Spans(names, parsed, base).name(p, p + size) for base in _BASES)
            one, two = (one & ~U64(0xFFFF)) | _check(names, p, size), two.astype(np.uint32)
            doc, start = np.asarray(block.column(0))[doc_of[p]], _starts(doc_of, words.first, p)
            lead, later = _earliest(one, two, doc, start)
            rows = list(_by_part((mix(one[lead]) % U64(parts)).astype(np.int32), parts, doc[lead], start[lead], [one[lead], two[lead]]))
            if len(later):
                rows.append([int(one[0] % U64(parts)), _squeeze(doc[later]), _squeeze(start[later].astype(np.uint32)), one[later].astype(np.uint16).tobytes()])
            yield _packed(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, one, two = [], [], [], []
        for d, s, k in _unpack(batches, ["u8", "u4"]):
            if isinstance(k, bytes):
                yield _packed(_marks(parts, d, s, np.frombuffer(k, np.uint16)))
            else:
                for out, x in zip((doc, start, one, two), (d, s, *k), strict=True):
                    out.append(x)
        if doc:
            doc, start, one, two = (np.concatenate(x) for x in (doc, start, one, two))
            _, later = _earliest(one, two, doc, start)
            if len(later):
                yield _packed(_marks(parts, doc[later], start[later], one[later]))

    found = docs.select(_ID, "text").mapInArrow(lean(reveal), _PACKED).repartitionById(parts, "part").mapInArrow(lean(shared), _PACKED)
    # All columns go along, so that the cut reads the same shuffled texts.
    marked = by_document(docs).join(gathered(found).hint("shuffle_hash"), _ID)
    return gathered(marked.select(_ID, "text", _MARKS, *(c for c in docs.columns if c not in (_ID, "text"))).mapInArrow(lean(windows), _PACKED).repartitionById(parts, "part").mapInArrow(lean(compare), _PACKED))


def by_document(docs: DataFrame) -> DataFrame:
    return docs.repartition(shuffle_partitions(docs.sparkSession), _ID)


def _earliest(one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest entry of each name, the entries that are later than theirs)."""
    order = np.lexsort((start, doc, two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = order[new][np.cumsum(new) - 1]
    later = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return np.sort(order[new]), np.sort(order[later])


def substring_dedup(docs: DataFrame, size: int = 20) -> DataFrame:
    """`docs` (any columns, with doc_id and text) and n_words, n_removed, kept: the kept words joined by one space.

    Columns of docs with these names are replaced.
    """
    ready(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept")
    names = docs.columns
    docs = docs.withColumns({_ID: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "text": F.col("text").cast("string")})
    marks = repeats(docs, size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            text = block.column(block.schema.get_field_index("text"))
            data, offsets = string_buffer(text)
            words = find_words(data, offsets)
            n_words = np.diff(words.first)
            removed = _removed(words, block.column(block.schema.get_field_index(_MARKS)), size)
            n_removed = np.add.reduceat(np.append(removed, False), words.first[:-1], dtype=np.int64) * (n_words > 0) if len(n_words) else n_words
            kept = []
            raw = data.tobytes()
            for i in range(len(block)):
                own = raw[offsets[i] : offsets[i + 1]].split()
                if n_removed[i]:
                    own = itertools.compress(own, (~removed[words.first[i] : words.first[i + 1]]).tolist())
                kept.append(b" ".join(own))
            out = [block.column(block.schema.get_field_index(c)) for c in names]
            yield pa.record_batch([*out, pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != _ID), "n_words long, n_removed long, kept string"])
    joined = by_document(docs).join(marks.hint("shuffle_hash"), _ID, "left")
    return joined.drop(_ID).mapInArrow(lean(cut), schema)


def _removed(words: Words, marks: pa.Array, size: int) -> np.ndarray:
    """Which words a marked window covers; a mark counts only if the window there has the mark's name."""
    n = len(words.start)
    at, check = _marked(marks, words.first)
    at, check = at[at + size <= n], check[at + size <= n]
    if not len(at):
        return np.zeros(n, bool)
    doc = words.doc
    touched = np.zeros(len(words.first) - 1, bool)
    touched[doc[at]] = True
    some = touched[doc]
    only = Words(words.data, words.start[some], words.end[some], words.first)
    names = np.zeros(n, U64)
    names[some] = hash_words(only, 5)
    true = (_check(names, at, size) == check) & (doc[at] == doc[at + size - 1])
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, at[true], 1)
    np.add.at(steps, at[true] + size, -1)
    return np.cumsum(steps[:-1]) > 0


def op4_substring(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated windows of 20 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs, 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# DuckDB SQL for op4. Words are split at the six separators; a window's name is its words joined by one space.
OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) - 18)) AS pos FROM w WHERE len(words) >= 20
), k AS (
  SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 19), ' ')) AS name FROM p
), r AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) AS nth FROM k) WHERE nth > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM r
), g AS (
  SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
         list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
