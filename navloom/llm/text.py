"""Vectorised text kernels on Arrow buffers.

Spark hands a batch of documents to Python as one Arrow string column: one run of UTF-8 bytes
and an offset for each document. The kernels here work on those bytes with numpy and make no
Python object for a word. A batch is first cut into blocks of a few megabytes (`blocks`), so
memory is bounded by the block size or by the one longest document, whichever is larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20

# The separators of the word pattern [^\x20\x09-\x0D]+.
SEPARATORS = b" \t\n\x0b\x0c\r"

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True

U64 = np.uint64
_LONG = 256
_M1, _M2, _M3 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, elementwise."""
    h = h ^ (h >> U64(33))
    h = h * _M1
    h ^= h >> U64(33)
    h *= _M2
    h ^= h >> U64(33)
    return h


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds at most `most` bytes, or a single row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        offsets = string_buffer(batch.column(at))[1]
        i = 0
        while i < len(batch):
            j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
            j = min(max(j, i + 1), len(batch))
            yield batch.slice(i, j - i)
            i = j


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """The words of a block of documents, in order: byte spans and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each document, and at last the number of words

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SEPARATOR) -> Words:
    """Maximal runs of bytes that are no separators; a run ends where its document ends."""
    n = len(data)
    inside = ~separator[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before[:n])
    ahead = after[1:].copy()
    ahead[edges - 1] = False
    end = np.flatnonzero(inside & ~ahead) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def hash_words(words: Words, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    size = words.end - words.start
    h = mix(size.astype(U64) * _M1 + U64((seed * int(_M3)) % 2**64))
    if not len(size):
        return h
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    long = np.flatnonzero(size > _LONG)
    rest, which, step = np.minimum(size, _LONG), None, 0
    while True:
        left = np.minimum(rest - step, 8).astype(U64)
        at = words.start if which is None else words.start[which]
        part = eight[at + step] & (~U64(0) >> (U64(64) - left * U64(8)))
        if which is None:
            h = mix(h ^ part)
        else:
            h[which] = mix(h[which] * _M3 ^ part)
        step += 8
        more = np.flatnonzero(rest > step)
        if not len(more):
            break
        which = more if which is None else which[more]
        rest = rest[more]
    _hash_long(h, long, words.data, words.start, words.end)
    return h


def _hash_long(h: np.ndarray, which: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """The few long spans are hashed one by one instead of in lock step."""
    for i in which:
        digest = hashlib.blake2b(values[start[i] : end[i]].tobytes(), digest_size=8).digest()
        h[i] ^= U64(int.from_bytes(digest, "little"))


def sequence_hash(h: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of h[i:i+n] for each i that has n values from there on; order matters."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= U64(factor | 1)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def run_sums(values: np.ndarray, first: np.ndarray, kind=np.float64) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]; 0 for an empty run."""
    out = np.zeros(len(first) - 1, kind)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], dtype=kind)
    return out


# --- code points ------------------------------------------------------------------------------

_TABLES: dict[str, np.ndarray] = {}


def _char_tables() -> dict[str, np.ndarray]:
    """By rule, for every code point: is it a letter, is it a letter or digit, its one-character lower case."""
    if not _TABLES:
        letter, alnum, lower = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i] = True
            if c.isalnum():
                alnum[i] = True
                low = c.lower()
                if len(low) == 1 and low != c:
                    lower[i] = ord(low)
        _TABLES.update(letter=letter, alnum=alnum, lower=lower)
    return _TABLES


@dataclass
class Chars:
    """Code points of a block of documents, lower-cased, and the maximal runs of letters (or letters and digits)."""

    code: np.ndarray
    first_code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets by code point)."""
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    lead = (data & 0xC0) != 0x80
    return code, np.concatenate([[0], np.cumsum(run_sums(lead, offsets, np.int64))])


def find_chars(data: np.ndarray, offsets: np.ndarray, kind: str = "letter") -> Chars:
    tables = _char_tables()
    code, first_code = code_points(data, offsets)
    runs = find_words(np.zeros(0, np.uint8), np.zeros(1, np.int64)) if not len(code) else _runs(tables[kind][code], first_code)
    return Chars(tables["lower"][code], first_code, runs.start, runs.end, runs.first if len(code) else np.zeros(len(offsets), np.int64))


def _runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    return find_words((~inside).view(np.uint8), offsets, _FLAG)


_FLAG = np.zeros(256, bool)
_FLAG[1] = True


def hash_runs(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points."""
    size = end - start
    h = mix(size.astype(U64) * _M3 + U64(7))
    if not len(size):
        return h
    # Short spans in lock step, one code point at a time; the few long ones shrink the set quickly.
    which, step = np.arange(len(size)), 0
    rest = np.minimum(size, _LONG)
    while len(which):
        h[which] = (h[which] ^ code[start[which] + step].astype(U64)) * _M2
        h[which] ^= h[which] >> U64(29)
        step += 1
        keep = rest > step
        which, rest = which[keep], rest[keep]
    h = mix(h)
    _hash_long(h, np.flatnonzero(size > _LONG), code, start, end)
    return h
