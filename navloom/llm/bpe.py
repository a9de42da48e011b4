"""Byte-level BPE encoding and decoding with the vocabulary of a public tokenizer file.

Encoding splits a text into pieces by the byte-level pattern. Which code points are letters, numbers
and white space to that pattern depends on the Unicode version of who evaluates it, so the three
classes are read off the library's own pre-tokenizer (`classes`), once in the driver, and every
engine gets them spelt out as ranges. Within a piece an Aho-Corasick automaton over all tokens gives, for every place, the longest token that starts there. The encoder
walks left to right, takes the longest token that is compatible with the one before, falls back to
the next shorter prefix, and steps back where nothing fits; places that led nowhere are marked, so
each is tried once and the work is linear in the piece. Two tokens are compatible if merging their
joined bytes from scratch ends in exactly these two, which is read off the merge table.

A bounded table in each worker remembers the ids of pieces and of whole space-separated chunks.
Decoding gathers bytes from one table of all tokens by its offsets.

Defined results: a null text is an empty text, with no ids, and decodes to an empty text. The text
of a special token is encoded as that token. Repeated rows get the same result. In decoding, null
ids, null elements of a list and ids outside the table stand for nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.text import blocks
from navloom.session import ready

# The piece pattern of byte-level BPE; L, N and S stand for the classes of code points.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
REMEMBERED = 600_000  # chunks in a generation; half as many pieces


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Classes(NamedTuple):
    """The ranges (first, last) of code points that are letters, numbers and white space to a tokenizer's pattern."""

    letter: tuple[tuple[int, int], ...]
    number: tuple[tuple[int, int], ...]
    space: tuple[tuple[int, int], ...]

    def pattern(self, escape: str) -> str:
        """PATTERN with the classes spelt out; `escape` writes a code point: \\U%08x in Python, \\x{%x} in Rust."""
        within = {k: "".join(escape % a + ("-" + escape % b if b > a else "") for a, b in own) for k, own in zip("LNS", self, strict=True)}
        return re.sub(r"(?<=[\[^LNS])[LNS]", lambda m: within[m[0]], PATTERN)


@lru_cache(maxsize=4)
def classes(path: str) -> Classes:
    """The classes of code points of a tokenizer file's pre-tokenizer, by asking it about every code point.

    All code points in order are split, a few thousand at a time: a piece is a run of one class, whose first member is
    then asked for its class by what it is joined to: "a", "1" and "!" stay in one piece with a letter, a number and
    any other character.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        own = {**json.load(f), "model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
    split = Tokenizer.from_str(json.dumps(own)).pre_tokenizer.pre_tokenize_str
    out: dict[int, list[tuple[int, int]]] = {0: [], 1: [], 2: [], 3: []}
    for low in (x for x in range(0, 0x110000, 0x800) if not 0xD800 <= x < 0xE000):
        text = "".join(map(chr, range(low, low + 0x800)))
        first = {a for _, (a, _) in split(text)} | (set() if low else set(range(257)))  # the first 256 one by one: a space joins what follows
        for a, b in pairwise(sorted(first | {len(text)})):
            runs = out[next((k for k, c in enumerate("a1!") if len(split(c + text[a])) == 1), 3)]
            if runs and runs[-1][1] == low + a - 1:
                runs[-1] = (runs[-1][0], low + b - 1)
            else:
                runs.append((low + a, low + b - 1))
    return Classes(tuple(out[0]), tuple(out[1]), tuple(out[3]))


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        model = file["model"]
        self.token = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        ids = {t: i for i, t in self.token.items()}
        #: by the pair of ids: (rank, id of the merged token); the parts of each merged token, and its rank
        self.pair, self.parts, self.rank = {}, {}, {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (ids[bytes(letters[c] for c in x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            merged = ids[self.token[a] + self.token[b]]
            self.pair.setdefault((a, b), (rank, merged))
            self.parts.setdefault(merged, (a, b))
            self.rank.setdefault(merged, rank)
        for i, t in self.token.items():
            if len(t) == 1:
                self.rank[i] = -1
        usable = {t: i for t, i in ids.items() if i in self.rank}
        self.size = {i: len(t) for i, t in self.token.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.byte = {t[0]: i for t, i in usable.items() if len(t) == 1}
        #: the longest proper prefix of each token that is a token
        self.shorter = {}
        for t, i in usable.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in usable:
                    self.shorter[i] = usable[t[:n]]
                    break
        self._compatible: dict[tuple[int, int], bool] = {}
        # The decoding table: all tokens in one run of bytes, special ones by their text.
        texts = {**self.token, **{i: t.encode() for t, i in self.special.items()}}
        size = max(texts) + 1
        lengths = np.array([len(texts.get(i, b"")) for i in range(size)])
        self.bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps the border between a and b in their joined bytes.

        Undo the later merge of the two sides again and again; the border falls if the tokens that
        meet at it could merge before the merges that were undone on either side.
        """
        known = self._compatible.get((a, b))
        if known is not None:
            return known
        first, second, answer = a, b, True
        # A merge across the border happens before the merge undone on the left if its rank is lower,
        # and before the one undone on the right if its rank is no higher (equal ranks go left to right).
        ends_left, ends_right = float("inf"), float("inf")
        while True:
            met = self.pair.get((first, second))
            if met is not None and met[0] < ends_left and met[0] <= ends_right:
                answer = False
                break
            left, right = self.rank[first], self.rank[second]
            if left < 0 and right < 0:
                break
            # The side whose last merge came later is undone; of equal ranks the right one came later.
            if left > right:
                ends_left, ends_right, first = left, min(ends_right, left), self.parts[first][1]
            else:
                ends_right, ends_left, second = right, min(ends_left, right + 0.5), self.parts[second][0]
        if len(self._compatible) >= REMEMBERED:
            self._compatible.clear()
        self._compatible[a, b] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, by longest matches with backtracking."""
        n = len(piece)
        longest = [self.byte[b] for b in piece]
        for end, (size, i) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = i  # of tokens with one start the longest ends last
        longest.append(-1)
        open_ = bytearray(b"\1" * (n + 1))
        size, shorter, known = self.size, self.shorter, self._compatible
        out: list[int] = []
        before, at, token = -1, 0, longest[0]
        while at < n:
            end = at + size[token]
            if open_[end]:
                fits = before < 0 or known.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
                if fits:
                    out.append(token)
                    before, at, token = token, end, longest[end]
                    continue
            less = shorter.get(token)
            if less is not None:
                token = less
                continue
            open_[at] = 0  # nothing fits here: step back and shorten the token before
            token = out.pop()
            at -= size[token]
            before = out[-1] if out else -1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; those outside the table stand for nothing."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.offset) - 1)]
        size = self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.offset[ids] - ends + size, size)].tobytes()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """A bounded memory of a function's results: two generations, of which the older one is dropped when the younger is full.

    What is looked up again moves to the younger generation, so frequent keys stay.
    """

    def __init__(self, function, most: int):
        self.function, self.most, self.old = function, most, {}

    def __missing__(self, key: str):
        got = self.old.get(key, self)
        if got is self:
            got = self.function(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Encoder:
    """Whole texts to ids (packed as little-endian unsigned 32-bit numbers), with bounded memory of chunks and pieces."""

    def __init__(self, vocabulary: Vocabulary, own: Classes):
        self.vocabulary = vocabulary
        self.pieces = re.compile(own.pattern(r"\U%08x"))
        self.letters = re.compile(own.pattern(r"\U%08x").split("| ?")[1])
        self.spaces = frozenset(chr(i) for a, b in own.space for i in range(a, b + 1))
        space = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in own.space)
        self.cut = re.compile(f"(?<=[^{space}]) (?=[^{space}])")  # a single space between other characters
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        self.whole_only = any(" " in s for s in vocabulary.special)  # such a special token could cross chunks
        self.piece = Remembered(lambda piece: _packed(vocabulary.encode_piece(piece.encode())), REMEMBERED // 2)
        self.chunk = Remembered(self._chunk, REMEMBERED)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces.findall(text)))

    def _whole(self, text: str) -> bytes:
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), _packed([self.vocabulary.special[m[0]]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _chunk(self, chunk: str) -> bytes | None:
        """The ids of a chunk with the space before it; None if white space at a rim could belong to a neighbour's piece."""
        if self.letters.fullmatch(chunk):  # one piece, by the pattern
            return self.piece[" " + chunk]
        if not chunk or chunk[0] in self.spaces or chunk[-1] in self.spaces:
            return None
        return self._whole(" " + chunk)

    def encode(self, text: str) -> bytes:
        """A text without runs of white space around its spaces is encoded chunk by chunk: its pieces never cross a single space."""
        head, *rest = text.split(" ")
        if head and head[-1] not in self.spaces and not self.whole_only:
            ids = list(map(self.chunk.__getitem__, rest))
            if None not in ids:
                return self._whole(head) + b"".join(ids)
        return self._whole(text)


@lru_cache(maxsize=2)
def encoder(path: str, own: Classes | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; the driver sends the classes along."""
    return Encoder(Vocabulary(path), own or classes(path))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The worker's decoder."""
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` (any columns, with text) and ids (array of int); a column of docs with that name is replaced."""
    ready(docs.sparkSession)
    docs, path = docs.drop("ids"), path or default_path()
    own = classes(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, own)
        for block in blocks(batches, "text"):
            ids = [np.frombuffer(enc.encode(t or ""), "<u4").astype(np.int32) for t in block.column(block.schema.get_field_index("text")).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.record_batch([*block.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], [*block.schema.names, "ids"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), "ids array<int>"])
    return docs.mapInArrow(work, schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """`rows` (any columns, with ids) and decoded (string): bytes that are no UTF-8 become U+FFFD. Null ids decode to an empty text."""
    ready(rows.sparkSession)
    rows, path = rows.drop("decoded"), path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)
        for batch in batches:
            texts = []
            for i in range(len(batch)):
                own = batch.column(batch.schema.get_field_index("ids"))[i].values
                ids = own.drop_null().to_numpy(zero_copy_only=False) if own is not None else np.zeros(0, int)
                texts.append(table.decode(ids).decode("utf-8", "replace"))
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields), "decoded string"])
    return rows.mapInArrow(work, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digest in one pass, keeping no id column."""
    ready(docs.sparkSession)
    path = path or default_path()
    own = classes(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, own)
        decimal = np.array([str(i) for i in range(len(enc.vocabulary.offset))], object)
        for block in blocks(batches, "text"):
            n, of_ids, of_text = [], [], []
            for text in block.column(1).to_pylist():
                ids = np.frombuffer(enc.encode(text or ""), "<u4")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(decimal[ids].tolist()).encode()).hexdigest())
                back = enc.vocabulary.decode(ids).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.record_batch([block.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
