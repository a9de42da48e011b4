"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit SimHash of its word shingles. Fingerprints link at `most_bits` or fewer
differing bits, and documents whose fingerprints are connected form a component.

The fingerprint is cut into segments, each with a radius, such that two fingerprints within
`most_bits` must agree within the radius in one segment (the radii plus one sum to more than
`most_bits`). Every fingerprint is entered into one table for each segment under its value there;
it enumerates the small Hamming ball around that value, fetches the entries it meets in the table,
and the whole distance of every candidate is verified. Tables and probes are partitioned by
(segment, value); copies of one text are one fingerprint from the start.

How many segments, and how wide, follows from the number of distinct fingerprints: the cover with the
least work of probing and of checking unrelated candidates, so candidates do not grow with the square.
A group of thousands of fingerprints under one value is not expanded into pairs: it is searched
from one fingerprint after another, breadth first, and only the edges of a spanning forest are kept;
if the group turns out to be sparsely linked, the same method is applied within it to the bits that the
group does not share.
Components over all edges are found by Spark rounds (navloom.llm.components).

Defined results: a text without a word (or null) has fingerprint 0, which links like any other;
with fewer words than a shingle the whole sequence is the one shingle; repeated rows share a
component; an id of null is never the smallest of its component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.components import components
from navloom.llm.sample import give_back, lean
from navloom.llm.text import U64, blocks, mix, string_buffer
from navloom.session import ready, shuffle_partitions

SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of `size` words, in text order; A-Z count as a-z."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, U64)
    joined = b" ".join(tokens)
    if len(tokens) <= size:
        hashes = xxhash.xxh64_digest(joined, SEED)
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(tokens) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)])
    return np.frombuffer(hashes, ">u8").astype(U64)


def fingerprint(text: bytes, size: int, words: int = 1) -> bytes:
    """The SimHash of a text's shingles of `size` words, 64 bits for each of `words`; A-Z count as a-z.

    The first 64 bits come from the shingles' XXH64, more come from mixing that with other constants.
    """
    return _simhash(shingles(text, size), words)


def _simhash(h: np.ndarray, words: int) -> bytes:
    if not len(h):
        return bytes(8 * words)
    out = []
    for w in range(words):
        bits = (h if w == 0 else mix(h + U64(w) * U64(0x9E3779B97F4A7C15))).astype(">u8").view(np.uint8).reshape(-1, 8)
        count = np.zeros(64, np.int64)
        for k in range(0, len(bits), 1 << 16):
            count += np.unpackbits(bits[k : k + (1 << 16)], axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * count > len(bits)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, size: int = 4, words: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text, most significant bit first."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            got = [fingerprint(t or b"", size, words) for t in block.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([block.column(0), pa.array(got, pa.binary())], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(work), "doc_id long, fp binary")


Segment = tuple[int, int, int]  # word, mask of its bits, radius


@lru_cache(maxsize=256)
def ball(mask: int, radius: int) -> np.ndarray:
    """What a value may be XORed with: all sets of at most `radius` bits of the mask, none first."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return np.array([sum(x) for r in range(radius + 1) for x in combinations(bits, r)], U64)


def _ball_size(bits: int, radius: int) -> int:
    return sum(comb(bits, r) for r in range(radius + 1))


def segments(most_bits: int, n: int = 1 << 16, mask: int = (1 << 64) - 1) -> list[Segment]:
    """Segments of the bits of `mask` whose radii plus one sum to most_bits + 1, for n fingerprints.

    Two fingerprints within most_bits agree within its radius in one segment. Of the covers by few segments (so that
    they have radii, unless most_bits is small) that with the least work: an entry for each element of each ball, and
    n / 2**width unrelated candidates for each, which cost a fiftieth of an entry.
    """
    places = [i for i in range(64) if mask >> i & 1]
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for m in range(1, min(len(places), most_bits // 2 + 1) + 1):
        low, more = divmod(most_bits + 1, m)
        for narrow in range(1, len(places) // m + 1):
            rest, wide = len(places) - narrow * (m - more), []
            if more:
                wide = [(rest // more + (i < rest % more), low) for i in range(more)]
            elif rest:
                continue
            own = [*wide, *([(narrow, low - 1)] * (m - more))]
            work = sum(_ball_size(w, r) * (1 + n / 2**w / 50) for w, r in own)
            best = min(best, (work, own))
        if not more and len(places) % m:  # equal radii, widths that differ by one
            own = [(len(places) // m + (i < len(places) % m), low - 1) for i in range(m)]
            best = min(best, (sum(_ball_size(w, r) * (1 + n / 2**w / 50) for w, r in own), own))
    out, at = [], 0
    for width, radius in best[1]:
        out.append((0, sum(1 << i for i in places[at : at + width]), radius))
        at += width
    return out


def even_segments(words: int, bits: int, radius: int) -> list[Segment]:
    """Equal segments of a fingerprint of several words."""
    return [(w, ((1 << bits) - 1) << shift, radius) for w in range(words) for shift in range(0, 64 - bits + 1, bits)]


def _distance(fp: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]).sum(-1)


def _pairs(low: np.ndarray, high: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each j in low[i]:high[i], about `most` at a time."""
    n = np.maximum(high - low, 0)
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        before = ends[i] - n[i]
        j = max(i + 1, int(np.searchsorted(ends, before + most, "right")))
        left = np.repeat(np.arange(i, j), n[i:j])
        yield left, np.arange(len(left)) - (ends[i:j] - n[i:j] - before)[left - i] + low[left]
        i = j


def _forest(fp: np.ndarray, most_bits: int, patience: int = 1 << 30) -> list[tuple[int, int]] | None:
    """Edges of a spanning forest of the links among fp, breadth first; one row of distances at a time.

    None if after `patience` rows fewer than eight fingerprints a row have been met: the group is sparsely linked.
    """
    left, edges, rows = np.arange(len(fp)), [], 0
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _distance(fp, left, at) <= most_bits
            edges += [(at, x) for x in left[near].tolist()]
            front.extend(left[near].tolist())
            left = left[~near]
            rows += 1
            if rows == patience and len(fp) - len(left) < 8 * patience:
                return None
    return edges


def _within(fp: np.ndarray, most_bits: int, mask: int, large: int) -> np.ndarray:
    """Edges (i, j), i < j, with the components of the links among fp, 64-bit fingerprints that differ in bits of `mask` only."""
    if len(fp) < max(large, 512) or not mask:
        return np.array(_forest(fp[:, None], most_bits), np.int64).reshape(-1, 2)
    edges = _forest(fp[:, None], most_bits, max(1, large // 8))
    if edges is not None:
        return np.array(edges, np.int64).reshape(-1, 2)
    found = [np.zeros((0, 2), np.int64)]
    for _, own, radius in segments(most_bits, len(fp), mask):
        value = fp & U64(own)
        order = np.argsort(value, kind="stable")
        table = value[order]
        start, end = np.searchsorted(table, table, "left"), np.searchsorted(table, table, "right")
        for a in np.unique(start[end - start > 1]):
            group = order[a : end[a]]
            found.append(group[_within(fp[group], most_bits, mask & ~own, large)])
        for flip in ball(own, radius)[1:]:
            low, high = np.searchsorted(table, table ^ flip, "left"), np.searchsorted(table, table ^ flip, "right")
            for i, j in _pairs(low, high):
                near = _distance(fp[:, None], order[i], order[j]) <= most_bits
                found.append(np.stack([order[i][near], order[j][near]], 1))
    return np.concatenate(found)


def thin(edges: np.ndarray) -> np.ndarray:
    """Fewer edges (node, least node it reaches) with the same components."""
    nodes, ends = np.unique(edges, return_inverse=True)
    ends = ends.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[ends[:, 0]], label[ends[:, 1]])
        before = label.copy()
        for k in range(2):
            np.minimum.at(label, ends[:, k], least)
            np.minimum.at(label, before[ends[:, k]], least)
        label = label[label]
        if (label == before).all():
            break
    rest = label != np.arange(len(nodes))
    return np.stack([nodes[label[rest]], nodes[rest]], 1)


def links(reps: DataFrame, most_bits: int, cut: list[Segment], large: int = 64, words: int = 1) -> DataFrame:
    """(a, b), a < b: labels of fingerprints that differ in at most most_bits bits, or fewer edges with the same components.

    reps: (label, fp), each fp once. A fingerprint has `words` words; with a multiple of them reps hold several independent
    fingerprints, and a segment finds links of the one that its word belongs to. From groups of `large` fingerprints on, a spanning forest replaces
    the group's own pairs, and a probe of a group that is connected looks for one link only; that changes the work, not
    the components. What a task finds is thinned to a forest.
    """
    spark = ready(reps.sparkSession)
    parts = shuffle_partitions(spark)

    def fps(column: pa.Array) -> np.ndarray:
        return np.frombuffer(string_buffer(column)[0].tobytes(), ">u8").astype(U64).reshape(len(column), -1)

    balls = [ball(mask, radius) for _, mask, radius in cut]
    segment_of = np.repeat(np.arange(len(cut)), [len(x) for x in balls])
    flip_of, word_of = np.concatenate(balls), np.array([x[0] for x in cut])[segment_of]
    mask_of, own_of = np.array([x[1] for x in cut], U64)[segment_of], np.concatenate([np.arange(len(x)) == 0 for x in balls])
    salt_of = mix(segment_of.astype(U64) + U64(1))
    if len(flip_of) > 1 << 16:
        raise ValueError("more than 65,536 table entries a fingerprint")
    rows = max(1, (1 << 19) // len(flip_of))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, rows) for b in batches for i in range(0, len(b), rows)):
            label, fp = np.asarray(batch.column(0)), fps(batch.column(1))
            key = mix(((fp[:, word_of] & mask_of) ^ flip_of) ^ salt_of).ravel()
            where = (key % U64(parts)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            code, who, where = (order % len(flip_of)).astype(np.uint16), order // len(flip_of), where[order]
            there, first = np.unique(where, return_index=True)
            ends = [*first[1:].tolist(), len(where)]
            blobs: list[list[bytes]] = [[], [], []]
            for a, b in zip(first.tolist(), ends, strict=True):
                own = fp.reshape(len(fp), -1, words)[who[a:b], word_of[code[a:b]] // words]
                for out, x in zip(blobs, (label[who[a:b]], own, code[a:b]), strict=True):
                    out.append(x.tobytes())
            yield pa.record_batch([pa.array(there), *(pa.array(x, pa.binary()) for x in blobs)], ["part", "label", "fp", "code"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[bytes]] = [[], [], []]
        for batch in batches:
            for out, name in zip(got, ("label", "fp", "code"), strict=True):
                out.extend(batch.column(batch.schema.get_field_index(name)).to_pylist())
        label, fp, code = (np.frombuffer(b"".join(x), kind) for x, kind in zip(got, (np.int64, np.uint64, np.uint16), strict=True))
        del got
        fp = fp.reshape(-1, words)
        # A clash of keys only adds candidates.
        key = mix(((fp[np.arange(len(fp)), word_of[code] % words] & mask_of[code]) ^ flip_of[code]) ^ salt_of[code])
        entry, probe = np.flatnonzero(own_of[code]), np.flatnonzero(~own_of[code])
        entry = entry[np.lexsort((label[entry], key[entry]))]
        table = key[entry]
        edges, many = [np.zeros((0, 2), np.int64)], 0

        def keep(e: np.ndarray) -> None:
            nonlocal edges, many
            edges.append(e)
            many += len(e)
            if many > 1 << 21:
                edges = [thin(np.concatenate(edges))]
                many = len(edges[0])

        def check(i, j) -> None:
            i, j = (x[label[i] != label[j]] for x in (i, j))
            near = _distance(fp, i, j) <= most_bits
            keep(np.stack([label[i[near]], label[j[near]]], 1))

        start, end = np.searchsorted(table, table, "left"), np.searchsorted(table, table, "right")
        big = end - start >= large
        for i, j in _pairs(np.arange(len(entry)) + 1, np.where(big, 0, end)):
            check(entry[i], entry[j])
        for a in np.unique(start[big]):
            group = entry[a : end[a]]
            mask = ~int(mask_of[code[group[0]]]) & (1 << 64) - 1
            found = _within(fp[group, 0], most_bits, mask, large) if words == 1 else np.array(_forest(fp[group], most_bits), np.int64).reshape(-1, 2)
            keep(label[group[found]])
        # Entries go by their component so far, so one look at a value's first and last shows whether they are connected.
        edges = [thin(np.concatenate(edges))]
        part = label.copy()
        order = np.argsort(edges[0][:, 1])
        nodes, roots = edges[0][order, 1], edges[0][order, 0]
        if len(nodes):
            at = np.minimum(np.searchsorted(nodes, label), len(nodes) - 1)
            part = np.where(nodes[at] == label, roots[at], label)
        entry = entry[np.lexsort((part[entry], key[entry]))]
        low, high = np.searchsorted(table, key[probe], "left"), np.searchsorted(table, key[probe], "right")
        hit = high > low
        probe, low, high = probe[hit], low[hit], high[hit]
        one = part[entry[low]] == part[entry[high - 1]]
        for i, j in _pairs(low[~one], high[~one]):
            check(probe[~one][i], entry[j])
        one &= part[entry[low]] != part[probe]
        probe, low, high = probe[one], low[one], high[one]
        for _ in range(large):  # of a connected value the first link will do
            if not len(probe):
                break
            near = _distance(fp, probe, entry[low]) <= most_bits
            keep(np.stack([label[probe[near]], label[entry[low[near]]]], 1))
            low = low + 1
            left = ~near & (low < high)
            probe, low, high = probe[left], low[left], high[left]
        for i, j in _pairs(low, high):
            check(probe[i], entry[j])
        e = thin(np.concatenate(edges))
        for k in range(0, len(e), 1 << 16):
            yield pa.record_batch([pa.array(e[k : k + (1 << 16), 0]), pa.array(e[k : k + (1 << 16), 1])], ["a", "b"])

    packed = reps.select("label", "fp").mapInArrow(lean(emit), "part int, label binary, fp binary, code binary")
    return packed.repartitionById(parts, "part").mapInArrow(lean(find), "a long, b long")


def near_components(fps: DataFrame, most_bits: int = 4, cut: list[Segment] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of fps (doc_id, fp). Without `cut` the segments are those for the number of distinct fingerprints."""
    ready(fps.sparkSession)
    fps = fps.checkpoint()
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("node")).checkpoint()
    cut = cut or segments(most_bits, reps.count())
    nodes = reps.where(F.col("node").isNotNull()).select(F.col("node").alias("label"), "fp")
    labels = components(links(nodes, most_bits, cut, words=1 + max(s[0] for s in cut)))
    owner = reps.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return fps.join(owner, "fp", "left").select("doc_id", "fp", "component_id")


def _key(text: bytes) -> bytes:
    """128 bits that tell word sequences apart; texts with the same one have the same shingles."""
    return xxhash.xxh128_digest(b" ".join(text.translate(_LOWER).split()), SEED)


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For every two of `sets` (each of distinct hashes) whether their Jaccard similarity is at least `similarity`."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    who = np.repeat(np.arange(n), sizes.astype(np.int64))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    kept = shared[column]
    who, column = who[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    both = np.zeros((n, n))
    for k in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, (k, k + 4096))
        has = np.zeros((n, 4096), np.float32)
        has[who[i:j], column[i:j] - k] = 1
        both += has @ has.T
    np.fill_diagonal(both, sizes)
    either = sizes[:, None] + sizes - both
    return (both >= similarity * either - 1e-9) & (both > 0)


def verified_links(members: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): a spanning forest, in each group, of the pairs of texts with at least `similarity`.

    members: (part, lot, doc_id, key, text); rows of one (part, lot) are compared, all with all. Rows whose
    text has another key belong to another row of that id and are left out.
    """
    parts = shuffle_partitions(ready(members.sparkSession))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[int, int], dict[tuple[int, bytes], bytes]] = {}
        for batch in batches:
            for part, lot, doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                groups.setdefault((part, lot), {})[doc, key] = (text or "").encode()
        found: list[tuple[int, int]] = []
        while groups:
            rows = sorted((k, t) for k, t in groups.popitem()[1].items() if _key(t) == k[1])
            if len(rows) < 2:
                continue
            near = alike([np.unique(shingles(t, size)) for _, t in rows], similarity)
            left = np.arange(len(rows))
            while len(left):
                front, left = [left[0]], left[1:]
                while front and len(left):
                    at = front.pop()
                    hit = near[at, left]
                    found += [(rows[at][0][0], rows[x][0][0]) for x in left[hit]]
                    front.extend(left[hit].tolist())
                    left = left[~hit]
        yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    rows = members.select("part", "lot", "doc_id", "key", "text")
    return rows.repartition(parts, "part", "lot").mapInArrow(lean(verify), "a long, b long")


def cover(n: int, flips: float, missed: float = 0.0055) -> tuple[int, int]:
    """(bits, segments): the width of the segments for n fingerprints, and how many of radius 1 leave out `missed` of the pairs at most.

    The width grows with log2(n), so a value has a bounded number of unrelated entries; the number of segments follows
    from the probability that a pair whose bits differ with probability `flips` agrees within the radius in one of them.
    """
    bits = min(32, max(16, ceil(log(max(n, 1), 2)) - 4))
    one = (1 - flips) ** bits * (1 + bits * flips / (1 - flips))
    return bits, ceil(log(missed) / log(1 - one))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, block: int = 256) -> DataFrame:
    """(doc_id, component_id): documents connected by pairs whose sets of `size`-word shingles have that Jaccard similarity or more.

    SimHash only finds candidates. Sets of equal size with Jaccard similarity s have the cosine
    2s / (1 + s), and a SimHash bit of theirs differs with probability arccos(cosine) / pi. The segments
    of `cover` lie in independent fingerprints of 128 bits each; each yields the pairs up to the 99 % quantile
    of the number of differing bits (28 for 0.8). Within each candidate component the shingle sets themselves are
    compared, and only pairs that reach `similarity` link.

    A component of more than `block` texts is compared in lots: every lot holds the component's first
    text too, and only if that leaves it in several pieces does every two lots' texts meet.
    """
    ready(docs.sparkSession)
    flips = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most_bits = int(128 * flips + 2.326 * np.sqrt(128 * flips * (1 - flips)))
    bits, needed = cover(docs.count(), flips)
    tables = ceil(needed / (2 * (64 // bits)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            fps = [_simhash(shingles(t, size), 2 * tables) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([_key(t) for t in texts], pa.binary()), pa.array(fps, pa.binary())], ["doc_id", "key", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(lean(work), "doc_id long, key binary, fp binary").checkpoint()
    units = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp")).where("doc_id IS NOT NULL").checkpoint()
    found = links(units.select(F.col("doc_id").alias("label"), "fp"), most_bits, even_segments(2 * tables, bits, 1), words=2)
    labels = components(found)
    give_back(docs.sparkSession)
    met = units.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("part")).checkpoint()
    sizes = met.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part", F.ceil(F.col("n") / block).cast("int").alias("lots")).checkpoint()
    members = met.join(sizes, "part").withColumn("own", F.pmod(F.xxhash64("key"), F.col("lots")).cast("int")).checkpoint()
    first = F.when(F.col("doc_id") == F.col("part"), F.sequence(F.lit(0), F.col("lots") - 1)).otherwise(F.array("own"))
    edges = verified_links(members.join(docs, "doc_id").withColumn("lot", F.explode(first)), size, similarity).checkpoint()
    give_back(docs.sparkSession)
    large = members.where("lots > 1")
    if not large.isEmpty():
        labels = components(edges).withColumnRenamed("node", "doc_id")
        pieces = large.join(labels, "doc_id", "left").groupBy("part").agg(F.min(F.coalesce("label", "doc_id")).alias("low"), F.max(F.coalesce("label", "doc_id")).alias("high"))
        split = pieces.where("low < high").select("part").checkpoint()
        # Lots i < j meet under the number i * lots + j.
        meet = F.expr("transform(filter(sequence(0, lots - 1), x -> x != own), x -> least(x, own) * bigint(lots) + greatest(x, own))")
        again = large.join(split, "part").join(docs, "doc_id").withColumn("lot", F.explode(meet))
        edges = edges.union(verified_links(again, size, similarity).checkpoint())
        give_back(docs.sparkSession)
    labels = components(edges).withColumnRenamed("node", "doc_id")
    owner = units.join(labels, "doc_id", "left").select("key", F.coalesce("label", "doc_id").alias("component_id"))
    return rows.join(owner, "key", "left").select("doc_id", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_components(fingerprints(docs, 4), 4)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
