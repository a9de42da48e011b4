"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most `capacity` tokens. All pieces of one length are alike, so the
packing problem is the histogram of lengths: at most `capacity` numbers, whatever the corpus, which
is all that the driver sees. There, bin completion fills sequences: depth first, each step takes the
largest length left, enumerates the undominated fillings of the room beside it, and uses one as often
as the counts allow; a branch is pruned when what it has wasted shows that it cannot beat the best
solution so far. Best-fit decreasing gives the first best solution, and the search goes on until the best
solution is proved (it meets the lower bound, or everything was tried) or a stated budget of steps is spent. The answer is a short list of (filling, how often).

The pieces then find their places in parallel: a piece's rank among the pieces of its length comes
from its rank in its partition plus a prefix sum over (partition, length) counts, and the rank falls
into one range of the list, which names sequence and offset.

Defined results: a null or empty text is a document of one token, the separator. Repeated rows are
packed one by one. An empty table gives no piece.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navloom.llm.bpe import Classes, Vocabulary, classes, default_path, encoder
from navloom.llm.sample import lean
from navloom.llm.text import blocks
from navloom.session import ready

CAPACITY = 2048


# --- the histogram problem ----------------------------------------------------------------------

Fillings = list[tuple[tuple[int, ...], int]]


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's L2 bound."""
    size = np.arange(len(count))
    half = capacity // 2
    items, volume = np.cumsum(count), np.cumsum(count * size)
    k = np.arange(1, half + 1)
    large, middle = items[-1] - items[capacity - k], items[capacity - k] - items[half]
    room = middle * capacity - (volume[capacity - k] - volume[half])
    over = volume[half] - volume[k - 1] - room
    return int(max(-(-volume[-1] // capacity), (large + middle + np.maximum(0, -(-over // capacity))).max(initial=0)))


def best_fit(count: np.ndarray, capacity: int) -> Fillings:
    """Best-fit decreasing on lengths with counts: each length goes into the fullest sequences it fits."""
    open_: dict[int, Fillings] = {}
    rooms: list[int] = []  # sorted

    def put(room: int, filling: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_[room].append((filling, times))

    for s in range(capacity, 0, -1):
        left = int(count[s])
        while left:
            at = bisect_right(rooms, s - 1)
            if at == len(rooms):
                each = min(capacity // s, left)
                put(capacity - each * s, (s,) * each, left // each)
                left -= each * (left // each)
                continue
            room = rooms[at]
            filling, times = open_[room].pop()
            used = min(times, left)
            if times > used:
                open_[room].append((filling, times - used))
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            put(room - s, (*filling, s), used)
            left -= used
    return [x for own in open_.values() for x in own]


def _smear(mask: int, low: int, high: int) -> int:
    """The bits of `mask` moved up by each of low..high."""
    out, width = mask << low, 1
    while width < high - low + 1:
        step = min(width, high - low + 1 - width)
        out |= out << step
        width += step
    return out


def fillings(count: list[int], room: int) -> Iterator[tuple[tuple[int, ...], bool]]:
    """All fillings of `room` by lengths with counts, least waste first, longer lengths first, and whether each is undominated.

    A filling is dominated if some of its lengths, two or more, fit into an unused length that takes their place within
    the waste, or one of them gives way to a longer one: whoever uses the other filling loses nothing.
    """
    sizes = [s for s in range(min(room, len(count) - 1), 0, -1) if count[s] > 0]
    limit = (1 << room + 1) - 1
    reach = [1]  # from each size on, the sums that smaller ones can make
    for s in reversed(sizes):
        sums, left, each = reach[-1], min(count[s], room // s), 1
        while left:
            use = min(each, left)
            sums |= (sums << s * use) & limit
            left, each = left - use, each * 2
        reach.append(sums)
    reach.reverse()

    def exact(at: int, total: int, used: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not total:
            yield used
            return
        for j in range(at, len(sizes)):
            if not reach[j] >> total & 1:
                return
            s = sizes[j]
            for k in range(min(count[s], total // s), 0, -1):
                if reach[j + 1] >> (total - k * s) & 1:
                    yield from exact(j + 1, total - k * s, (*used, *(s,) * k))

    for waste in range(room + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        for x in exact(0, room - waste, ()):
            unused = sum(1 << s for s in sizes if s > x.count(s) and count[s] > x.count(s)) if x else sum(1 << s for s in sizes)
            one, more = 0, 0  # sums of one and of two or more of x
            for s in x:
                more |= (one << s) | (more << s)
                one |= 1 << s
            better = _smear(one, 1, waste) if waste else 0
            yield x, not unused & (better | _smear(more, 0, waste)) and not (not x and unused)


class Packing(NamedTuple):
    """A list of (filling, how often) that uses every piece once; no packing has fewer than `bound` sequences."""

    fillings: Fillings
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)


def complete(count: np.ndarray, capacity: int, most_steps: int = 50_000) -> Packing:
    """Bin completion, depth first: the largest length left, every undominated filling beside it, as often as possible, then less often.

    The search ends with a proof: when the best solution meets the lower bound, or when nothing is left to try (then the
    best solution is the bound). `most_steps` is the budget of fillings that are looked at; where it ends the search, the
    result is the best solution so far with the bound that is known. Choices are undone in place, so memory is that of
    one path and of the states seen.
    """
    best = best_fit(count, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(count, capacity)
    left, size, used, path, steps = count.copy(), np.arange(len(count)), 0, [], 0
    seen: dict[bytes, int] = {}

    def choices() -> Iterator[tuple[tuple[int, ...], int] | None]:
        """(filling, how often) of the present state, None for one that is left out."""
        s = int(np.flatnonzero(left)[-1])
        left[s] -= 1
        own = left.tolist()
        left[s] += 1
        for x, undominated in fillings(own, capacity - s):
            if not undominated:
                yield None
                continue
            which, often = np.unique((s, *x), return_counts=True)
            for times in range(int((left[which] // often).min()), 0, -1):
                yield (s, *x), times

    stack = [choices()] if fewest > bound else []
    while stack and fewest > bound and steps < most_steps:
        got = next(stack[-1], False)
        if got is False:
            stack.pop()
            if path:
                filling, times = path.pop()
                np.add.at(left, list(filling), times)
                used -= times
            continue
        steps += 1
        if got is None:
            continue
        filling, times = got
        np.subtract.at(left, list(filling), times)
        used += times
        rest = int(left @ size)
        if not rest:
            if used < fewest:
                best, fewest = [*path, got], used
        elif used + lower_bound(left, capacity) < fewest:  # the waste so far leaves room to win
            state = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
            if seen.get(state, fewest) > used:
                seen[state] = used
                path.append(got)
                stack.append(choices())
                continue
        np.add.at(left, list(filling), times)
        used -= times
    return Packing(best, bound if stack and fewest > bound else fewest)


def places(solution: Fillings) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: pieces of that length from that rank on, one a sequence."""
    rows, sequence, rank = [], 0, {}
    for filling, times in solution:
        offset = 0
        for s in filling:
            first = rank.get(s, 0)
            rows.append((s, first, sequence, offset))
            rank[s] = first + times
            offset += s
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# --- documents ---------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _fast(path: str, own: Classes):
    """The installed compiled BPE over the same tokens and classes: the same ids, for the many that only need to be counted and summed."""
    import tiktoken

    v = Vocabulary(path)
    return tiktoken.Encoding("own", pat_str=own.pattern(r"\x{%x}"), mergeable_ranks={t: i for i, t in v.token.items()}, special_tokens=v.special)


def token_bytes(path: str, own: Classes, text: str, longest: int = 100_000) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers.

    The compiled BPE gives up on unbroken runs of millions of characters (white space above all), so a text is cut at
    single spaces between other characters, where no piece and no special token crosses, and a part of more than
    `longest` characters that has no such place goes through the linear-time encoder. Both give the library's ids.
    """
    fast = _fast(path, own)
    if len(text) <= longest:
        return np.asarray(fast.encode_to_numpy(text, allowed_special="all")).astype("<u4").tobytes()
    slow, out, at = encoder(path, own), [], 0
    while at < len(text):
        end = len(text)
        if end - at > longest and not slow.whole_only:
            end = next((m.start() for m in slow.cut.finditer(text, at + longest // 2)), end)
        part = text[at:end]
        out.append(np.asarray(fast.encode_to_numpy(part, allowed_special="all")).astype("<u4").tobytes() if len(part) <= longest else slow.encode(part))
        at = end
    return b"".join(out)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, path: str | None = None) -> DataFrame:
    """PIECES and (part, rank): the pieces of every document, with the rank among those of its length in its partition.

    A document is its ids and the separator. One longer than `capacity` is cut into pieces of `capacity`,
    of which the first may be shorter. Checkpointed, so that partitions and ranks stay as they are.
    """
    ready(docs.sparkSession)
    path = path or default_path()
    own = classes(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([separator], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for block in blocks(batches, "text"):
            rows = []
            for doc, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                ids = token_bytes(path, own, text or "") + end
                n = len(ids) // 4
                start, k = 0, 0
                while start < n:
                    size = (n % capacity or capacity) if start == 0 else capacity
                    rows.append((doc, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), part, int(seen[size])))
                    seen[size] += 1
                    start, k = start + size, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(work), PIECES + ", part int, rank long").checkpoint()


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PIECES and sequence_id, offset for pieces as made by `pieces`."""
    spark = ready(found.sparkSession)
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n")).checkpoint()
    count = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # at most `capacity` rows
        count[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(places(complete(count, capacity).fillings))  # a few places for each length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        first = np.searchsorted(t[:, 0], np.arange(capacity + 2))
        for batch in batches:
            size, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = t[first[s] : first[s + 1]]
                mine = np.flatnonzero(size == s)
                at = np.searchsorted(own[:, 1], rank[mine], "right") - 1
                sequence[mine], offset[mine] = own[at, 2] + rank[mine] - own[at, 1], own[at, 3]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    rows = found.join(counts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return rows.mapInArrow(lean(place), PIECES + ", sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
