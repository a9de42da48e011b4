"""Media columns: lossless FLAC streams, their decoding, and PCM blocks with seekable sample offsets.

Encoding: a payload of bytes becomes one channel of 8-bit samples in frames of 576. Every frame is
written as a constant, as a fixed predictor of order 0 to 4, as a quantised linear predictor of order
4, or verbatim, whichever is shortest, with Rice-coded residuals. The one seek table has a point for every
frame, or for every k-th frame of a stream whose frames are more than a table can list.

Decoding starts from the stream's bytes alone. The seek table gives the offset of every frame, so
the frames of many streams are decoded in lock step: one numpy operation advances all of them by one
sample, a bounded number of frames at a time; frames between two seek points are found by their headers and
checksums. The samples are written as PCM blocks, each with the offset of its first sample. Frame headers are checked (sync, number, CRC-8), every frame's CRC-16 is verified, the end
of each frame must be the start of the next, and the MD5 of the samples must be the one in the header.
The decoder takes any Rice partition order, 4- and 5-bit parameters, escaped (raw) partitions, all fixed
orders and linear predictors of any order; several channels and other sample sizes are refused.

Defined results: a null text is an empty text, whose payload is one block of 576 bytes of 255; equal
texts give equal streams. Repeated rows get the same result. A null stream has null payload, blocks and
feature. A damaged stream raises FlacError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.text import blocks
from navloom.session import ready

BLOCK = 576
RATE = 8000
POINTS = 900_000  # seek points at most: a metadata block has less than 2**24 bytes, a point 18
FRAMES = 4096  # that are decoded at a time
PCM_FRAMES = 64  # in a PCM block
_LPC_ORDER, _LPC_BITS, _LPC_SHIFT = 4, 9, 7


class FlacError(ValueError):
    """A stream that is no FLAC stream of this kind, or a damaged one."""


# --- checksums ----------------------------------------------------------------------------------


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    """The table of a most-significant-bit-first CRC, by rule."""
    out = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    top, mask = np.uint32(1 << (bits - 1)), np.uint32((1 << bits) - 1)
    for _ in range(8):
        out = np.where(out & top, (out << np.uint32(1)) ^ np.uint32(polynomial), out << np.uint32(1)) & mask
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each run of bytes, all runs in lock step; leading zeros leave a CRC of 0 alone, so runs are aligned at their ends."""
    table, most = (_CRC8, int(size.max(initial=0))) if bits == 8 else (_CRC16, int(size.max(initial=0)))
    crc = np.zeros(len(start), np.uint32)
    for k in range(most, 0, -1):
        inside = size >= k
        byte = np.where(inside, data[np.where(inside, start + size - k, 0)], 0).astype(np.uint32)
        crc = table[crc ^ byte] if bits == 8 else table[(crc >> np.uint32(8)) ^ byte] ^ ((crc << np.uint32(8)) & np.uint32(0xFFFF))
    return crc


# --- encoding -----------------------------------------------------------------------------------


def _number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8 like code: (bytes in 7 columns, how many)."""
    n = n.astype(np.int64)
    size = np.ones(len(n), np.int64)
    for k, least in enumerate((1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31), 2):
        size[n >= least] = k
    out = np.zeros((len(n), 7), np.int64)
    for k in range(7):
        left = 6 * (size - 1 - k)
        lead = np.where(size == 1, n, ((0xFF00 >> size) & 0xFF) | (n >> np.maximum(6 * (size - 1), 0)))
        more = 0x80 | ((n >> np.maximum(left, 0)) & 0x3F)
        out[:, k] = np.where(k < size, lead if k == 0 else more, 0)
    return out, size


def _lpc(x: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients of each frame (Levinson-Durbin on the windowed samples)."""
    n = x.shape[1]
    w = x * np.hanning(n + 2)[1:-1].astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", w[:, k:], w[:, : n - k]) for k in range(_LPC_ORDER + 1)], 1).astype(np.float64)
    a, error = np.zeros((len(x), _LPC_ORDER)), r[:, 0] + 1e-9
    for i in range(_LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        before = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = 1 << (_LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << _LPC_SHIFT)), -top, top - 1).astype(np.int32)


_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _rice(u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best Rice parameter, bits) of each row of n zigzag residuals."""
    guess = np.floor(np.log2(np.maximum(u.sum(1, dtype=np.int64) / n * 0.7, 1))).astype(np.int32)
    best, bits = np.zeros(len(u), np.int32), np.full(len(u), 1 << 60)
    for step in (0, 1):
        k = np.minimum(guess + step, 14)
        cost = (u >> k[:, None]).sum(1, dtype=np.int64) + n * (1 + k)
        best, bits = np.where(cost < bits, k, best), np.minimum(bits, cost)
    return best, bits


def encode_frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the frames for rows of 576 signed 8-bit samples with these frame numbers."""
    done = [_encode_some(samples[i : i + 1024], number[i : i + 1024]) for i in range(0, len(samples), 1024)]
    size = np.concatenate([np.diff(offset) for _, offset in done])
    return np.concatenate([data for data, _ in done]), np.concatenate([[0], np.cumsum(size)])


def _encode_some(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = samples.astype(np.int32)
    f = len(x)
    # Each frame's predictor is the one with the smallest mean residual: kind 0 to 4 fixed, 5 linear.
    # Then 6 is verbatim, if that is shorter, and 7 constant.
    coefficients = _lpc(samples.astype(np.float32))
    predicted = np.zeros((f, BLOCK - _LPC_ORDER), np.int32)
    for j in range(_LPC_ORDER):
        predicted += coefficients[:, j, None] * x[:, _LPC_ORDER - 1 - j : BLOCK - 1 - j]
    linear = x[:, _LPC_ORDER:] - (predicted >> _LPC_SHIFT)
    residual, least, kind = x.copy(), np.abs(linear).mean(1) * 1.02 + 0.02, np.full(f, 5)
    residual[:, _LPC_ORDER:] = linear
    e = samples.astype(np.int16)  # order 4 stays below 16 * 256
    for order in range(5):
        if order:
            e = e[:, 1:] - e[:, :-1]
        size = np.abs(e).mean(1, dtype=np.float32)
        better = np.flatnonzero(size <= least)
        residual[better, :order] = x[better, :order]
        residual[better, order:] = e[better]
        least[better], kind[better] = size[better], order
    order = np.minimum(kind, 4)
    place = np.arange(BLOCK)
    warm = place < order[:, None]
    u = (residual << 1) ^ (residual >> 31)
    u[warm] = 0
    k, bits = _rice(u, BLOCK - order)
    bits += 8 * order + 10 + (9 + _LPC_BITS * _LPC_ORDER) * (kind == 5)
    kind[bits >= 8 * BLOCK] = 6
    kind[(samples == samples[:, :1]).all(1)] = 7
    lpc, coded, raw = kind == 5, kind <= 5, kind == 6
    order[~coded] = 0
    # Every frame is one row of fields: (value, significant bits), and how long the field is with its leading zeros.
    columns: list[tuple[np.ndarray, np.ndarray]] = []

    def field(value, bits, used=True):
        columns.append((np.where(used, value, 0), np.broadcast_to(np.where(used, bits, 0), (f,))))

    utf, size = _number_bytes(number)
    head = [np.full(f, 0xFF), np.full(f, 0xF8), np.full(f, 0x20), np.full(f, 0x02), *utf.T]
    inside = [np.ones(f, bool)] * 4 + [c < size for c in range(7)]
    crc = np.zeros(f, np.uint32)
    for byte, use in zip(head, inside, strict=True):
        crc = np.where(use, _CRC8[crc ^ byte.astype(np.uint32)], crc)
        field(byte, 8, use)
    field(crc, 8)
    field(np.select([kind <= 4, lpc, raw], [8 + kind, 32 + _LPC_ORDER - 1, 1], 0) << 1, 8)
    for j in range(4):
        field(x[:, j] & 255, 8, (j < order) | ((kind == 7) & (j == 0)))
    field(((_LPC_BITS - 1) << 5) | _LPC_SHIFT, 9, lpc)
    for j in range(_LPC_ORDER):
        field(coefficients[:, j] & ((1 << _LPC_BITS) - 1), _LPC_BITS, lpc)
    field(k, 10, coded)
    n = len(columns)
    value, significant = np.empty((f, n + BLOCK), np.int32), np.empty((f, n + BLOCK), np.int32)
    for j, (v, b) in enumerate(columns):
        value[:, j], significant[:, j] = v, b
    shift = k[:, None]
    low = (np.int32(1) << shift)
    value[:, n:] = low | (u & (low - 1))
    significant[:, n:] = shift + 1
    whole = significant.copy()
    whole[:, n:] += u >> shift
    other = np.flatnonzero(~coded)
    value[other, n:], significant[other, n:] = x[other] & 255, np.where(raw[other], 8, 0)[:, None]
    whole[other, n:] = significant[other, n:]
    significant[:, n:][warm & coded[:, None]] = 0
    whole[:, n:][warm & coded[:, None]] = 0
    ends = np.cumsum(whole, 1, dtype=np.int32)
    length = (ends[:, -1].astype(np.int64) + 7) // 8
    offset = np.concatenate([[0], np.cumsum(length + 2)])
    at = (ends - significant + 8 * offset[:-1, None]).ravel()
    value, significant = value.ravel(), significant.ravel()
    some = significant > 0
    at, value, significant = at[some], value[some].astype(np.int64), significant[some]
    # 16-bit words: a field of at most 16 bits touches two of them, and no two fields share a bit.
    value <<= 32 - (at & 15) - significant
    word = at >> 4
    most = int(offset[-1] // 2 + 2)
    out = np.bincount(word, value >> 16, most) + np.bincount(word + 1, value & 0xFFFF, most)
    out = out.astype(">u2").view(np.uint8)[: offset[-1]].copy()
    crc = _crc(out, offset[:-1], length, 16)
    out[offset[1:] - 2], out[offset[1:] - 1] = crc >> 8, crc & 255
    return out, offset


def pad(data: bytes) -> bytes:
    """The payload: the bytes and 255s up to a positive multiple of the block size."""
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


_POINT = [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (a positive multiple of 576 bytes)."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    samples = (joined.astype(np.int16) - 128).astype(np.int8).reshape(-1, BLOCK)
    frames = np.array([len(p) // BLOCK for p in payloads])
    first = np.concatenate([[0], np.cumsum(frames)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], frames)
    data, offset = encode_frames(samples, number)
    out = []
    for i in range(len(payloads)):
        a, b = first[i], first[i + 1]
        sizes = np.diff(offset[a : b + 1])
        info = (
            BLOCK.to_bytes(2, "big") * 2
            + int(sizes.min()).to_bytes(3, "big")
            + int(sizes.max()).to_bytes(3, "big")
            + ((RATE << 44) | (0 << 41) | (7 << 36) | (int(b - a) * BLOCK)).to_bytes(8, "big")
            + hashlib.md5(samples[a:b].tobytes()).digest()
        )
        step = -(-int(b - a) // POINTS)
        points = np.zeros(len(range(0, b - a, step)), _POINT)
        points["sample"], points["offset"], points["size"] = np.arange(0, b - a, step) * BLOCK, offset[a:b:step] - offset[a], BLOCK
        table = points.tobytes()
        head = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
        out.append(head + data[offset[a] : offset[b]].tobytes())
    return out


# --- decoding -----------------------------------------------------------------------------------


def _header(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(samples, MD5, frame offsets, start of the frames) of a stream."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, samples, md5, points = 4, False, None, b"", None
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata ends early")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if len(body) != size:
            raise FlacError("metadata ends early")
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            if body[:4] != BLOCK.to_bytes(2, "big") * 2 or (word >> 41) & 7 or (word >> 36) & 31 != 7:
                raise FlacError("not one channel of 8-bit samples in blocks of 576")
            samples, md5 = word & ((1 << 36) - 1), body[18:34]
            least, most = int.from_bytes(body[4:7], "big"), int.from_bytes(body[7:10], "big")
        elif kind == 3 and points is not None:
            raise FlacError("more than one seek table")
        elif kind == 3:
            points = np.frombuffer(body[: size - size % 18], _POINT)
        at += 4 + size
    if samples is None or points is None or not samples or samples % BLOCK:
        raise FlacError("no stream information or seek table, or no whole blocks")
    points = points[points["sample"] != 2**64 - 1]  # placeholders
    frames, step = samples // BLOCK, max(1, -(-samples // BLOCK // max(len(points), 1)))
    if len(points) != len(range(0, frames, step)) or (points["sample"] != np.arange(0, frames, step) * BLOCK).any() or (points["size"] != BLOCK).any():
        raise FlacError("the seek table does not list every frame, or every k-th")
    offsets = _between(stream, points["offset"].astype(np.int64) + at, frames, step)
    if offsets[0] != at or offsets[-1] >= len(stream) or (sizes := np.diff(np.append(offsets, len(stream)))).min() != least or sizes.max() != most:
        raise FlacError("the frames are not as long as the stream information says")
    return samples, md5, offsets, at


def _between(stream: bytes, points: np.ndarray, frames: int, step: int) -> np.ndarray:
    """The offsets of all frames, those between seek points by their headers: a header starts a frame if the bytes before it have their CRC-16."""
    if step == 1:
        return points
    data, out = np.frombuffer(stream, np.uint8), np.zeros(frames, np.int64)
    out[::step] = points
    for i in np.flatnonzero(np.arange(frames) % step):
        utf, size = (x[0] for x in _number_bytes(np.array([i])))
        header = b"\xff\xf8\x20\x02" + bytes(utf[:size].astype(np.uint8).tolist())
        header += bytes([int(_crc(np.frombuffer(header, np.uint8), np.zeros(1, np.int64), np.array([len(header)]), 8)[0])])
        before, at = out[i - 1], int(out[i - 1]) + 9
        while True:
            at = stream.find(header, at)
            if at < 0:
                raise FlacError("a frame is missing")
            crc = _crc(data, np.array([before]), np.array([at - before - 2]), 16)[0]
            if crc == int.from_bytes(stream[at - 2 : at], "big"):
                break
            at += 1
        out[i] = at
    return out


class _Bits:
    """Bit cursors into one run of bytes, one for each frame."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,)).astype(np.uint64)
        self.at, self.end = at.astype(np.int64) * 8, 8 * len(data)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, at the top of 64."""
        return self.words[np.minimum(at, self.end) >> 3] << (at & 7).astype(np.uint64)

    def read(self, bits, which=None) -> np.ndarray:
        """The next `bits` (0 to 32) of each frame, or of those in `which`."""
        at = self.at if which is None else self.at[which]
        bits = np.broadcast_to(np.asarray(bits, np.int64), at.shape)
        got = (self.peek(at) >> np.uint64(1)) >> (63 - bits).astype(np.uint64)
        if which is None:
            self.at = self.at + bits
        else:
            self.at[which] += bits
        return got.astype(np.int64)

    def read_signed(self, bits, which=None) -> np.ndarray:
        got = self.read(bits, which)
        bits = np.broadcast_to(np.asarray(bits, np.int64), got.shape)
        return got - ((got >> np.maximum(bits - 1, 0) & 1) << bits)

    def rice(self, at: np.ndarray, k: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(zigzag residuals, places after them) of the codes with parameters k at these places; left is 63 - k."""
        word = self.words[at >> 3] << (at & 7).view(np.uint64)
        # The top 46 bits are surely of the stream, and 53 are exact as floating point.
        lead = 53 - np.frexp((word >> np.uint64(11)).astype(np.float64))[1]
        if (lead + k > 45).any():
            return self._long(at, k)
        after = at + (lead + 1)
        low = ((word << (lead + 1).astype(np.uint64)) >> np.uint64(1)) >> left
        return (lead << k) | low.view(np.int64), after + k

    def _long(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where some code may be long."""
        at, zeros = at.copy(), np.zeros(len(at), np.int64)
        word = self.peek(at) >> np.uint64(11)
        empty = np.flatnonzero(word >> np.uint64(7) == 0)
        while len(empty):
            if (at[empty] > self.end).any():
                raise FlacError("a frame ends early")
            zeros[empty] += 46
            at[empty] += 46
            word[empty] = self.peek(at[empty]) >> np.uint64(11)
            empty = empty[word[empty] >> np.uint64(7) == 0]
        lead = 53 - np.frexp(word.astype(np.float64))[1]
        at += lead + 1
        low = (self.peek(at) >> np.uint64(1)) >> (63 - k).astype(np.uint64)
        return ((zeros + lead) << k) | low.astype(np.int64), at + k


def decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The samples (int8, a row for each frame) of frames at data[start:end] with these numbers; everything is verified."""
    f = len(start)
    if (end > len(data)).any() or (end - start < 9).any():
        raise FlacError("a frame ends early")
    crc = _crc(data, start, end - start - 2, 16)
    if (crc != (data[end - 2].astype(np.uint32) << np.uint32(8) | data[end - 1])).any():
        raise FlacError("a frame's CRC-16 is wrong")
    utf, size = _number_bytes(number)
    expected = [np.full(f, 0xFF), np.full(f, 0xF8), np.full(f, 0x20), np.full(f, 0x02), *utf.T]
    for c, byte in enumerate(expected):
        use = c < 4 + size
        if (data[np.minimum(start + c, len(data) - 1)][use] != byte[use]).any():
            raise FlacError("a frame header is wrong")
    if (_crc(data, start, 4 + size, 8) != data[start + 4 + size]).any():
        raise FlacError("a frame header's CRC-8 is wrong")
    bits = _Bits(data, start + 5 + size)
    kind = bits.read(8)
    if (kind & 0x81).any():
        raise FlacError("a subframe header is wrong")
    kind >>= 1
    constant, verbatim, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise FlacError("a reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    x = np.zeros((BLOCK, f), np.int64)
    at = np.flatnonzero(constant)
    x[:, at] = bits.read_signed(8, at)
    at = np.flatnonzero(verbatim)
    if len(at):
        for i in range(BLOCK):
            x[i, at] = bits.read_signed(8, at)
    which = np.flatnonzero(fixed | linear)
    if len(which):
        _predicted(bits, x, which, order, linear)
    if ((bits.at + 7) // 8 + 2 != end).any():
        raise FlacError("a frame does not end where the next begins")
    if (x < -128).any() or (x > 127).any():
        raise FlacError("a sample has more than 8 bits")
    return np.ascontiguousarray(x.T.astype(np.int8))


def _predicted(bits: _Bits, x: np.ndarray, which: np.ndarray, order: np.ndarray, linear: np.ndarray) -> None:
    """Rice residuals and prediction of the frames `which`, one sample of all of them at a time."""
    most = int(order[which].max(initial=0))
    for i in range(most):
        at = which[order[which] > i]
        x[i, at] = bits.read_signed(8, at)
    weight, shift = np.zeros((max(most, 4), x.shape[1]), np.int64), np.zeros(x.shape[1], np.int64)
    for o in range(1, 5):
        at = which[~linear[which] & (order[which] == o)]
        weight[:o, at] = np.array(_FIXED[o])[:, None]
    at = which[linear[which]]
    if len(at):
        precision = bits.read(4, at) + 1
        shift[at] = bits.read_signed(5, at)
        if (precision == 16).any() or (shift < 0).any():
            raise FlacError("reserved predictor parameters")
        for j in range(most):
            own = order[at] > j
            weight[j, at[own]] = bits.read_signed(precision[own], at[own])
    method, partitions = bits.read(2, which), bits.read(4, which)
    if (method > 1).any() or (BLOCK % (1 << partitions)).any():
        raise FlacError("reserved residual coding")
    each = BLOCK >> partitions
    k, smallest = np.zeros(len(which), np.int64), int(each.min())
    own_order = order[which]
    weight, shift = weight[:, which], shift[which]
    out, at, far = x[:, which], bits.at[which], bits.end
    left = (63 - k).astype(np.uint64)
    raw = np.full(len(which), -1)  # bits of a sample in an escaped partition
    for i in range(BLOCK):
        if i % smallest == 0:
            new = np.flatnonzero(i % each == 0)
            bits.at[which] = at
            k[new] = bits.read(4 + method[new], which[new])
            escaped = new[k[new] == np.where(method[new] == 1, 31, 15)]
            raw[new] = -1
            raw[escaped], k[escaped] = bits.read(5, which[escaped]), 0
            at = bits.at[which]
            left = (63 - k).astype(np.uint64)
            if (at > far).any():
                raise FlacError("a frame ends early")
        if i < most or (raw >= 0).any():
            on = np.flatnonzero((own_order <= i) & (raw < 0))
            plain = np.flatnonzero((own_order <= i) & (raw >= 0))
            u, at[on] = bits.rice(at[on], k[on], left[on])
        else:
            on, plain = slice(None), None
            u, at = bits.rice(np.minimum(at, far), k, left)
        total = np.zeros(len(which), np.int64)
        for j in range(min(most, i)):
            total += weight[j] * out[i - 1 - j]
        total >>= shift
        out[i, on] = ((u >> 1) ^ -(u & 1)) + total[on]
        if plain is not None and len(plain):
            bits.at[which[plain]] = np.minimum(at[plain], far)
            out[i, plain] = bits.read_signed(raw[plain], which[plain]) + total[plain]
            at[plain] = bits.at[which[plain]]
    bits.at[which] = at
    x[:, which] = out


def _samples(data: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> Iterator[np.ndarray]:
    """The samples of frames, FRAMES of them at a time."""
    for i in range(0, len(start), FRAMES):
        a, b = start[i : i + FRAMES], end[i : i + FRAMES]
        low = int(a[0])
        yield decode_frames(data[low : int(b[-1])], a - low, b - low, number[i : i + FRAMES])


def _pcm(samples: np.ndarray) -> bytes:
    return (samples.view(np.uint8) ^ np.uint8(128)).tobytes()


def decode_blocks(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """The PCM blocks (first sample, bytes) of each stream, in order; frames of short streams are decoded together. The MD5 is verified."""
    parsed = [_header(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    start = np.concatenate([p[2] + b for p, b in zip(parsed, base, strict=False)])
    end = np.concatenate([np.append(p[2][1:], len(s)) + b for p, s, b in zip(parsed, streams, base, strict=False)])
    frames = [len(p[2]) for p in parsed]
    number = np.concatenate([np.arange(n) for n in frames])
    data = np.frombuffer(streams[0] if len(streams) == 1 else b"".join(streams), np.uint8)
    out: list[list[tuple[int, bytes]]] = [[]]
    digest, done = hashlib.md5(), 0
    for got in _samples(data, start, end, number):
        at = 0
        while at < len(got):
            n = min(len(got) - at, frames[len(out) - 1] - done, PCM_FRAMES - done % PCM_FRAMES)
            own = got[at : at + n]
            digest.update(own)
            if done % PCM_FRAMES:
                out[-1][-1] = (out[-1][-1][0], out[-1][-1][1] + _pcm(own))
            else:
                out[-1].append((done * BLOCK, _pcm(own)))
            at, done = at + n, done + n
            if done == frames[len(out) - 1]:
                if digest.digest() != parsed[len(out) - 1][1]:
                    raise FlacError("the MD5 of the samples is wrong")
                digest, done = hashlib.md5(), 0
                out.append([])
    return out[:-1]


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream."""
    return [b"".join(x for _, x in own) for own in decode_blocks(streams)] if streams else []


def pcm_blocks(stream: bytes, from_sample: int = 0, to_sample: int | None = None) -> list[tuple[int, bytes]]:
    """(first sample, PCM bytes) of the PCM blocks that hold samples from_sample to to_sample; only their frames are decoded."""
    samples, _, offsets, _ = _header(stream)
    to_sample = samples if to_sample is None else min(to_sample, samples)
    if from_sample >= to_sample:
        return []
    size = BLOCK * PCM_FRAMES
    a, b = from_sample // size * PCM_FRAMES, min(-(-to_sample // size) * PCM_FRAMES, len(offsets))
    ends = np.append(offsets[1:], len(stream))
    got = _samples(np.frombuffer(stream, np.uint8), offsets[a:b], ends[a:b], np.arange(a, b))
    return [(a * BLOCK + j * FRAMES * BLOCK + i * BLOCK, _pcm(x[i : i + PCM_FRAMES])) for j, x in enumerate(got) for i in range(0, len(x), PCM_FRAMES)]


def feature(payload: bytes) -> str:
    """Integer features of the decoded samples: sum of squares, sign changes, peak, and 8 bands of sample values."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    value = np.arange(256) - 128
    changes = int(np.count_nonzero((x[1:] ^ x[:-1]) & 128))
    peak = int(np.abs(value[counts > 0]).max(initial=0))
    return f"energy={int((counts * value * value).sum())};changes={changes};peak={peak};bands={','.join(map(str, counts.reshape(8, 32).sum(1).tolist()))}"


# --- Spark --------------------------------------------------------------------------------------


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a FLAC stream."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 21):
            data = [x or b"" for x in block.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([block.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(encode([pad(x) for x in data]), pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, n_bytes long, media binary")


def read_media(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, blocks, feature): the streams decoded and verified.

    The payload is written as one run of PCM blocks; blocks is the offset of the first sample of each, which with one
    byte a sample is also its place in the payload.
    """
    ready(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media", 1 << 21):
            streams = block.column(2).to_pylist()
            found = iter(decode_blocks([s for s in streams if s is not None]) if any(s is not None for s in streams) else [])
            pcm = [next(found) if s is not None else None for s in streams]
            payloads = [b"".join(x for _, x in own) if own is not None else None for own in pcm]
            new = [pa.array(payloads, pa.binary()), pa.array([[a for a, _ in own] if own is not None else None for own in pcm], pa.list_(pa.int64())), pa.array([feature(p) if p is not None else None for p in payloads], pa.string())]
            yield pa.record_batch([*block.columns, *new], [*block.schema.names, "payload", "blocks", "feature"])

    return rows.select("doc_id", "n_bytes", "media").mapInArrow(work, "doc_id long, n_bytes long, media binary, payload binary, blocks array<long>, feature string")


def write_pcm(rows: DataFrame) -> DataFrame:
    """(doc_id, sample, pcm): a row for each PCM block of every stream; a null stream has none."""
    ready(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media", 1 << 21):
            for doc, stream in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                found = decode_blocks([stream])[0] if stream is not None else []
                yield pa.record_batch([pa.array([doc] * len(found), pa.int64()), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["doc_id", "sample", "pcm"])

    return rows.select("doc_id", "media").mapInArrow(work, "doc_id long, sample long, pcm binary")


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's stream and of the payload read back from it."""
    rows = read_media(media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
