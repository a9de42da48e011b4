"""BPE, packing, WARC and FLAC: exact against libraries, brute force and round trips."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from navloom.llm import bpe, media, packing, warc
from tests.conftest import SF
from tests.llm.test_text_operators import ODD, empty_docs, odd_docs

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
STRANGE = ["   ", "a  b", "\n\n x\n", "é" * 50, "<|endoftext|>", "foo <|endoftext|> bar<|endoftext|><|endoftext|>", "a\x1cb \x1c c", "a\x85 b  c　d", "don't I'll 's 're", "\r\n\t x", "😀😀 👩‍👩‍👧 क्षि ١٢٣ ½", "a" * 3000, "ab" * 2000, " " * 500, "aaa " * 30, "0123456789" * 30]


def strange_texts():
    rng = random.Random(1)
    letters = "ab c\n\t'stre é😀<|>endoftx1²\x1c\x85 　"
    return [t or "" for t in ODD] + STRANGE + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]


# --- BPE ---


def test_encoding_equals_the_library():
    enc = bpe.encoder(bpe.default_path())
    for t in strange_texts():
        ids = np.frombuffer(enc.encode(t), "<u4")
        assert ids.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t[:80]
        assert enc.vocabulary.decode(ids).decode("utf-8", "replace") == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_every_code_point_next_to_letters_digits_and_apostrophes():
    """Both encoders give the library's ids whatever Unicode version stands behind its pattern."""
    path = bpe.default_path()
    own = bpe.classes(path)
    enc = bpe.encoder(path, own)
    points = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x32000), *range(0x32000, 0x110000, 97), *range(0xE0000, 0xE0200))]  # every assigned one
    texts = ["".join(f"{x}'s1{x} {x}'t\n" for x in points[i : i + 512]) for i in range(0, len(points), 512)]
    for t, e in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        expected = np.array(e.ids, "<u4").tobytes()
        assert enc.encode(t) == expected == packing.token_bytes(path, own, t), hex(ord(t[0]))


@pytest.mark.parametrize("text", ["\u0558's" * 30000, " " * 150_000 + "a", "a" * 120_000, "\u0558's " * 40000, "x \n" * 50000, "<|endoftext|> " * 12000])
def test_long_texts_are_encoded_like_short_ones(text):
    path = bpe.default_path()
    own = bpe.classes(path)
    expected = np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert bpe.encoder(path, own).encode(text) == expected == packing.token_bytes(path, own, text) == packing.token_bytes(path, own, text, 1000)


def test_decoding_of_odd_ids(spark):
    rows = spark.createDataFrame([([-1, 64, None, 10**9, 65],), (None,), ([],), ([None],)], "ids array<long>")
    assert [r["decoded"] for r in bpe.decode(rows).collect()] == ["ab", "", "", ""]


def test_compatibility_by_merging():
    """A pair is compatible exactly if encoding the joined bytes gives that pair."""
    v = bpe.encoder(bpe.default_path()).vocabulary
    rng = random.Random(2)
    ids = [i for i in v.rank if len(v.token[i]) <= 6]

    def merge(data):
        tokens = [v.byte[b] for b in data]
        while True:
            best = min(((v.pair[p][0], i) for i, p in enumerate(itertools.pairwise(tokens)) if p in v.pair), default=None)
            if best is None:
                return tokens
            i = best[1]
            tokens[i : i + 2] = [v.pair[tokens[i], tokens[i + 1]][1]]

    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert v.compatible(a, b) == (merge(v.token[a] + v.token[b]) == [a, b])


def test_op8_rows(spark):
    rows = bpe.op8_bpe(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        ids = LIBRARY.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())


def test_encode_and_decode_columns(spark):
    docs = odd_docs(spark).withColumnRenamed("score", "ids")
    back = bpe.decode(bpe.encode(docs)).collect()
    assert len(back) == docs.count() and all(r["decoded"] == (r["text"] or "") for r in back)
    assert bpe.decode(bpe.encode(empty_docs(spark))).count() == 0 and bpe.round_trip(empty_docs(spark)).count() == 0


def test_memory_is_bounded():
    m = bpe.Remembered(len, 10)
    assert [m[str(i)] for i in range(100)] == [len(str(i)) for i in range(100)] and len(m) <= 10 and len(m.old) <= 10
    assert m["x" * 100] == 100 and "x" * 100 not in m


# --- packing ---


def valid(solution, count, capacity):
    used = np.zeros_like(count)
    for filling, times in solution:
        assert sum(filling) <= capacity and times > 0
        for s in filling:
            used[s] += times
    return (used == count).all()


def optimum(sizes, capacity):
    """The fewest bins, by trying them all."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                k = rooms.index(r)
                place(i + 1, [*rooms[:k], r - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_small_problems_are_solved_optimally():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = sorted(rng.integers(1, 21, rng.integers(1, 11)).tolist(), reverse=True)
        count = np.bincount(sizes, minlength=21)
        found = packing.complete(count, 20)
        fewest = optimum(sizes, 20)
        assert valid(found.fillings, count, 20) and found.sequences == found.bound == fewest >= packing.lower_bound(count, 20)


@pytest.mark.parametrize(("n", "high"), [(3000, 2049), (500, 300), (1, 2049), (0, 5), (5000, 3)])
def test_large_problems(n, high):
    count = np.bincount(np.random.default_rng(n).integers(1, high, n), minlength=2049)
    found = packing.complete(count, 2048, 500)
    assert valid(found.fillings, count, 2048)
    assert found.sequences <= sum(k for _, k in packing.best_fit(count, 2048))
    assert found.bound <= found.sequences <= packing.lower_bound(count, 2048) * 1.01 + 1


@pytest.mark.parametrize("seed", range(8))
def test_lengths_where_best_fit_is_not_optimal(seed):
    """Sequences are cut into pieces without waste, so the optimum is known; best-fit needs more, the search proves the optimum."""
    rng = np.random.default_rng(seed)
    while True:
        sizes = []
        for _ in range(14):
            cuts = np.sort(rng.choice(np.arange(1, 60), rng.integers(2, 4), replace=False))
            sizes += np.diff([0, *cuts, 60]).tolist()
        count = np.bincount(sizes, minlength=61)
        if sum(k for _, k in packing.best_fit(count, 60)) > 14:
            break
    found = packing.complete(count, 60, 100_000)
    assert valid(found.fillings, count, 60) and found.sequences == found.bound == 14


def test_every_filling_is_enumerated_and_dominance_is_safe():
    rng = np.random.default_rng(9)
    for _ in range(40):
        count = np.bincount(rng.integers(1, 9, 7), minlength=13).tolist()
        room = int(rng.integers(1, 13))
        every = set()
        for k in itertools.product(*(range(min(c, room // s) + 1) for s, c in enumerate(count) if s)):
            x = tuple(s for s in range(12, 0, -1) for _ in range(k[s - 1]))
            if sum(x) <= room:
                every.add(x)
        got = list(packing.fillings(count, room))
        assert {x for x, _ in got} == every and len(got) == len(every)
        wastes = [room - sum(x) for x, _ in got]
        assert wastes == sorted(wastes) and any(ok for _, ok in got)


def check_packing(rows, docs, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for doc, own in by_doc.items():
        ids = LIBRARY.encode(docs[doc] or "", add_special_tokens=False).ids + [0]
        own.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert r["piece"] == k and r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert k == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids) and (len(ids) > capacity or len(own) == 1)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in rows)


def test_op9_places(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, tokens = check_packing(packing.op9_packing(spark, SF).collect(), docs)
    assert n == -(-tokens // 2048)


def test_packing_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD + STRANGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_packing(packing.pack(packing.pieces(docs)).collect(), dict(rows))
    assert packing.pack(packing.pieces(odd_docs(spark))).where("piece = 0").count() == odd_docs(spark).count()
    assert packing.pack(packing.pieces(empty_docs(spark))).count() == 0


# --- WARC ---


def test_op5_equals_sql(spark, same):
    assert same(warc.op5_warc(spark, SF), warc.OP5_SQL) == 50


def pages(spark):
    rows = [(1, "http://a/ü b", "<p>one", "x"), (5, None, "<p>one", "x"), (3, "u\r\nX: y", "<p>one", "x"), (4, "u", None, "x"), (6, "u", "", "x"), (7, "u", "é" * 100000, "x"), (None, "u", "<p>one", "x"), (None, "u", "alone", "x"), (5, "again", "<p>one", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, archive string")


def test_archives_round_trip(spark):
    rows = warc.read_archives(warc.archives(pages(spark))).collect()
    got = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in rows}
    assert len(rows) == 9
    assert got[1, 6] == got[3, 6] == got[None, 6] == ("revisit", 5) and got[5, 6] == ("response", None)
    assert got[4, 0] == ("revisit", 6) and got[6, 0] == ("response", None) and got[7, 200000] == ("response", None) and got[None, 5] == ("response", None)
    assert {r["payload_digest"] for r in rows if r["payload_bytes"] == 6} == {warc.digest(b"<p>one")}
    small = warc.read_archives(warc.archives(pages(spark), least_bytes=7)).collect()
    assert {r["record_type"] for r in small} == {"response"}
    assert warc.read_archives(warc.archives(pages(spark).where("false"))).count() == 0


def archive(n=50, plain=False):
    records = [warc.page_record(i, f"http://h/{i}", f"<p>page {i}</p>".encode() * 20, None, warc._name(i, 0, 0)) for i in range(n)]
    if plain:
        return b"".join(map(zstandard.ZstdCompressor().compress, records)), records
    return warc.write_archive(records), records


def test_archive_layout(spark, tmp_path):
    data, records = archive()
    assert data[:4] == warc.SKIPPABLE and list(warc.frames(data)) == records
    assert list(warc.frames(archive(3, plain=True)[0])) == archive(3)[1]
    assert list(warc.frames(archive(1)[0])) == archive(1)[1] and list(warc.frames(warc.write_archive([]))) == []
    (tmp_path / "a.warc.zst").write_bytes(data)
    assert warc.read_files(spark, str(tmp_path)).count() == 50


def test_damage_is_found():
    data, records = archive()
    for bad in (data[:-3], data[: len(data) // 2], b"x" + data, data + b"junk", data[:6]):
        with pytest.raises(warc.WarcError):
            list(warc.pages_of(bad))
    one = records[0]
    for bad in (one[:-1], one + one, one.replace(b"Content-Length: 3", b"Content-Length: 4", 1), one.replace(b"WARC-Date", b"WARC-Dote"), one.replace(b"page 0", b"page 9", 1), b"", one.replace(b"WARC/1.1", b"JUNK/1.1")):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)


# --- FLAC ---


def payloads():
    rng = np.random.default_rng(0)
    wave = np.clip(128 + 100 * np.sin(np.arange(6000) / 9) + rng.normal(0, 1, 6000), 0, 255).astype(np.uint8)
    return [media.pad(x) for x in (b"", b"a" * 5000, rng.integers(0, 256, 3000, dtype=np.uint8).tobytes(), "hello wörld, this is text. ".encode() * 900, bytes([0, 255] * 900), b"\x80" * 570 + b"\0" * 3 + b"\xff" * 3, wave.tobytes(), bytes(range(256)) * 9, b"\x00" * 575 + b"\xff")]


def test_streams_round_trip():
    all_ = payloads()
    streams = media.encode(all_)
    assert media.decode(streams) == all_ and [media.encode([p])[0] for p in all_] == streams
    assert len(streams[6]) < 0.6 * len(all_[6])  # linear prediction at work
    kinds = {(s[media._header(s)[2][0] + 6] >> 1) for s in streams}
    assert {0, 1} <= kinds and 35 in kinds  # constant, verbatim and linear frames


def test_frame_numbers_of_all_lengths():
    n = np.array([0, 127, 128, 2047, 2048, 65535, 65536, 1 << 21, 1 << 26, 1 << 31])
    code, size = media._number_bytes(n)
    for value, row, k in zip(n, code, size, strict=True):
        text = bytes(row[:k].tolist())
        if value < 0xD800 or 0xE000 <= value < 0x110000:
            assert text == chr(value).encode()
        assert all(b & 0xC0 == 0x80 for b in text[1:])


def scalar_decode(stream):
    """An independent decoder: bit by bit, frame after frame without the seek table; (samples, MD5 of the header)."""
    assert stream[:4] == b"fLaC"
    at, last, tables = 4, False, 0
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            total, md5 = int.from_bytes(stream[at + 4 + 10 : at + 4 + 18], "big") & (2**36 - 1), stream[at + 22 : at + 38]
        tables += kind == 3
        at += 4 + size
    assert tables == 1
    bits = "".join(f"{x:08b}" for x in stream[at:])
    place, out = 0, []

    def read(n):
        nonlocal place
        place += n
        return int(bits[place - n : place], 2) if n else 0

    def signed(n):
        v = read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    while len(out) < total:
        assert read(14) == 0b11111111111110 and read(2) == 0
        assert read(8) == 0x20 and read(8) == 0x02
        lead = read(8)
        extra = 0 if lead < 128 else f"{lead:08b}".index("0") - 1
        read(8 * extra + 8)
        read(1)
        kind, wasted = read(6), read(1)
        assert not wasted
        x = []
        if kind == 0:
            x = [signed(8)] * 576
        elif kind == 1:
            x = [signed(8) for _ in range(576)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(8) for _ in range(order)]
            shift, weights = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None
            if kind >= 32:
                precision = read(4) + 1
                shift = signed(5)
                weights = [signed(precision) for _ in range(order)]
            wide, parts = read(2), read(4)
            for j in range(1 << parts):
                k = read(5 if wide else 4)
                raw = read(5) if k == (31 if wide else 15) else None
                for _ in range((576 >> parts) - (order if j == 0 else 0)):
                    if raw is not None:
                        e = signed(raw)
                    else:
                        q = bits.index("1", place) - place
                        place += q + 1
                        u = q << k | read(k)
                        e = u >> 1 if u % 2 == 0 else -(u >> 1) - 1
                    x.append(e + (sum(w * v for w, v in zip(weights, x[: -order - 1 : -1], strict=True)) >> shift if order else 0))
        out += x
        place += -place % 8 + 16
    assert place == len(bits)
    return out, md5


def test_an_independent_decoder_reads_the_streams(spark):
    texts = [(r["text"] or "").encode()[:20000] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    for p in payloads() + [media.pad(t) for t in texts]:
        samples, md5 = scalar_decode(media.encode([p])[0])
        assert bytes(v + 128 for v in samples) == p and hashlib.md5(np.array(samples, np.int8).tobytes()).digest() == md5


def test_blocks_are_seekable():
    p = payloads()[3] * 8
    s = media.encode([p])[0]
    found = media.pcm_blocks(s)
    assert b"".join(b for _, b in found) == p and found == media.decode_blocks([s])[0] and [a for a, _ in found] == list(range(0, len(p), 576 * 64))
    got = media.pcm_blocks(s, 40000, 80000)
    assert [a for a, _ in got] == [36864, 73728] and b"".join(b for _, b in got) == p[36864:110592] and media.pcm_blocks(s, 5, 5) == []


def test_a_seek_table_that_cannot_list_every_frame(monkeypatch):
    """One table with every k-th frame; those between are found by their headers."""
    monkeypatch.setattr(media, "POINTS", 5)
    monkeypatch.setattr(media, "FRAMES", 7)
    all_ = payloads()
    streams = media.encode(all_)
    assert media.decode(streams) == all_
    assert all(s[4 + 38] == 0x83 and int.from_bytes(s[43:46], "big") <= 5 * 18 for s in streams)
    assert bytes(v + 128 for v in scalar_decode(streams[3])[0]) == all_[3]


def hand_written(order_bits, x, parts):
    """A frame of 576 samples, fixed order 1, with residual partitions (values, k or None for escaped, bits)."""
    bits = f"{0xFF:08b}{0xF8:08b}{0x20:08b}{0x02:08b}{0:08b}"
    crc = media._crc(np.array([0xFF, 0xF8, 0x20, 0x02, 0], np.uint8), np.array([0]), np.array([5]), 8)[0]
    bits += f"{crc:08b}{9 << 1:08b}{int(x[0]) & 255:08b}" + "00" + order_bits
    for part, k, raw in parts:
        bits += f"{15 if k is None else k:04b}" + (f"{raw:05b}" if k is None else "")
        for v in part.tolist():
            u = 2 * v if v >= 0 else -2 * v - 1
            bits += (f"{v & ((1 << raw) - 1):0{raw}b}" if raw else "") if k is None else "0" * (u >> k) + "1" + (f"{u & ((1 << k) - 1):0{k}b}" if k else "")
    bits += "0" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big")
    return body + int(media._crc(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), 16)[0]).to_bytes(2, "big")


def test_escaped_partitions_decode():
    x = np.cumsum(np.random.default_rng(4).integers(-3, 4, 576)).clip(-100, 100)
    x[300:] = x[300]  # a partition of zeros, escaped with no bits
    e = np.diff(x)
    frames = [hand_written("0010", x, [(e[:143], None, 4), (e[143:287], 1, 0), (e[287:431], None, 4), (e[431:], None, 0)]), hand_written("0000", x, [(e, 2, 0)])]
    data = np.frombuffer(b"".join(frames), np.uint8)
    ends = np.cumsum([len(f) for f in frames])
    got = media.decode_frames(data, np.array([0, ends[0]]), ends, np.array([0, 0]))
    assert (got == x).all()


def test_partitioned_residuals_decode():
    """A frame written by hand: fixed order 1, two Rice partitions with different parameters."""
    x = np.cumsum(np.random.default_rng(3).integers(-3, 4, 576)).clip(-100, 100)
    bits = f"{0xFF:08b}{0xF8:08b}{0x20:08b}{0x02:08b}{0:08b}"
    crc = media._crc(np.array([0xFF, 0xF8, 0x20, 0x02, 0], np.uint8), np.array([0]), np.array([5]), 8)[0]
    bits += f"{crc:08b}{9 << 1:08b}{int(x[0]) & 255:08b}" + "00" + "0001"
    e = np.diff(x)
    for part, k in ((e[:287], 2), (e[287:], 0)):
        bits += f"{k:04b}"
        for v in part.tolist():
            u = 2 * v if v >= 0 else -2 * v - 1
            bits += "0" * (u >> k) + "1" + (f"{u & ((1 << k) - 1):0{k}b}" if k else "")
    bits += "0" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big")
    data = np.frombuffer(body + int(media._crc(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), 16)[0]).to_bytes(2, "big"), np.uint8)
    assert media.decode_frames(data, np.array([0]), np.array([len(data)]), np.array([0]))[0].tolist() == x.tolist()


def test_damaged_streams_are_refused():
    s = media.encode(payloads()[3:4])[0]
    rng = random.Random(0)
    for _ in range(60):
        bad = bytearray(s)
        at = rng.randrange(len(s))
        if 18 <= at < 21:
            continue  # the sample rate plays no part in decoding
        bad[at] ^= 1 << rng.randrange(8)
        with pytest.raises(media.FlacError):
            media.decode([bytes(bad)])
    for bad in (b"", b"RIFF", s[:100], s[:-1]):
        with pytest.raises((media.FlacError, IndexError)):
            media.decode([bad])


def test_op10_rows(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = media.op10_media(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        p = media.pad(docs[r["doc_id"]])
        s = media.encode([p])[0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]) == (len(docs[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(s), hashlib.sha256(s).hexdigest(), media.feature(p))


def test_media_of_odd_rows(spark):
    rows = media.read_media(media.media(odd_docs(spark)))
    assert all(bytes(r["payload"]) == media.pad((t or "").encode()) for r, t in zip(rows.where("doc_id is not null").orderBy("doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect(), ODD, strict=True))
    assert rows.count() == odd_docs(spark).count() and media.write_pcm(rows).where("sample = 0").count() == rows.count()
    assert media.read_media(media.media(empty_docs(spark))).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, 3, bytearray(media.encode([media.pad(b"abc")])[0]))], "doc_id long, n_bytes long, media binary")
    a, b = media.read_media(nulls).orderBy("doc_id").collect()
    assert a["payload"] is None and a["feature"] is None and a["blocks"] is None and bytes(b["payload"][:3]) == b"abc" and b["blocks"] == [0]
