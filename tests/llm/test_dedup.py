"""Substring dedup and SimHash against brute force."""

import random

import numpy as np
import pytest
import xxhash

from navloom.llm import components as comp
from navloom.llm import simhash, substring
from navloom.llm.text import mix
from tests.conftest import SF
from tests.llm.test_text_operators import empty_docs, odd_docs


def brute_substring(rows, size):
    """{(doc_id, text): (n_words, n_removed, kept)}; an id of null comes last."""
    rows = [(2**63 - 1 if i is None else i, t) for i, t in rows]
    first = {}
    words = [(i, (t or "").encode().split(), t) for i, t in rows]
    for i, w, _ in words:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = {}
    for i, w, t in words:
        gone = {p + j for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] < (i, p) for j in range(size)}
        out[i, t] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def check_substring(spark, rows, size):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["text"]): (r["n_words"], r["n_removed"], r["kept"]) for r in substring.substring_dedup(docs, size).collect()}
    assert got == brute_substring(rows, size)


def test_op4_equals_sql(spark, same):
    assert same(substring.op4_substring(spark, SF), substring.OP4_SQL) == 200


@pytest.mark.parametrize("size", [20, 4])
def test_random_texts(spark, size):
    rng = random.Random(size)
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefgh"[: rng.choice((1, 2, 8))]) + rng.choice(["", "", "x", "yy"]) for _ in range(rng.randrange(0, 90))]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    passage = " ".join(f"p{k}" for k in range(33))
    rows += [(100 + i, f"{'q ' * i}{passage} r{i} {passage[: 40 + i]}") for i in range(9)]
    check_substring(spark, rows, size)


def test_odd_texts(spark):
    long = " ".join(f"w{i % 701}" for i in range(40000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (None, long[:4000]), (None, "a " * 100), (7, "a " * 100), (7, "a " * 100), (7, "b " + "a " * 30), (8, "same " * 19)]
    check_substring(spark, rows, 20)
    got = substring.substring_dedup(odd_docs(spark).withColumnRenamed("score", "kept"), 20)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept"] and got.count() == odd_docs(spark).count()
    assert substring.substring_dedup(empty_docs(spark), 20).count() == 0


@pytest.mark.parametrize("size", [20, 9, 5, 3])
def test_windows_have_consistent_anchors(size):
    """Equal windows have the same anchors in their zone, and at least one."""
    rng = np.random.default_rng(size)
    rounds, before, after = substring.zone(size)
    for letters in (1, 2, 3, 6):
        base = rng.integers(0, letters, 500).astype(np.uint64)
        at = np.zeros(501, bool)
        at[substring.anchors(mix(base + np.uint64(1)), np.array([0, 200, 500]), rounds)] = True
        seen = {}
        for p in [*range(200 - size + 1), *range(200, 500 - size + 1)]:
            own = at[p + before : p + size - after + 1]
            assert own.any() and seen.setdefault(base[p : p + size].tobytes(), own.tobytes()) == own.tobytes()


@pytest.mark.parametrize("size", [20, 9, 5, 3])
def test_equal_spans_have_equal_names(size):
    """Names by symbols: equal for equal words wherever they stand, different for others, for windows and for the spans around anchors."""
    rng = np.random.default_rng(size)
    rounds, before, after = substring.zone(size)
    for letters in (1, 2, 3, 50):
        base = rng.integers(0, letters, 700).astype(np.uint64)
        base[400:460] = base[100:160]
        names, first = mix(base + np.uint64(1)), np.array([0, 300, 700])
        parsed = substring.levels(names, first, rounds)
        assert len(parsed) == rounds + 1 and all(len(a) == len(b) for a, b in parsed)
        spans = [(p, p + size) for p in [*range(300 - size + 1), *range(300, 700 - size + 1)]]
        spans += [(b - before, b + after) for b in parsed[-1][0].tolist() if any(x <= b - before and b + after <= y for x, y in ((0, 300), (300, 700)))]
        low, high = np.array(spans).T
        name = substring.Spans(names, parsed, substring._BASES[0]).name(low, high)
        seen = {}
        for (a, b), n in zip(spans, name.tolist(), strict=True):
            assert seen.setdefault(base[a:b].tobytes(), n) == n
        assert len(set(seen.values())) == len(seen)


def test_the_largest_id_and_no_id(spark):
    """Both keep their ids and texts; they count as one document."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(2**63 - 1, "x " + text), (None, "other " * 3), (5, text)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring.substring_dedup(docs).collect()}
    assert got == {2**63 - 1: (30, "x"), None: (0, "other other other"), 5: (0, text)}


# --- SimHash ---


def brute_fingerprint(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, most):
    parent = {i: i for i in range(len(fps))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(fps))]


def test_op6_against_brute_force(spark):
    rows = simhash.op6_simhash(spark, SF).orderBy("doc_id").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = [brute_fingerprint(docs[r["doc_id"]], 4) for r in rows]
    assert [r["fingerprint"] for r in rows] == [f"{x:016x}" for x in fps]
    assert [r["component_id"] for r in rows] == brute_components(fps, [r["doc_id"] for r in rows], 4)


@pytest.mark.parametrize(("most", "large"), [(4, 64), (4, 3), (1, 64), (0, 64), (7, 5), (2, 64)])
def test_links_of_clustered_fingerprints(spark, most, large):
    rng = random.Random(most * 100 + large)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randrange(0, 2 * most + 2)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    rng.shuffle(fps)
    reps = spark.createDataFrame([(i, bytearray(x.to_bytes(8, "big"))) for i, x in enumerate(fps)], "label long, fp binary")
    labels = {r["node"]: r["label"] for r in comp.components(simhash.links(reps, most, simhash.segments(most), large=large)).collect()}
    assert [labels.get(i, i) for i in range(len(fps))] == brute_components(fps, range(len(fps)), most)


@pytest.mark.parametrize("mask", [(1 << 64) - 1, 0x0FFF0FFF0FFF0FFF])
@pytest.mark.parametrize("n", [1, 1 << 16, 1 << 24, 1 << 36])
def test_segments_cover_every_pair(mask, n):
    for most in range(8):
        cut = simhash.segments(most, n, mask)
        assert sum(r + 1 for _, _, r in cut) == most + 1 and sum(m for _, m, _ in cut) == mask
        if most == 4:
            assert sum(len(simhash.ball(m, r)) for _, m, r in cut) <= 1 << 16
    widths = [min(m.bit_count() for _, m, _ in simhash.segments(4, k)) for k in (1 << 16, 1 << 24, 1 << 36)]
    assert widths[-1] > widths[0]


def test_one_hot_value_of_unlinked_fingerprints():
    """6,000 fingerprints that share 32 bits, and are hardly linked, are not compared all with all."""
    rng = np.random.default_rng(3)
    low = rng.integers(0, 1 << 32, 6000, dtype=np.uint64) & rng.integers(0, 1 << 32, 6000, dtype=np.uint64)
    fp = np.unique(np.concatenate([low, low[:50] ^ np.uint64(5), low[100:110] ^ np.uint64(0x10101)]))
    edges = simhash._within(fp, 4, (1 << 32) - 1, 64)
    label = np.arange(len(fp))
    for a, b in simhash.thin(edges):
        label[b] = a
    assert label.tolist() == [min(x) for x in brute_groups(fp, 4)]


def brute_groups(fp, most):
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= most
    label = np.arange(len(fp))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return [[x] for x in label]
        label = new


def test_thinned_edges_have_the_same_components():
    rng = np.random.default_rng(4)
    for n, m in ((10, 8), (200, 150), (50, 400)):
        e = rng.integers(0, n, (m, 2)) * 7
        t = simhash.thin(e)
        parent = {int(x): int(x) for x in e.ravel()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in e.tolist():
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        assert dict(zip(t[:, 1].tolist(), t[:, 0].tolist(), strict=True)) == {x: find(x) for x in parent if find(x) != x}


def test_recall_of_the_cover_holds_at_every_size():
    """Simulated: at least 99 % of pairs whose bits differ with the probability of similarity 0.8 meet in a segment."""
    flips = np.arccos(1.6 / 1.8) / np.pi
    rng = np.random.default_rng(5)
    for n in (1000, 1 << 22, 1 << 30):
        bits, needed = simhash.cover(n, flips)
        assert bits >= 16 and n / 2**bits <= 16
        differ = (rng.random((2000, needed, bits)) < flips).sum(2)
        assert (differ <= 1).any(1).mean() > 0.99


@pytest.mark.parametrize("large", [64, 3])
def test_clustered_wide_fingerprints(spark, large):
    """Groups that share many segment values, with links between neighbouring values only."""
    rng = random.Random(5)
    rows = []
    for c in range(8):
        centre = rng.getrandbits(128)
        for k in range(20):
            x = centre
            for _ in range(rng.randrange(0, 14)):
                x ^= 1 << rng.randrange(128)
            rows.append((c * 100 + k, x))
    reps = spark.createDataFrame([(i, bytearray(x.to_bytes(16, "big"))) for i, x in rows], "label long, fp binary")
    labels = {r["node"]: r["label"] for r in comp.components(simhash.links(reps, 12, simhash.even_segments(2, 16, 1), large=large, words=2)).collect()}
    assert [labels.get(i, i) for i, _ in rows] == brute_components([x for _, x in rows], [i for i, _ in rows], 12)


def test_simhash_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = simhash.near_components(simhash.fingerprints(docs, 4)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], r)
    assert len(rows) == docs.count() and {got[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert bytes(got[0]["fp"]) == bytes(8) and got[8]["component_id"] == got[9]["component_id"] == 8 and got[None]["component_id"] is None
    assert simhash.near_components(simhash.fingerprints(empty_docs(spark), 4)).count() == 0


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for c in range(30):
        base = [word() for _ in range(300)]
        rows.append((10 * c, " ".join(base)))
        for k in (1, 2):
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(300)] = word()
            rows.append((10 * c + k, " ".join(copy)))
    rows += [(1000 + i, " ".join(word() for _ in range(200))) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in got if i >= 1000)
    assert sum(got[10 * c + k] == 10 * c for c in range(30) for k in (1, 2)) >= 58


def _changed(rng, base, jaccard):
    """A copy of base whose 5-word shingles have a similarity of just `jaccard` or more."""
    cut = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    copy, before = list(base), list(base)
    while len(cut(base) & cut(copy)) >= jaccard * len(cut(base) | cut(copy)):
        before = list(copy)
        copy[rng.randrange(len(base))] = f"new{rng.random()}"
    return before


def test_near_copies_link_by_their_shingles(spark):
    rng = random.Random(11)
    rows = []
    for c in range(60):
        base = [f"w{c}x{rng.random()}" for _ in range(400)]
        rows += [(10 * c, base), (10 * c + 1, _changed(rng, base, 0.8)), (10 * c + 2, _changed(rng, base, 0.72))]
    # One text with twenty near copies, which has a chain to more of them.
    hub = [f"hub{i}" for i in range(400)]
    rows += [(5000 + i, _changed(rng, hub, 0.9)) for i in range(20)]
    chain = hub
    for i in range(5):
        chain = _changed(rng, chain, 0.85)
        rows.append((6000 + i, chain))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, block=7).collect()}
    cut = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in rows}
    near = {(a, b) for a in cut for b in cut if a < b and abs(a - b) < 2000 and len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b])}
    assert all(got[10 * c + 2] == 10 * c + 2 for c in range(60))  # below 0.8: stays
    assert sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    for a, b in {(a, b) for a in got for b in got if a != b and got[a] == got[b]}:  # each has a partner at 0.8
        assert any((min(a, x), max(a, x)) in near for x in got if x != a and got[x] == got[a]), (a, b)


def test_alike_by_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in rng.integers(0, 90, 60)] + [np.arange(10_000, dtype=np.uint64), np.arange(2_000, 10_000, dtype=np.uint64)]
    near = simhash.alike(sets, 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            one, two = set(a.tolist()), set(b.tolist())
            assert near[i, j] == (len(one & two) > 0 and 10 * len(one & two) >= 8 * len(one | two))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["label"] for r in comp.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(40)} == {100} and got[301] == 300 and 200 not in got
