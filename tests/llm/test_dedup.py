"""Exact, near and suffix dedup against brute force."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import docs, empty, rows
from kairoframe.llm import exact_dedup, induced_sort, near_dedup, suffix_dedup
from kairoframe.llm.common import Scratch, components


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(spark):
    groups = collections.defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    got = exact_dedup.exact_dedup(docs(spark), counters=2).collect()
    assert len(got) == len(rows())
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        least = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (least, len(ids), r.doc_id == least)
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []


def test_heavy_digests_are_bounded_and_found(spark):
    d = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"d{i}") for i in range(3000)], "doc_id long, digest string").repartition(7)
    heavy = exact_dedup.heavy_digests(d, 16).collect()
    assert [(r.digest, r.keep_id, r.group_size) for r in heavy] == [("hot", 0, 1000)]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(pairs_of):
    ids = list(pairs_of)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            x, y = pairs_of[a], pairs_of[b]
            both = len(x & y)
            if a < b and both and 100 * both >= 85 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_near(spark):
    got = near_dedup.near_dedup(docs(spark)).collect()
    sets = {r[0]: shingles(r[1]) for r in rows() if r[0] is not None}
    want = brute_components(sets)
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])
    assert near_dedup.near_dedup(empty(spark)).collect() == []


def test_near_with_ids_that_clash(spark):
    a, b, u = ("".join(f"{c}{i} " for i in range(60)) for c in "abu")
    rows_ = [(1, a), (1, b), (3, a + "end"), (7, b + "end"), (7, u), (8, u + "end"), (9, b), (9, b), (None, a)]
    for part in (1, 5):
        got = near_dedup.near_dedup(spark.createDataFrame(rows_, "doc_id long, text string").repartition(part)).collect()
        assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
            (0, 0, True), (1, 1, True), (1, 1, True), (3, 1, False), (7, 1, False), (7, 7, True), (8, 7, False), (9, 1, False), (9, 1, False),
        ]
        assert sorted((r.doc_id or 0) for r in got if r.stays) == [0, 1, 1, 7]


def test_near_in_tight_and_loose_groups(spark, monkeypatch):
    """Large groups of near copies around the threshold, with small nodes and blocks."""
    for name, value in (("SMALL", 6), ("BLOCK", 12), ("PIVOTS", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(near_dedup.nodes, "__defaults__", (near_dedup.TREES, 6, 3, 12))
    rng = random.Random(2)
    words = [f"v{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.choice([0, 1, 1, 2, 3, 5])):
            w[at] = f"own{i}-{at}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(d).collect()}
    assert got == brute_components({i: shingles(t) for i, t in enumerate(texts)})


def test_near_in_large_groups_under_the_threshold(spark, monkeypatch):
    """A template group that no branching parts, with links that lead to no pivot."""
    for name, value in (("SMALL", 4), ("BLOCK", 12), ("PIVOTS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(near_dedup.nodes, "__defaults__", (1, 4, 1, 12))
    rng = random.Random(6)
    base = [f"v{i}" for i in range(200)]
    texts = []
    for i in range(150):
        w = [*base, *(f"own{i}-{j}" for j in range(22))]
        texts += [" ".join(w), " ".join([*w[:-1], f"new{i}"])] if i % 3 == 0 else [" ".join(w)]
    rng.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components({i: shingles(t) for i, t in enumerate(texts)})
    assert len(set(want.values())) == 150
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(d, trees=4).collect()}
    assert got == want


def test_crossed_blocks_hold_every_open_pair_once(spark):
    rows_ = [(1, i, 0 if i < 40 else i) for i in range(100)] + [(2, i, 0) for i in range(30)] + [(3, i, i) for i in range(50)]
    met = collections.Counter()
    groups = collections.defaultdict(list)
    for r in near_dedup.crossed(spark.createDataFrame(rows_, "node long, rep long, part long"), 12).collect():
        groups[r.node].append((r.rep, r.part, r.probe))
    for g in groups.values():
        whole = all(p for _, _, p in g)
        met.update((min(a, b), max(a, b)) for a, x, p in g for b, y, q in g if x != y and (a < b if whole else p and not q))
    want = collections.Counter((a, b) for node in (1, 3) for n, a, x in rows_ for m, b, y in rows_ if n == m == node and a < b and x != y)
    assert met == want


def test_links_of_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(300) < 0.96], rng.integers(0, 1 << 60, 9).astype(np.uint64)]) for _ in range(30)]
    links = near_dedup.links_of_sets(sets, np.arange(30), 85)
    root = brute_components({i: set(s.tolist()) for i, s in enumerate(sets)})
    own = list(range(30))
    for a, b in links:
        p, q = sorted((own[a], own[b]))
        own = [p if x == q else x for x in own]
    assert own == [root[i] for i in range(30)]


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(5000, i) for i in range(4000, 4100)] + [(i, i + 1) for i in range(6000, 6050)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in root}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).collect() == []


def brute_windows(strings, k):
    c = collections.Counter(s[i : i + k] for s in strings for i in range(len(s) - k + 1))
    return [[c[s[i : i + k]] > 1 for i in range(len(s) - k + 1)] for s in strings]


@pytest.mark.parametrize("memory", [64, 1 << 20])
def test_induced_sort(memory):
    rng = random.Random(5)
    for _ in range(400 if memory > 64 else 120):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 20, 60]))) for _ in range(rng.randint(1, 6))]
        strings.append(rng.choice(strings)[rng.randint(0, 5) :] + b"zz")
        k = rng.choice([1, 2, 3, 5, 8, 20])
        assert [x.tolist() for x in induced_sort.repeated_windows(strings, k, memory)] == brute_windows(strings, k)


def test_a_shard_far_larger_than_memory():
    """Many levels, every queue in files: the same answer in a bounded share of memory."""
    rng = random.Random(11)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(600)) for _ in range(60)]
    strings = []
    for _ in range(160):
        s = bytearray(rng.choice(base)[rng.randint(0, 90) :])
        s[rng.randrange(len(s))] = 35
        strings.append(bytes(s))
    want = brute_windows(strings, 400)
    for memory in (1 << 16, 1 << 24):
        assert [x.tolist() for x in induced_sort.repeated_windows(strings, 400, memory)] == want
    memory = 1 << 19
    shard = induced_sort.Shard(400, memory)
    for i in range(6):
        shard.add([bytes([97 + i]) + s for s in strings])
    tuples = len(shard.text) * induced_sort.TUPLE.itemsize
    tracemalloc.start()
    for _ in shard.repeated():
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * memory and tuples > 40 * memory, (peak, tuples)


def test_a_shared_stretch_is_one_symbol():
    rng = random.Random(13)
    strings, keys, cuts = [], [], []
    for key in range(6):
        stretch = bytes(rng.choice(b"abc") for _ in range(20))
        for _ in range(8):
            left, right = (bytes(rng.choice(b"ab") for _ in range(5)) for _ in range(2))
            strings.append(left + stretch + right)
            keys.append(key)
            cuts.append(5)
    # Windows of 25 of these 30 bytes all hold the stretch.
    shard = induced_sort.Shard(25)
    shard.add(strings, keys, cuts, [20] * len(strings))
    got = [own.tolist() for block in shard.repeated() for own in block]
    assert got == [[i for i, hit in enumerate(own) if hit] for own in brute_windows(strings, 25)]


def brute_removed(texts, size):
    raw = [(t or "").encode() for t in texts]
    out = []
    for data, hits in zip(raw, brute_windows(raw, size), strict=True):
        gone = bytearray(len(data))
        for i, hit in enumerate(hits):
            if hit:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i in range(len(data)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix(spark):
    rng = random.Random(8)
    filler = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    shared, line = filler(700), filler(399)
    texts = [None, "", "short", filler(600), shared, filler(100) + shared + filler(300), shared[100:520] + filler(50), line + "A", line + "B", filler(50) + line + "A" + filler(10)]
    texts += ["x" * 900, "xy" * 450, filler(300) + "x" * 420, (filler(37) + "\n") * 40, shared[:399], filler(2000) + shared + shared + filler(9)]
    texts += [shared + "end"] * 3
    d = spark.createDataFrame(list(enumerate(texts)) + [(None, filler(10) + shared)], "doc_id long, text string").repartition(3)
    want = sorted(brute_removed([*texts, d.where("doc_id is null").first().text], 400))
    got = suffix_dedup.suffix_dedup(d, with_text=True).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans for r in got)


def test_suffix_splits_a_hot_key(spark, monkeypatch):
    """Pieces of one key that outgrow a shard are cut again."""
    rng = random.Random(12)
    filler = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    hot, longer = filler(260), filler(330)
    ends = [filler(75) for _ in range(4)]
    texts = [filler(150) + hot + filler(150) for _ in range(60)]
    texts += [filler(90 + i) + rng.choice(ends) + longer + rng.choice(ends) + filler(100) for i in range(40)]
    monkeypatch.setattr(suffix_dedup, "SHARD", 600)
    given, inner = [], suffix_dedup.sort_shards

    def watched(rows_, size):
        given.append(rows_.groupBy("key").agg(F.sum(F.length("bytes") - F.col("width") + 2).alias("n")).agg(F.max("n")).first()[0])
        return inner(rows_, size)

    monkeypatch.setattr(suffix_dedup, "sort_shards", watched)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix_dedup.suffix_dedup(d).collect()
    assert (given[0] or 0) <= 600
    want = brute_removed(texts, 400)
    assert any(w[1] for w in want)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(got)] == want


def test_suffix_on_awkward_rows(spark):
    want = sorted(brute_removed([r[1] for r in rows()], 400))
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs(spark)).collect()) == want
    assert suffix_dedup.suffix_dedup(empty(spark)).collect() == []


def test_segments_cover_every_window_once():
    rng = random.Random(3)
    for text in (b"a" * 2000, b"ab" * 900, bytes(rng.choice(b"abcdef ") for _ in range(5000)), b"x" * 400, b"x" * 399):
        _, _, start, windows, _ = suffix_dedup.segments(text)
        seen = sorted(i for s, w in zip(start.tolist(), windows.tolist(), strict=True) for i in range(s, s + w))
        assert seen == list(range(max(0, len(text) - 399)))


def test_near_ignores_partitioning(spark):
    d = docs(spark).select("doc_id", "text")
    one, many = (sorted(map(tuple, near_dedup.near_dedup(x).collect()), key=repr) for x in (d.coalesce(1), d.repartition(9, F.rand(3))))
    assert one == many
