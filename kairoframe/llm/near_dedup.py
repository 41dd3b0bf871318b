"""Near-dedup by a chosen-path set similarity join.

Every document becomes its set of word shingles, and sets of one content become one
representative with a signature of minwise tokens. Trees branch over the representatives: a node
picks two signature places, and a member goes on to the child of its own minwise token at each. A
pair of similarity J meets in a child with probability ``1 - (1 - J)**2``, and as that makes more
than one common child in the mean, a pair survives any depth with a fixed chance; independent
trees take the miss rate to its fourth power. Small nodes are compared exhaustively, and what the
signatures suggest is confirmed on full sets.

Groups never become all their pairs. A node first emits a forest of clearly similar pairs, then, between parts not yet connected, a few for each member. Where members still have untested
candidates, their full sets go to the node itself, which compares them exhaustively over its own
inverted index and emits only links that join parts. So rows stay linear in the members.

A node that branching leaves over a block is compared whole as well: after the forests of its
blocks, every member outside its largest part meets every member of the node in some pair of
blocks. Rows are linear in the members where most of them are one part; in a large group of
documents that are alike but not linked they grow with the square of its blocks, as no part of
that work may be left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, pieces, table

WORDS = 5
PERCENT = 85
PLACES = 24
BINS = 256
SIGMAS = 4.5
TREES = 4
SMALL = 256
LEVELS = 4
BLOCK = 4_096
TIGHT = 0.6
PIVOTS = 16
BATCH_BYTES = 1 << 20
COLUMNS = 2_048

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, _U(0xD1342543DE82EF95)
_MUL = _rng.integers(1 << 63, size=PLACES, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(1 << 63, size=PLACES, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * BATCH_BYTES) + 1, _U(base))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles: ``words`` words each, or
    with fewer words all of them as one; none without words."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and (not raw or size < BATCH_BYTES):
            raw.append((texts[at] or "").encode().translate(_LOWER))
            size += len(raw[-1]) + 1
            at += 1
        out += _sets_of_batch(raw, words)
    return out


def _sets_of_batch(raw: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    up, down = _power(len(data))
    space = _SPACE[data]
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    last = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    sums = np.r_[_U(0), np.cumsum(_BYTE[data] * up[: len(data)])]
    word = _mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    bound = np.searchsorted(first, np.r_[0, ends])  # each text's first word
    n = np.diff(bound)
    chain, shingle = word, word
    for j in range(1, words):
        chain = chain[:-1] * _STEP + word[j:]
        shingle = chain
    shingle = _mix(shingle + _U(words))
    out = []
    for a, k in zip(bound[:-1].tolist(), n.tolist(), strict=True):
        if k >= words:
            out.append(np.unique(shingle[a : a + k - words + 1]))
        elif k:
            h = word[a : a + 1]
            for j in range(1, k):
                h = h * _STEP + word[a + j]
            out.append(_mix(h + _U(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens, sets x PLACES; zeros for empty sets."""
    out = np.zeros((len(sets), PLACES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(PLACES):
            out[full, k] = np.minimum.reduceat((flat * _MUL[k] + _ADD[k]) >> _U(32), starts)
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """For each set a byte of the least hash in each of BINS ranges, 0 for an empty range."""
    out = np.zeros((len(sets), BINS), np.uint8)
    shift = _U(64 - (BINS - 1).bit_length())
    for i, s in enumerate(sets):
        if len(s):
            bins = (s >> shift).astype(np.int64)
            first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
            out[i, bins[first]] = _mix(s[first]) % _U(255) + _U(1)
    return out


def similar(sketches: np.ndarray, to: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows to one, and whether it may be ``percent`` or more."""
    both = ((sketches != 0) & (to != 0)).sum(1)
    either = np.maximum((sketches != 0).sum(1) + (to != 0).sum() - both, 1)
    share = ((sketches == to) & (to != 0)).sum(1) / either
    j = percent / 100
    return share, share >= j - SIGMAS * np.sqrt(j * (1 - j) / either) - 1e-9


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, text_key, n_shingles, digest, sig, sketch: text_key tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1_000):
                part = batch.slice(start, 1_000)
                sets = shingle_sets(part.column("text").to_pylist(), words)
                sig = signatures(sets).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * PLACES, pa.int32()), pa.array(sig.ravel())),
                        pa.array([row.tobytes() for row in sketch(sets)], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "digest", "sig", "sketch"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, digest binary, sig array<int>, sketch binary"
    )


# ---- trees


def nodes(scratch: Scratch, reps: DataFrame, trees: int = TREES, small: int = SMALL, levels: int = LEVELS, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``(node, rep)`` three times: all nodes to compare at once, of 2 to ``small`` members, or to
    ``block`` where a node is tight or of the last level; the blocks of larger nodes of the last
    level, to find their parts; and these larger nodes themselves, for ``crossed``. The last two
    are None where there are none.

    Larger nodes branch on, unless one child takes most of a node that fits a block: its members
    are alike, so more minwise tokens would not part them. What is larger than a block after
    ``levels`` tokens agree is dealt into blocks by a hash, and the same members, about ``PIVOTS``,
    join every block.
    """
    dealt = over = None
    root = F.array(*(F.struct(F.lit(t).alias("tree"), F.lit(2 * t + j).alias("place")) for t in range(trees) for j in (0, 1)))
    now = reps.select("rep", "sig", F.explode(root).alias("r")).select(
        "rep", F.xxhash64(F.col("r.tree"), F.col("r.place"), F.get("sig", F.col("r.place"))).alias("node")
    )
    done = []
    for level in range(levels):
        now = scratch.write(now, f"level-{level}")
        sizes = now.groupBy("node").count().where("count > 1")
        sized = now.join(sizes, "node")
        if level:
            tight = sized.where(F.col("parent_count") <= block).groupBy("parent").agg(F.max(F.col("count") / F.col("parent_count")).alias("share")).where(F.col("share") >= TIGHT).select("parent")
            tight = scratch.write(tight, f"tight-{level}")
            done.append(now.where("first").join(tight, "parent").select(F.col("parent").alias("node"), "rep"))
            sized = sized.join(tight, "parent", "left_anti")
        sized = scratch.write(sized.select("node", "rep", "count"), f"sized-{level}")
        done.append(sized.where(F.col("count") <= small).select("node", "rep"))
        big = sized.where(F.col("count") > small)
        if not big.limit(1).count():
            break
        if level < levels - 1:
            places = F.array(F.pmod(F.xxhash64("node", F.lit(0)), F.lit(PLACES)), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PLACES)))
            now = big.join(reps.select("rep", "sig"), "rep").select("node", "count", "rep", "sig", F.posexplode(F.array_distinct(places)).alias("nth", "place")).select(
                "rep",
                F.xxhash64("node", "place", F.get("sig", F.col("place").cast("int"))).alias("node"),
                F.col("node").alias("parent"),
                F.col("count").alias("parent_count"),
                (F.col("nth") == 0).alias("first"),
            )
            continue
        done.append(big.where(F.col("count") <= block).select("node", "rep"))
        over = big.where(F.col("count") > block).select("node", "rep")
        rest = big.where(F.col("count") > block).withColumn("blocks", F.ceil(F.col("count") / block)).withColumn("mixed", F.xxhash64("rep", "node"))
        pivots = rest.where(F.pmod(F.xxhash64("node", "rep"), F.col("count")) < PIVOTS).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
        own = rest.withColumn("block", F.pmod("mixed", "blocks"))
        rest = pivots.select("node", "block", "rep").unionByName(own.select("node", "block", "rep")).distinct()
        dealt = rest.select(F.xxhash64("node", "block").alias("node"), "rep")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, dealt, over


def crossed(members: DataFrame, block: int) -> DataFrame:
    """``(node, rep, part, probe)`` from ``(node, rep, part)`` of nodes over a block: pairs of half
    blocks, so that every member outside a node's largest part meets all members of the node.

    Members of the largest part are linked already, so they meet only the others. In a pair of two
    half blocks, probes are compared with the rest; in a half block alone, all with all.
    """
    half = max(1, block // 2)
    sizes = (
        members.groupBy("node", "part").count().groupBy("node")
        .agg(F.max(F.struct("count", "part")).alias("most"), F.sum("count").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
        .select("node", F.col("most.part").alias("major"), F.ceil((F.col("n") - F.col("most.count")) / half).alias("minors"), F.ceil(F.col("most.count") / half).alias("majors"))
    )
    pair = lambda with_major, i, j, probe: f"named_struct('major', {with_major}, 'i', {i}, 'j', {j}, 'probe', {probe})"
    minor = F.expr(
        "concat("
        f"transform(sequence(own, minors - 1), j -> {pair('false', 'own', 'j', 'true')}),"
        f"transform(filter(sequence(0L, own), i -> i < own), i -> {pair('false', 'i', 'own', 'false')}),"
        f"transform(sequence(0L, majors - 1), j -> {pair('true', 'own', 'j', 'true')}))"
    )
    major = F.expr(f"transform(sequence(0L, minors - 1), i -> {pair('true', 'i', 'own', 'false')})")
    now = members.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("rep", "node"), F.when(F.col("part") == F.col("major"), F.col("majors")).otherwise(F.col("minors"))))
    now = now.withColumn("at", F.explode(F.when(F.col("part") == F.col("major"), major).otherwise(minor)))
    return now.select(F.xxhash64("node", "at.major", "at.i", "at.j").alias("node"), "rep", "part", F.col("at.probe").alias("probe"))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that never split a key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and held[-1].column(key)[-1].as_py() != keys[-1] or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def by_node(group: pa.Table) -> Iterator[pa.Table]:
    node = group.column("node").to_numpy()
    cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]).tolist()
    for a, z in itertools.pairwise(cuts):
        yield group.slice(a, z - a)


def forest(sketches: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect members by clearly similar pairs, each member found but once: only what
    is not reached yet is compared, so that a tight node costs little more than its members."""
    j, out, waiting = percent / 100, [], []
    left = np.arange(len(sketches))
    while len(left):
        if waiting:
            now = waiting.pop()
        else:
            now, left = int(left[0]), left[1:]
        share, _ = similar(sketches[left], sketches[now], percent)
        near = share >= j + (j * (1 - j) / BINS) ** 0.5
        out += [(now, int(i)) for i in left[near]]
        waiting += left[near].tolist()
        left = left[~near]
    return out


def candidates(ids: np.ndarray, part: np.ndarray, probe: np.ndarray, sketches: np.ndarray, refused: list, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member outside the largest part its untested candidates of other parts; of two such
    members the one with the smaller id tells. Where only some are probes, the candidates of each
    probe among the others."""
    kinds, count = np.unique(part, return_counts=True)
    if len(kinds) == 1:
        return
    every = probe.all()
    major = part == kinds[count.argmax()] if every else ~probe
    order = np.argsort(ids)
    tested: dict[int, list[int]] = {}
    for i, own in enumerate(refused):
        for b in own or ():
            at = int(np.searchsorted(ids[order], b))
            if at < len(ids) and ids[order[at]] == b:
                tested.setdefault(i, []).append(int(order[at]))
                tested.setdefault(int(order[at]), []).append(i)
    for i in np.flatnonzero(~major).tolist():
        other = np.flatnonzero((part != part[i]) & (major | (ids > ids[i]) & every))
        if i in tested:
            other = other[~np.isin(other, tested[i])]
        if len(other):
            may = other[similar(sketches[other], sketches[i], percent)[1]]
            if len(may):
                yield i, may


def tasks_of(rows: DataFrame) -> int:
    """Partitions for work that costs more than its bytes tell: a number, so that it is kept."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _arrays(node: pa.Table):
    raw = b"".join(node.column("sketch").to_pylist())
    return node.column("rep").to_numpy(), np.frombuffer(raw, np.uint8).reshape(-1, BINS)


def candidate_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` with a < b from ``(node, rep, sketch)``: each node's forest of clearly similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "node"):
            found: set[tuple[int, int]] = set()
            for node in by_node(group):
                ids, sk = _arrays(node)
                found.update((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in forest(sk, percent))
            left, right = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    ordered = members.select("node", "rep", "sketch").repartition(tasks_of(members), "node").sortWithinPartitions("node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def open_members(members: DataFrame, percent: int) -> DataFrame:
    """``(node, rep, part, probe)`` of the members with an untested candidate, on either side of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "node"):
            for node in by_node(group):
                ids, sk = _arrays(node)
                part, refused = node.column("part").to_numpy(), node.column("refused").to_pylist()
                probe = node.column("probe").to_numpy()
                keep = np.zeros(len(ids), bool)
                for i, may in candidates(ids, part, probe, sk, refused, percent):
                    keep[i] = True
                    keep[may] = True
                if keep.any():
                    own = node.select(["node", "rep", "part", "probe"]).filter(pa.array(keep)).combine_chunks()
                    yield from own.to_batches()

    ordered = members.select("node", "rep", "part", "probe", "sketch", "refused").repartition(tasks_of(members), "node").sortWithinPartitions("node")
    return ordered.mapInArrow(run, "node long, rep long, part long, probe boolean")


def links_of_sets(sets: list[np.ndarray], part: np.ndarray, percent: int, probe: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join parts, exhaustively from the sizes of all intersections: a spanning forest.
    Where only some are probes, from the pairs of a probe and another set.

    Members of many sets, as those of a template, are counted by products of 0-1 matrices, a
    bounded number of columns at a time; the others over an inverted index."""
    n, size = len(sets), np.array([len(s) for s in sets])
    some = probe is not None and not probe.all()
    rows = np.flatnonzero(probe) if some else np.arange(n)
    owner = np.repeat(np.arange(n), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    often = np.bincount(token)
    common = often >= max(16, n // 16)
    both = np.zeros((len(rows), n), np.float32)
    number = np.where(common, np.cumsum(common) - 1, -1)[token]
    for c in range(0, int(common.sum()), COLUMNS):
        here = (number >= c) & (number < c + COLUMNS)
        ones = np.zeros((n, COLUMNS), np.float32)
        ones[owner[here], number[here] - c] = 1
        both += ones[rows] @ ones.T
    few = ~common[token] & (often[token] > 1)
    token, owner = token[few], owner[few]
    begin, by = np.searchsorted(owner, np.arange(n + 1)), np.argsort(token, kind="stable")
    index, listed = token[by], owner[by]
    label = part.copy()
    out = []
    for r, i in enumerate(rows.tolist()):
        mine = token[begin[i] : begin[i + 1]]
        at = np.searchsorted(index, mine)
        k = np.searchsorted(index, mine, "right") - at
        met = listed[np.repeat(at - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        held = both[r] + np.bincount(met, minlength=n)
        linked = (held > 0) & (100 * held >= percent * (size + size[i] - held)) & (label != label[i])
        if some:
            linked &= ~probe
        others = np.flatnonzero(linked)
        while len(others):
            out.append((i, int(others[0])))
            label[label == label[others[0]]] = label[i]
            others = others[label[others] != label[i]]
    return out


def links_in_nodes(members: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """``(a, b)``: confirmed links between parts of ``(node, rep, part, probe)``, a forest for each node."""

    def told(ids: list, part: list, probe: list, sets: list) -> pa.RecordBatch:
        links = links_of_sets(sets, np.array(part), percent, np.array(probe))
        a = [min(ids[i], ids[j]) for i, j in links]
        b = [max(ids[i], ids[j]) for i, j in links]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])  # of one node at a time, texts as sets
        for batch in pieces(batches, 200):
            node = batch.column("node").to_numpy()
            own = [batch.column(c).to_pylist() for c in ("rep", "part", "probe")] + [shingle_sets(batch.column("text").to_pylist(), words)]
            for a, z in itertools.pairwise(np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]).tolist()):
                if z > a and node[a] != now:
                    if held[0]:
                        yield told(*held)
                    now, held = node[a], ([], [], [], [])
                for into, values in zip(held, own, strict=True):
                    into += values[a:z]
        if held[0]:
            yield told(*held)

    ordered = members.join(texts.hint("merge"), "rep").select("node", "rep", "part", "probe", "text").repartition(tasks_of(members), "node").sortWithinPartitions("node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """``(a, b, linked)``: the pairs with whether their full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked: list[bool] = []
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                left, right = (shingle_sets(part.column(c).to_pylist(), words) for c in ("ta", "tb"))
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    # One plan for texts at every size: small runs are not to broadcast what large ones cannot.
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")).hint("merge")
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")).hint("merge")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def near_dedup(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_key, stays.

    Each row is a document; component_id is the smallest id of the rows it is linked with. kept:
    that is its own id. stays: of each component the row with the smallest id, and of rows that
    share it the one with the smallest text_key; rows that share both are not told apart. Null,
    empty and blank texts have no shingles and are their own component. Texts with equal sets are
    linked without a comparison. Rows with a null id are linked with nothing, kept and stay. Very
    long texts are sets like any other. No rows give none; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows = scratch.write(sketches(docs, id_col, text_col, words), "sketches")
    told = rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
    told = told.agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    # A number of its own for each set; the written table holds it from here on.
    reps = scratch.write(told.withColumn("rep", F.monotonically_increasing_id()), "reps")
    members, dealt, over = nodes(scratch, reps, trees)
    members = scratch.write(members, "nodes")
    wanted = members.select("rep") if over is None else members.select("rep").unionByName(over.select("rep"))
    wanted = reps.select("rep", "at.doc_id", "at.text_key").join(wanted.distinct(), "rep", "left_semi")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    again = scratch.write(rows.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "again")
    if again.limit(1).count():  # rows that come again whole: one of each, before they meet anything
        texts = texts.dropDuplicates(["doc_id", "text_key"])
    texts = scratch.write(texts.hint("merge").join(wanted, ["doc_id", "text_key"]).select("rep", "text"), "texts")
    sk = reps.select("rep", "sketch")
    pairs = scratch.write(candidate_pairs((members.unionByName(dealt) if dealt is not None else members).join(sk, "rep"), percent), "pairs")
    tested = scratch.write(confirmed(pairs, texts, percent, words).groupBy("a", "b").agg(F.max("linked").alias("linked")), "tested")
    parts = scratch.write(components(scratch, tested.where("linked").select("a", "b")), "parts")
    # Members of nodes that hold more than one part.
    with_part = lambda df: df.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("part"))
    now = with_part(members)
    mixed = now.groupBy("node").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("node")
    now = now.join(mixed, "node").withColumn("probe", F.lit(True))
    if over is not None:
        now = now.unionByName(crossed(with_part(over), BLOCK))
    refused = tested.where("not linked").groupBy(F.col("a").alias("rep")).agg(F.collect_set("b").alias("refused"))
    still = now.join(sk, "rep").join(refused, "rep", "left")
    rest = scratch.write(open_members(still, percent), "open")
    if rest.limit(1).count():
        links = links_in_nodes(rest, texts, percent, words).unionByName(parts.select(F.col("id").alias("a"), F.col("component").alias("b")))
        parts = components(scratch, links, "more")
    linked = parts.join(reps.select(F.col("rep").alias("id"), "at"), "id")
    least = linked.groupBy("component").agg(F.min("at").alias("first"))
    linked = linked.join(least, "component").select(F.col("id").alias("rep"), "first")
    found = reps.select("digest", "rep", "at").join(linked, "rep", "left").select("digest", F.coalesce("first", "at").alias("first"))
    found = scratch.write(found, "found")
    scratch.keep("sketches", "found")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return rows.select("doc_id", "text_key", "n_shingles", "digest").join(found, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(some, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~some | (F.col("doc_id") == F.col("first.doc_id"))).alias("kept"),
        "text_key",
        (~some | (F.struct("doc_id", "text_key") == F.col("first"))).alias("stays"),
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
