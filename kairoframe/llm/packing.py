"""Packing into fixed windows by non-negative least squares.

Documents are cut into full windows and a rest. Rests are dealt into buckets of a bounded number
of documents; in each, shallow combinations of lengths (one to three) that fill a window are
enumerated, their repeat counts are solved against the histogram of lengths by non-negative least
squares and rounded down, and what is left is packed greedily, cutting a piece where nothing fits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, default_path
from .common import pieces, table

WINDOW = 1024
DOCS_IN_BUCKET = 5_000
END_ID = 0
MOST_TRIPLES = 4_000


def combinations(lengths: np.ndarray, window: int, most_triples: int = MOST_TRIPLES) -> np.ndarray:
    """Up to three of the lengths with sum ``window``: rows of three, 0 for none. All pairs; of the
    triples an evenly spread ``most_triples``, as residuals have their own way."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = False
    out = [np.array([[window, 0, 0]])] if have[window] else []
    a = lengths[lengths * 2 <= window]
    a = a[(a > 0) & have[window - a]]
    out.append(np.stack([window - a, a, 0 * a], 1))
    b, c = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    a = window - b - c
    ok = (c > 0) & (c <= b) & (b <= a)
    ok[ok] = have[a[ok]]
    triples = np.stack([a[ok], b[ok], c[ok]], 1)
    if len(triples) > most_triples:
        triples = triples[np.linspace(0, len(triples) - 1, most_triples).astype(int)]
    return np.concatenate([*out, triples]).astype(np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ``|A x - histogram|``, by accelerated projected gradient;
    the columns of A are the combinations."""
    if not len(combos):
        return np.zeros(0)
    size, real = len(histogram), combos > 0
    target = histogram.astype(float)
    target[0] = 0

    def times(x: np.ndarray) -> np.ndarray:
        got = np.bincount(combos.ravel(), np.repeat(x, 3), size)
        got[0] = 0
        return got

    # The largest eigenvalue of A'A is at most the largest column sum of |A|'|A|.
    step = 1 / (np.where(real, times(np.ones(len(combos)))[combos], 0).sum(1).max())
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        gradient = np.where(real, (times(y) - target)[combos], 0).sum(1)
        new = np.maximum(0, y - step * gradient)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x


def pack(lengths: Sequence[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """``(item, start, length, sequence, offset)`` for items of 1 to ``window`` tokens. Sequences
    are full, but for at most a few of a power of two at the end."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for item, n in enumerate(lengths):
        if not 0 < n <= window:
            raise ValueError("lengths must lie between 1 and the window")
        waiting[n].append(item)
    out, sequence = [], 0
    histogram = np.bincount(np.asarray(lengths, np.int64), minlength=window + 1)
    combos = combinations(np.flatnonzero(histogram), window)
    counts = solve(combos, histogram)
    for j in np.argsort(-counts, kind="stable"):
        parts = [int(n) for n in combos[j] if n]
        need = {n: parts.count(n) for n in parts}
        for _ in range(min(int(counts[j] + 1e-6), *(len(waiting[n]) // k for n, k in need.items()))):
            at = 0
            for n in parts:
                out.append((waiting[n].pop(), 0, n, sequence, at))
                at += n
            sequence += 1

    # The rest: the longest first, then whatever is the longest to fit, then a cut of the shortest.
    left = np.array([len(waiting[n]) for n in range(window + 1)])
    begun: dict[int, int] = {}  # of items that are cut: tokens already placed
    total, at, pieces = int((left * np.arange(window + 1)).sum()), 0, []
    while total:
        room = window - at
        fit = np.flatnonzero(left[: room + 1])
        n = int(fit[-1]) if len(fit) else int(np.flatnonzero(left)[0])
        item = waiting[n].pop()
        left[n] -= 1
        take = min(n, room)
        pieces.append((item, begun.get(item, 0), take, at))
        if take < n:
            begun[item] = begun.get(item, 0) + take
            waiting[n - take].append(item)
            left[n - take] += 1
        total -= take
        at = (at + take) % window
        if not at:
            out += [(i, s, k, sequence, o) for i, s, k, o in pieces]
            sequence, pieces = sequence + 1, []
    # The last window is cut into sequences of powers of two, which need no padding.
    size, used = at, 0
    for item, start, n, _ in pieces:
        while n:
            room = (1 << size.bit_length() - 1) - used
            take = min(n, room)
            out.append((item, start, take, sequence, used))
            start, n, used = start + take, n - take, used + take
            if take == room:
                size, used, sequence = size - used, 0, sequence + 1
    return out


class Tokens:
    """The vocabulary's ids for whole texts, by the compiled encoder of the same vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import tiktoken

        from .bpe import WORDS

        special = set(vocabulary.special.values())
        plain = {t: i for i, t in enumerate(vocabulary.tokens) if i not in special}
        pattern = WORDS.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
        self.special = set(vocabulary.special)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=plain, special_tokens=vocabulary.special)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode(text, allowed_special=self.special), np.uint32)


_tokens: dict[str, Tokens] = {}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, docs_in_bucket: int = DOCS_IN_BUCKET) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its ids and then id 0, so null and empty texts are one token. Documents over
    a window fill windows of their own, and their rest is packed with others; which documents meet
    is settled by a hash, so neither a source nor copies gather. Repeated rows are packed each for
    itself; null ids are kept; no rows give none; other columns are not read. All pieces are
    shuffled, with their ids only where they are shorter than a window; a task holds about
    ``docs_in_bucket`` of these.
    """
    vocabulary = Vocabulary(path or default_path())
    kind = dict(docs.dtypes)[id_col]
    buckets = max(1, -(-docs.count() // docs_in_bucket))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary.name not in _tokens:
            _tokens[vocabulary.name] = Tokens(vocabulary)
        tokens = _tokens[vocabulary.name]
        for batch in pieces(batches):
            keep, starts, lengths, crcs, sizes, rests, deal = [], [], [], [], [], [], []
            texts = batch.column("text")
            for i in range(len(batch)):
                text = texts[i].as_py() or ""
                ids = np.append(tokens.ids(text), np.uint32(END_ID))
                salt = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=7).digest(), "big")
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    keep.append(i)
                    starts.append(s)
                    lengths.append(len(part))
                    crcs.append(crc(part))
                    sizes.append(len(ids))
                    rests.append(None if len(part) == window else part.astype("<u4").tobytes())
                    deal.append(salt + s)
            longs = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, sizes, deal)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())), *longs, pa.array(rests, pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal", "ids"],
            )

    def join(piece: pa.Table) -> pa.Table:
        bucket = piece.column("bucket")[0].as_py()
        length = np.array(piece.column("length").to_pylist(), np.int64)
        rest = np.flatnonzero(length < window)
        ids = piece.column("ids")
        raw = {int(i): np.frombuffer(ids[int(i)].as_py(), "<u4") for i in rest}
        rows = [(int(rest[j]), s, n, q, o) for j, s, n, q, o in pack(length[rest].tolist(), window)]
        used = 1 + max((r[3] for r in rows), default=-1)
        whole = np.flatnonzero(length == window)
        rows += [(int(i), 0, window, used + j, 0) for j, i in enumerate(whole)]
        at = pa.array([r[0] for r in rows], pa.int64())
        start = np.array(piece.column("start").to_pylist(), np.int64)
        crcs = piece.column("ids_crc32").to_pylist()
        base = bucket << 40
        return pa.table(
            {
                "doc_id": piece.column("doc_id").take(at),
                "start": pa.array([int(start[i]) + s for i, s, *_ in rows], pa.int64()),
                "length": pa.array([n for _, _, n, *_ in rows], pa.int64()),
                "ids_crc32": pa.array([crcs[i] if n == length[i] else crc(raw[i][s : s + n]) for i, s, n, *_ in rows], pa.int64()),
                "doc_tokens": piece.column("doc_tokens").take(at),
                "sequence_id": pa.array([base + q for *_, q, _ in rows], pa.int64()),
                "offset": pa.array([o for *_, o in rows], pa.int64()),
            }
        )

    cut_schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, deal long, ids binary"
    cut_docs = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(cut, cut_schema)
    bucket = F.pmod(F.xxhash64("doc_id", "deal"), F.lit(buckets))
    return cut_docs.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(join, PIECE.format(kind=kind))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
