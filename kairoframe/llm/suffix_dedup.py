"""Suffix-array dedup: bytes under a string of ``size`` bytes that also starts elsewhere go.

Windows of that size are dealt to shards by their content, so that equal windows always meet. In
each window the leftmost least k-gram is its anchor. Windows of one anchor form two segments, on
either side of the middle, and a segment's key hashes the anchor with the half window of context
that all its windows hold. Segments whose key comes once repeat nothing. Of segments that come more
than once whole, one is kept with its count, pre-aggregated, so that no group of copies gathers
anywhere. Segments that differ under one key are cut into pieces by the distance of their windows to
the anchor: equal windows have one distance, so a piece's windows share a longer context, and the
same two rules leave fewer. What is left goes to the shards.

A shard is sorted by external induced sorting with common-prefix values on disk-backed queues, far
beyond its share of memory; windows that have their whole length in common with a neighbour are
marked. A piece's context is one symbol there, by comparison of its bytes. Pieces of one key that
outgrow a shard are cut again, at last to single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pieces, table
from .induced_sort import Column, Shard
from .near_dedup import _BYTE, _mix, _power

SIZE = 400
GRAM = 32
PARTS = 8
SHARD = 2 << 20  # symbols
_TAG = [("key", np.int64), ("content", np.int64)]
_U = np.uint64


def _sliding(h: np.ndarray, w: int, f, fill: int) -> np.ndarray:
    """``f`` over each ``w`` neighbours, by running values from both ends of blocks."""
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, _U(fill))
    padded[: len(h)] = h
    rows = padded.reshape(-1, w)
    ahead = f.accumulate(rows, axis=1).ravel()
    back = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def _hashes(data: bytes) -> tuple:
    """``(sums, down, value)``: running sums, and the hash of the bytes a to z with a salt."""
    n = len(data)
    up, down = _power(n)
    sums = np.r_[_U(0), np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[:n])]
    return sums, down, lambda a, z, salt: _mix((sums[z] - sums[a]) * down[a] + _U(salt))


def segments(data: bytes, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(key, content, start, windows, lead)`` of a text's segments; a segment's bytes run from
    start to start + windows + size - 1, its anchor stands ``lead`` bytes after the start, and every
    window lies in exactly one. None under ``size`` bytes."""
    n = len(data)
    if n < size:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums, down, value = _hashes(data)
    w = size - gram + 1
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least = _sliding(grams, w, np.minimum, (1 << 64) - 1)
    # A gram is an anchor where some window has it as its least.
    pad = np.zeros(w - 1, np.uint64)
    anchor = np.flatnonzero(grams == _sliding(np.r_[pad, least, pad], w, np.maximum, 0))
    kinds, kind = np.unique(grams[anchor], return_inverse=True)
    order = np.argsort(kind * n + anchor)
    place = (kind * n + anchor)[order]
    # Runs of windows with one least value, then one stretch for each leftmost anchor.
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    stop = np.r_[start[1:], len(least)]
    own = np.searchsorted(kinds, least[start])
    a, z = np.searchsorted(place, own * n + start), np.searchsorted(place, own * n + stop - 1)
    count = z - a + 1
    run = np.repeat(np.arange(len(start)), count)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = place[a[run] + nth] - own[run] * n
    begin = np.where(nth == 0, start[run], np.r_[0, at[:-1]] + 1)
    end = np.minimum(at + 1, stop[run])
    # Left: windows that hold the half before the anchor; right: the others hold the half after it.
    half = (size - gram) // 2
    middle = np.clip(at - half + 1, begin, end)
    out = []
    for lo, hi, left in ((begin, middle, True), (middle, end, False)):
        some = np.flatnonzero(hi > lo)
        p, s, k = at[some], lo[some], (hi - lo)[some]
        key = value(p - half, p + gram, 1) if left else value(p, p + size - half, 2)
        out.append((key.view(np.int64), value(s, s + k + size - 1, 3).view(np.int64), s, k, p - s))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def row_keys(id_col: str, text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(text, F.col(id_col)).alias("k2")]


def segment_rows(docs: DataFrame, size: int) -> DataFrame:
    """key, content, windows, lead, k1, k2, starts, n: the rows of ``docs(k1, k2, text)``; a segment that
    comes again in its text has one row with all its starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            cols: list[list] = [[] for _ in range(8)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                key, content, start, windows, lead = segments((text or "").encode(), size)
                if not len(key):
                    continue
                order = np.lexsort((start, content, key))
                key, content, start, windows, lead = (x[order] for x in (key, content, start, windows, lead))
                first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
                n = np.diff(np.r_[first, len(key)])
                for c, v in zip(cols, (key[first], content[first], windows[first], lead[first], np.full(len(first), k1[i]), np.full(len(first), k2[i]), start, n), strict=True):
                    c.append(v)
            if cols[0]:
                key, content, windows, lead, a, b, start, n = map(np.concatenate, cols)
                starts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(start, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(content), pa.array(windows, pa.int32()), pa.array(lead, pa.int32()), pa.array(a), pa.array(b), starts, pa.array(n, pa.int64())],
                    names=["key", "content", "windows", "lead", "k1", "k2", "starts", "n"],
                )

    return docs.mapInArrow(run, "key long, content long, windows int, lead int, k1 long, k2 long, starts array<int>, n long")


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, dict[str, np.ndarray]]]:
    """Of each row its number, its text's bytes and the columns of its list ``wanted``."""
    wanted, texts = batch.column("wanted"), batch.column("text").to_pylist()
    for i, text in enumerate(texts):
        own = wanted[i].values
        yield i, (text or "").encode(), {f.name: own.field(f.name).to_numpy() for f in own.type}


def split_segments(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Segments in ``parts``, by the distance of a window's start to its anchor, from
    ``docs(k1, k2, text, wanted)``. d1 and d2 are the least and the greatest distance that a key
    stands for; off is the first window's number in the whole segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            out: list[tuple] = []
            for i, data, w in _wanted(batch):
                value = _hashes(data)[2]
                reach = (w["d2"] - w["d1"] + 1).astype(np.int64)
                edges = w["d1"][:, None] + (reach[:, None] * np.arange(parts + 1)) // parts
                lo, hi = edges[:, :-1], edges[:, 1:] - 1
                lead, least = w["lead"].astype(np.int64), w["lead"].astype(np.int64) - w["windows"] + 1
                top, low = np.minimum(hi, lead[:, None]), np.maximum(lo, least[:, None])
                row, part = np.nonzero((top >= low) & (hi >= lo))
                top, low, lo, hi = top[row, part], low[row, part], lo[row, part], hi[row, part]
                anchor = (w["start"] + lead)[row]
                start, windows = anchor - top, top - low + 1
                key = value(anchor - lo, anchor - hi + size, (10 + lo * 1024 + hi).astype(np.uint64))
                content = value(start, start + windows + size - 1, 3)
                n = len(row)
                off = w["off"][row] + lead[row] - top
                out.append((w["root_key"][row], w["root_content"][row], off, np.full(n, k1[i]), np.full(n, k2[i]), key.view(np.int64), content.view(np.int64), start, windows, top, lo, hi))
            if out:
                names = ["root_key", "root_content", "off", "k1", "k2", "key", "content", "start", "windows", "lead", "d1", "d2"]
                columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                long = {"root_key", "root_content", "k1", "k2", "key", "content"}
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in long else pa.int32()) for n, c in zip(names, columns, strict=True)], names=names)

    return docs.mapInArrow(
        run, "root_key long, root_content long, off int, k1 long, k2 long, key long, content long, start int, windows int, lead int, d1 int, d2 int"
    )


_PIECE = ["root_key", "root_content", "off", "start", "windows", "lead", "d1", "d2"]


def _listed(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(F.collect_list(F.struct(*names)).alias("wanted"))


def split_alike(scratch: Scratch, rows: DataFrame, held: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """What is left of ``rows`` to sort, in pieces, and ``(root_key, root_content, off, windows)``
    of the pieces that turned out to be copies. All rows are cut once; then keys over ``SHARD``
    are, until they fit. ``held`` has the texts."""
    names = ["root_key", "root_content", "off", "k1", "k2", "start", "windows", "lead", "d1", "d2"]
    fits, copies, parts = [], [], PARTS
    for level in range(size.bit_length() + 1):
        if level:
            hot = rows.groupBy("key").agg(F.sum(F.col("windows") + F.col("d2") - F.col("d1") + 2).alias("volume")).where(F.col("volume") > SHARD).select("key")
            hot = scratch.write(hot, f"hot-{level}")
            if not hot.limit(1).count():
                break
            hot = F.broadcast(hot)  # at most one for each SHARD symbols of all rows
            fits.append(rows.join(hot, "key", "left_anti"))
            rows, parts = rows.join(hot, "key"), 2
        halves = scratch.write(split_segments(held.join(_listed(rows, _PIECE), ["k1", "k2"]), size, parts), f"pieces-{level}")
        kinds = scratch.write(halves.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct(*names)).alias("at")), f"kinds-{level}")
        copies.append(halves.join(kinds.where("n > 1").select("key", "content"), ["key", "content"]).select("root_key", "root_content", "off", "windows"))
        several = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).where("kinds > 1 and fewest = 1").select("key")
        rows = scratch.write(kinds.join(several, "key").select("key", "content", "at.*"), f"split-{level}")
    out = copies[0]
    for r in fits:
        rows = rows.unionByName(r)
    for c in copies[1:]:
        out = out.unionByName(c)
    return rows, out


def cut_pieces(docs: DataFrame, size: int) -> DataFrame:
    """key, content, cut, width, bytes from ``docs(text, wanted)``: cut and width tell the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            raw: list[bytes] = []
            for _, data, w in _wanted(batch):
                raw += [data[a:z] for a, z in zip(w["start"].tolist(), (w["start"] + w["windows"] + size - 1).tolist(), strict=True)]
                out.append((w["key"], w["content"], w["lead"] - w["d1"], size - (w["d2"] - w["d1"])))
            key, content, cut, width = (np.concatenate(x) for x in zip(*out, strict=True))
            columns = [pa.array(key), pa.array(content), pa.array(cut, pa.int32()), pa.array(width, pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "content", "cut", "width", "bytes"])

    return docs.mapInArrow(run, "key long, content long, cut int, width int, bytes binary")


def sort_shards(rows: DataFrame, size: int) -> DataFrame:
    """key, content, spans: of each piece the stretches of windows found elsewhere in its shard."""
    schema = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))

    def told(shard: Shard, tags: Column) -> Iterator[pa.RecordBatch]:
        at = 0
        for block in shard.repeated():
            own = tags.read(at, at + len(block))
            at += len(block)
            found = []
            for places in block:
                edge = np.flatnonzero(np.diff(places, prepend=-9, append=1 << 40) != 1)
                found.append([{"a": int(places[x]), "z": int(places[y - 1]) + 1} for x, y in zip(edge[:-1], edge[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(own["key"].copy()), pa.array(own["content"].copy()), pa.array(found, schema)], names=["key", "content", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, tags = None, None, None
        for batch in pieces(batches):
            number = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]).tolist()
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z == a:
                    continue
                if number[a] != now:
                    if shard is not None:
                        yield from told(shard, tags)
                    now, shard = number[a], Shard(size)
                    tags = Column(shard.store, _TAG)
                part = batch.slice(a, z - a)
                key = part.column("key").to_numpy()
                rows_ = np.empty(len(part), tags.dtype)
                rows_["key"], rows_["content"] = key, part.column("content").to_numpy()
                tags.append(rows_)
                shard.add(part.column("bytes").to_pylist(), key.tolist(), part.column("cut").to_pylist(), part.column("width").to_pylist())
        if shard is not None:
            yield from told(shard, tags)

    ordered = rows.repartition("shard").sortWithinPartitions("shard", "key")
    return ordered.mapInArrow(run, "key long, content long, spans array<struct<a:int,z:int>>")


def suffix_dedup(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``with_text`` also spans (byte stretches) and kept (bytes).

    Null and short texts lose nothing; matches do not cross documents; a row that comes twice is
    two documents with one text. Null ids are rows like any other; no rows give none; other columns
    are not read. A string is judged on the input, so all its places go, the first one too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col))
    rows = scratch.write(segment_rows(texts.select("k1", "k2", "text"), size), "segments")
    shared = rows.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("key")
    shared = scratch.write(rows.join(shared, "key"), "shared")
    scratch.drop("segments")
    first = F.min(F.struct("k1", "k2", F.get("starts", F.lit(0)).alias("start"), "windows", "lead")).alias("at")
    distinct = scratch.write(shared.groupBy("key", "content").agg(F.sum("n").alias("n"), first), "distinct")
    several = distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).where("kinds > 1 and fewest = 1").select("key")
    half, left = (size - GRAM) // 2, F.col("at.lead") >= (size - GRAM) // 2
    alike = distinct.join(several, "key").select(
        F.col("key").alias("root_key"), F.col("content").alias("root_content"), F.lit(0).alias("off"), "at.*",
        F.when(left, half).otherwise(0).alias("d1"), F.when(left, size - GRAM).otherwise(half - 1).alias("d2"),
    )
    alike = scratch.write(alike, "alike")
    held = scratch.write(texts.select("k1", "k2", "text").join(alike.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), "held")
    sort, copies = split_alike(scratch, alike, held, size)
    volume = sort.agg(F.sum(F.col("windows") + F.col("d2") - F.col("d1") + 2)).first()[0] or 0
    shards = max(1, -(-volume // SHARD))
    parts = cut_pieces(held.join(_listed(sort, ["key", "content", "start", "windows", "lead", "d1", "d2"]), ["k1", "k2"]).select("text", "wanted"), size)
    sorted_ = scratch.write(sort_shards(parts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), size), "sorted")
    some = sorted_.where(F.size("spans") > 0).groupBy("key", "content").agg(F.first("spans").alias("spans"))
    # From pieces back to whole segments.
    some = some.join(sort.select("key", "content", "root_key", "root_content", "off"), ["key", "content"]).select(
        "root_key", "root_content", F.expr("transform(spans, x -> named_struct('a', x.a + off, 'z', x.z + off))").alias("spans")
    )
    some = some.unionByName(copies.select("root_key", "root_content", F.expr("array(named_struct('a', off, 'z', off + windows))").alias("spans")))
    some = some.groupBy(F.col("root_key").alias("key"), F.col("root_content").alias("content")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("z")))
    found = (
        shared.join(distinct.select("key", "content", F.col("n").alias("copies")), ["key", "content"])
        .join(some, ["key", "content"], "left")
        .withColumn("spans", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")))
        .where("spans is not null")
    )
    moved = F.flatten(F.transform("starts", lambda s: F.transform("spans", lambda x: F.struct((x["a"] + s).alias("a"), (x["z"] + s + (size - 1)).alias("z")))))
    spans = found.select("k1", "k2", moved.alias("spans")).distinct().groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            spans = batch.column("spans")
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = (text or "").encode()
                merged: list[list[int]] = []
                if spans[i].is_valid:
                    own = spans[i].values
                    a, z = own.field("a").to_numpy(), own.field("z").to_numpy()
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, z, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    cuts = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    merged = cuts.reshape(-1, 2).tolist()
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                else:
                    kept = data
                values = (len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), merged, kept)
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            columns = [pa.array(v, t) for (name, v), t in zip(out.items(), types, strict=True)]
            names = ["doc_id", *out]
            if not with_text:
                columns, names = columns[:4], names[:5]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<array<long>>, kept binary" if with_text else ""
    return texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
