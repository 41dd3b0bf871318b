"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors lie in groups of bounded size. A group's index has for each dimension and each impact
(the absolute value, quantised) a segment that lists the rows with it. A block of queries takes
the segments by descending impact times query weight and adds up scores. What is still to come is
bounded by the impacts not yet reached, so the rows that may belong to a query's best are known at
any time; reading stops only when that bound proves that few are left, and those are rescored
exactly. Each group's best then meet in a top-k per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, table

K = 20
ROWS_IN_GROUP = 8_192
QUERIES_IN_BLOCK = 64
SHARES = 4
IMPACT_STEP = 2
NEVER = np.int64(-(1 << 62))
_BLOCK = ["ids", "dims", "kind", "matrix"]


class ImpactIndex:
    """Of a group's integer matrix (rows x dimensions)."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        step = max(IMPACT_STEP, -(-int(np.abs(matrix).max(initial=0)) // 64))
        impact = np.abs(matrix) // step
        self.segments: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # dimension, largest impact, rows, values
        for d in range(matrix.shape[1]):
            order = np.argsort(-impact[:, d], kind="stable")
            levels = impact[order, d]
            cuts = np.flatnonzero(np.r_[True, levels[1:] != levels[:-1]]) if len(order) else np.zeros(0, int)
            for rows in np.split(order, cuts[1:]):
                values = matrix[rows, d].astype(np.int64)
                self.segments.append((d, int(np.abs(values).max(initial=0)), rows, values))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id, and ids and scores of this group's best, at least the ``k`` best."""
        n, weight = len(self.ids), np.abs(queries).max(0)
        score = np.zeros((n, len(queries)), np.int64)
        row, col = np.nonzero(self.ids[:, None] == query_ids[None, :])
        score[row, col] = NEVER  # a query's own row
        order = sorted(self.segments, key=lambda s: -s[1] * int(weight[s[0]]))
        ahead: dict[int, list[int]] = {}
        for d, top, *_ in reversed(order):
            ahead.setdefault(d, [0]).append(top)  # for each dimension the impacts to come, the largest last
        read, check = 0, n * self.matrix.shape[1] // 2
        few = [np.zeros(0, int)] * len(queries)
        for at, (d, _, rows, values) in enumerate(order):
            score[rows] += values[:, None] * queries[:, d][None, :]
            ahead[d].pop()
            read += len(rows)
            if read >= check or at == len(order) - 1:
                check += n * self.matrix.shape[1] // 16
                rest = np.abs(queries) @ np.array([ahead.get(i, [0])[-1] for i in range(queries.shape[1])], np.int64)
                least = np.partition(score, n - k, axis=0)[n - k] if n > k else np.full(len(queries), NEVER)
                may = score >= np.maximum(least - 2 * rest, NEVER // 2)[None, :]
                if at == len(order) - 1 or may.sum() * 20 <= may.size:
                    few = [np.flatnonzero(may[:, j]) for j in range(len(queries))]
                    break
        for j, rows in enumerate(few):
            exact = self.matrix[rows].astype(np.int64) @ queries[j]
            best = np.lexsort((self.ids[rows], -exact))[:k]
            yield int(query_ids[j]), self.ids[rows[best]], exact[best]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * x); rows with a null id, without a vector, or with a
    null or non-finite component are left out."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    fit = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)
    return vectors.where(fit).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def blocks(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``(key, ids, dims, matrix)``: the rows of each of ``n`` hash blocks as one row of bytes.
    Shorter vectors end in zeros."""

    def join(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks()
        size = np.diff(v.offsets.to_numpy())
        m = np.zeros((len(t), int(size.max())), np.int64)
        m[np.arange(m.shape[1]) < size[:, None]] = v.flatten().to_numpy()
        kind = "<i2" if np.abs(m).max() < 1 << 15 else "<i8"
        ids = np.array(t.column("vec_id").to_pylist(), "<i8")
        return pa.table(
            {key: t.column("block").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "dims": pa.array([m.shape[1]], pa.int32()), "kind": [kind], "matrix": pa.array([m.astype(kind).tobytes()], pa.binary())}
        )

    return (
        rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)))
        .groupBy("block").applyInArrow(join, f"{key} long, ids binary, dims int, kind string, matrix binary")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the ``k`` highest inner products with the
    vectors under another id, all if there are fewer, ties to the smaller id.

    Rows that ``quantised`` leaves out take no part; repeated rows count each, and a query does not
    meet rows of its own id; of queries that share an id the least vector asks; other columns are
    not read; without queries or vectors there are no rows. A group's vectors go to ``SHARES`` tasks
    once each, before the blocks of queries that each of them answers.
    """
    from_all = quantised(vectors, id_col, vector_col, scale)
    from_queries = quantised(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = max(1, -(-from_all.count() // ROWS_IN_GROUP))
    n_blocks = max(1, -(-from_queries.count() // QUERIES_IN_BLOCK))
    share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    index = blocks(from_all, "group", groups).select("group", share, F.lit(-1).cast("long").alias("asked"), *_BLOCK)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")
    asked = blocks(from_queries, "asked", n_blocks).select(each, F.pmod("asked", F.lit(SHARES)).cast("int").alias("share"), "asked", *_BLOCK)
    both = index.unionByName(asked).repartition("group", "share").sortWithinPartitions("group", "share", "asked")

    def matrix(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, dims, kind, raw = (row.column(c)[0].as_py() for c in _BLOCK)
        return np.frombuffer(ids, "<i8"), np.frombuffer(raw, kind).reshape(-1, dims).astype(np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, None
        for row in pieces(batches, 1):
            here = row.column("group")[0].as_py(), row.column("share")[0].as_py()
            ids, q = matrix(row)
            if row.column("asked")[0].as_py() < 0:
                held, found = here, ImpactIndex(ids, q)
                continue
            if held != here:  # a group without vectors
                continue
            dims = found.matrix.shape[1]
            q = np.pad(q, ((0, 0), (0, max(0, dims - q.shape[1]))))[:, :dims]
            out = list(found.search(ids, q, k))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int64()),
                    pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                    pa.array(np.concatenate([o[2] for o in out]), pa.int64()),
                ],
                names=["query_id", "vec_id", "score"],
            )

    best = both.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
