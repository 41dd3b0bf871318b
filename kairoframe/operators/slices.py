"""Statistics by slices of time, gap filling, features, and clusters of slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 20


def slice_edges(postings: DataFrame, n: int = SLICES) -> DataFrame:
    """(slice, s0, s1): ``n`` equal widths over the domain."""
    d = postings.agg(F.min("t_start").cast("double").alias("g0"), F.max("t_end").cast("double").alias("g1"))
    width = (F.col("g1") - F.col("g0")) / n
    return d.select("g0", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(
        F.col("i").cast("long").alias("slice"), (F.col("g0") + F.col("w") * F.col("i")).alias("s0"), (F.col("g0") + F.col("w") * (F.col("i") + 1)).alias("s1")
    )


def _per_slice(rows: DataFrame, edges: DataFrame, start: str, end: str, n: int) -> DataFrame:
    """Rows dealt to the slices that they overlap, by arithmetic; the edges decide. Overlap is
    strict, which is the definition of these statistics."""
    base = edges.agg(F.min("s0").alias("g0"), F.max("s1").alias("g1"), F.count("*").alias("__n"))
    near = rows.crossJoin(F.broadcast(base))  # one row
    at = lambda t: F.floor((F.col(t) - F.col("g0")) / (F.col("g1") - F.col("g0")) * F.col("__n"))
    lo, hi = F.greatest(F.lit(0), at(start) - 1), F.least(F.lit(n - 1), at(end) + 1)
    spread = near.where(lo <= hi).withColumn("slice", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    return spread.join(F.broadcast(edges), "slice").where((F.col(start) < F.col("s1")) & (F.col(end) > F.col("s0")))  # twenty rows


def object_slices(objects: DataFrame, edges: DataFrame, n: int = SLICES) -> DataFrame:
    """(slice, objects, avg_elems) of ``objects(t_start, t_end, n_elems)``; empty slices included."""
    met = _per_slice(objects.withColumnRenamed("n_elems", "k"), edges, "t_start", "t_end", n).groupBy("slice").agg(F.count("*").alias("objects"), F.avg("k").alias("avg_elems"))
    return edges.select("slice").join(met, "slice", "left").fillna(0, ["objects"])


def query_slices(queries: DataFrame, edges: DataFrame, n: int = SLICES) -> DataFrame:
    """(slice, queries, avg_length, avg_elems, avg_rank) of ``queries(q_start, q_end, n, rarest)``."""
    met = _per_slice(queries.withColumnRenamed("n", "k"), edges, "q_start", "q_end", n).groupBy("slice").agg(
        F.count("*").alias("queries"), F.avg(F.col("q_end") - F.col("q_start")).alias("avg_length"), F.avg("k").alias("avg_elems"), F.avg("rarest").alias("avg_rank")
    )
    return edges.select("slice").join(met, "slice", "left").fillna(0, ["queries"])


def interpolate(rows: DataFrame, value: str, at: str = "slice") -> DataFrame:
    """Gaps between their nearest neighbours in a straight line, at the ends the nearest one."""
    back = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.col(at))
    out = rows.withColumn("x0", F.last(here, True).over(back)).withColumn("y0", F.last(value, True).over(back))
    out = out.withColumn("x1", F.first(here, True).over(ahead)).withColumn("y1", F.first(value, True).over(ahead))
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(at) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    filled = F.coalesce(value, line, "y0", "y1")
    return out.withColumn(value, filled).drop("x0", "y0", "x1", "y1")


def normalized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Min-max over all rows (a few slices); a constant column becomes 0."""
    all_rows = Window.partitionBy()

    def scale(c: str) -> Column:
        lo, hi = F.min(c).over(all_rows), F.max(c).over(all_rows)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0)))

    return rows.select(*(c for c in rows.columns if c not in columns), *(scale(c).alias(c) for c in columns))


# ---- clusters of a few slices, on the driver


def segment(points: np.ndarray, k: int) -> tuple[list[int], float]:
    """The best contiguous segmentation into ``k`` parts by squared error: labels and error."""
    n = len(points)
    sums, squares = np.zeros((n + 1, points.shape[1])), np.zeros(n + 1)
    sums[1:], squares[1:] = np.cumsum(points, 0), np.cumsum((points**2).sum(1))

    def error(a: int, z: int) -> float:
        s = sums[z] - sums[a]
        return float(squares[z] - squares[a] - (s @ s) / (z - a))

    best = {(0, 0): (0.0, 0)}
    for parts in range(1, k + 1):
        for z in range(parts, n + 1):
            options = [(best[parts - 1, a][0] + error(a, z), a) for a in range(parts - 1, z) if (parts - 1, a) in best]
            best[parts, z] = min(options)
    labels, z = [0] * n, n
    for parts in range(k, 0, -1):
        a = best[parts, z][1]
        labels[a:z] = [parts - 1] * (z - a)
        z = a
    return labels, best[k, n][0]


def free_clusters(points: np.ndarray, k: int, rounds: int = 50) -> tuple[list[int], float]:
    """k-means from evenly spaced points: labels and error."""
    centres = points[np.linspace(0, len(points) - 1, k).round().astype(int)].astype(float)
    for _ in range(rounds):
        far = ((points[:, None] - centres[None]) ** 2).sum(2)
        own = far.argmin(1)
        moved = np.array([points[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return own.tolist(), float(far[np.arange(len(points)), own].sum())


def elbow(errors: list[float]) -> int:
    """The number of clusters (from 1) where the falling error bends most."""
    if len(errors) < 3 or max(errors) == min(errors):
        return 1
    x = np.linspace(0, 1, len(errors))
    y = (np.array(errors) - min(errors)) / (max(errors) - min(errors))
    return int((1 - x - y).argmax()) + 1


def cluster_bands(features: DataFrame, edges: DataFrame, columns: list[str], k: int | None = None, most: int = 6, contiguous: bool = True) -> list[tuple[float, float, int]]:
    """(start, end, cluster) of neighbouring slices of one cluster, by start. The input is a row
    for each slice, twenty or so."""
    rows = features.join(F.broadcast(edges), "slice").orderBy("slice").collect()
    points = np.array([[r[c] or 0.0 for c in columns] for r in rows])
    fit = segment if contiguous else free_clusters
    tries = [fit(points, j) for j in range(1, min(most, len(rows)) + 1)]
    labels = tries[(k or elbow([e for _, e in tries])) - 1][0]
    bands: list[list] = []
    for r, label in zip(rows, labels, strict=True):
        if bands and bands[-1][2] == label:
            bands[-1][1] = r["s1"]
        else:
            bands.append([r["s0"], r["s1"], label])
    return [tuple(b) for b in bands]


def band_stats(objects: DataFrame, bands: list[tuple[int, int]]) -> DataFrame:
    """(band, objects, avg_length, avg_elems) of the objects' parts inside each closed band, in
    the band's own time."""
    hits = F.array_compact(F.array(*(F.when((F.col("t_start") <= hi) & (F.col("t_end") >= lo), F.struct(F.lit(i).cast("long").alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for i, (lo, hi) in enumerate(bands))))
    rows = objects.withColumn("b", F.explode(hits)).select(F.col("b.band").alias("band"), "n_elems", (F.least("t_end", "b.hi") - F.greatest("t_start", "b.lo")).alias("length"))
    return rows.groupBy("band").agg(F.count("*").alias("objects"), F.avg("length").alias("avg_length"), F.avg("n_elems").alias("avg_elems"))


def in_bands(rows: DataFrame, bands: list[tuple[int, int]], start: str, end: str) -> DataFrame:
    """rows + band: one row for each closed band that an interval overlaps, with the interval cut to
    the band and told in the band's own time."""
    hits = F.array_compact(F.array(*(F.when((F.col(start) <= hi) & (F.col(end) >= lo), F.struct(F.lit(i).cast("long").alias("i"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))) for i, (lo, hi) in enumerate(bands))))
    cut = rows.withColumn("__b", F.explode(hits))
    return cut.withColumn("band", F.col("__b.i")).withColumn(start, F.greatest(start, "__b.lo") - F.col("__b.lo")).withColumn(end, F.least(end, "__b.hi") - F.col("__b.lo")).drop("__b")
