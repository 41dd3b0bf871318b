"""Search of the design space: grids over the open parameters, refined around the best."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (points per parameter, candidates kept) of each round, and the most candidates.
ROUNDS = ((6, 20), (3, 10), (2, 2))
MOST = 100_000


def grid(spark: SparkSession, lo: Sequence[float], hi: Sequence[float], points: int, most: int = MOST) -> DataFrame:
    """``(encoding)``: the product of evenly spaced values of the open places, from one number per
    row: its digits in base ``points`` pick the values."""
    open_places = [i for i, (a, b) in enumerate(zip(lo, hi, strict=True)) if a != b]
    while points > 2 and points ** len(open_places) > most:
        points -= 1
    rows = spark.range(points ** len(open_places))
    values = []
    for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
        if i in open_places:
            digit = F.floor(F.col("id") / F.lit(points ** open_places.index(i))) % points
            values.append(F.lit(float(a)) + digit * F.lit((b - a) / max(1, points - 1)))
        else:
            values.append(F.lit(float(a)))
    return rows.select(F.array(*values).alias("encoding"))


def around(best: DataFrame, lo: Sequence[float], hi: Sequence[float], points: int, radius: Sequence[float]) -> DataFrame:
    """Finer grids of half a cell around each of a few encodings, inside lo..hi."""
    out = best.select(F.col("encoding").alias("centre"), F.array().cast("array<double>").alias("encoding"))
    for i, (a, b, r) in enumerate(zip(lo, hi, radius, strict=True)):
        centre = F.get("centre", i)
        steps = F.array(centre) if a == b else F.array(*(F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), centre + float(d))) for d in np.linspace(-r, r, points)))
        out = out.select("centre", F.col("encoding").alias("head"), F.explode(F.array_distinct(steps)).alias("x")).select("centre", F.concat("head", F.array("x")).alias("encoding"))
    return out.select("encoding").distinct()


def best(rows: DataFrame, k: int, cost: str = "cost") -> DataFrame:
    return rows.orderBy(cost, "encoding").limit(k)


def search(spark: SparkSession, lo: Sequence[float], hi: Sequence[float], evaluate: Callable[[DataFrame], DataFrame], rounds: Sequence[tuple[int, int]] = ROUNDS) -> DataFrame:
    """``(encoding, cost, ...)`` of all rounds' best, cheapest first. ``evaluate`` turns encodings
    into costs; what a round keeps is a few rows and is held by the driver between rounds."""
    now = grid(spark, lo, hi, rounds[0][0])
    radius = [(b - a) / max(1, rounds[0][0] - 1) / 2 for a, b in zip(lo, hi, strict=True)]
    kept = None
    for i, (_, k) in enumerate(rounds):
        scored = evaluate(now)
        top = best(scored if kept is None else scored.unionByName(kept), k)
        kept = spark.createDataFrame(top.collect(), top.schema)
        if i + 1 < len(rounds):
            now = around(kept.select("encoding"), lo, hi, rounds[i + 1][0], radius)
            radius = [r / max(1, rounds[i + 1][0] - 1) for r in radius]
    return kept.orderBy("cost")


def objective(predicted: DataFrame, by: str = "config") -> DataFrame:
    """The log of the mean cost over a workload's queries."""
    return predicted.groupBy(by).agg(F.log10(F.avg(F.pow(F.lit(10.0), "throughput_log"))).alias("cost"), F.log10(F.avg(F.pow(F.lit(10.0), "size_log"))).alias("size"))
