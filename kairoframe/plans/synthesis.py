"""A configuration for a workload: features, predicted costs over the design space, the skyline,
and the cheapest few; or one configuration for each band of time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import costmodel, search, skyline, slices, stats
from ..operators.query import core
from . import schema

#: Queries sampled, configurations shown, and how near the next may be.
SAMPLE, TOP, APART = 1000, 3, 0.05


def sampled(elems: DataFrame, n: int = SAMPLE) -> DataFrame:
    """At most ``n`` queries, by a hash."""
    some = elems.select("qid").distinct().orderBy(F.xxhash64("qid"), "qid").limit(n)
    return elems.join(some, "qid", "left_semi")


def evaluator(postings: DataFrame, elems: DataFrame, net: costmodel.Network) -> Callable[[DataFrame], DataFrame]:
    """From ``(encoding)`` to ``(encoding, cost, size)``: log means over the sampled workload."""
    fixed = stats.summary(postings), stats.extent_bins(postings), stats.element_bins(postings), stats.query_stats(sampled(elems), postings)

    def run(encodings: DataFrame) -> DataFrame:
        rows = costmodel.features(*fixed, encodings.select(F.to_json("encoding").alias("config"), "encoding"))
        found = search.objective(costmodel.predict(rows, net))
        return found.select(F.from_json("config", "array<double>").alias("encoding"), "cost", "size")

    return run


def synthesize(spark: SparkSession, postings: DataFrame, elems: DataFrame, net: costmodel.Network, groups: Sequence[str] = ("pure", "dict2"), rounds: Sequence[tuple[int, int]] = search.ROUNDS) -> DataFrame:
    """``(template, encoding, cost, size)`` of every template's best that no other one beats."""
    evaluate = evaluator(postings, elems, net)
    out = None
    for _, name, lo, hi in schema.design_space(list(groups)):
        own = search.search(spark, lo, hi, evaluate, rounds).withColumn("template", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return skyline.skyline(out, "cost", "size").select("template", "encoding", "cost", "size").orderBy("cost")


def suggestions(found: DataFrame, k: int = TOP, apart: float = APART) -> list[tuple[str, float]]:
    """(configuration in JSON, predicted seconds a query) of the ``k`` cheapest that differ."""
    linear = found.withColumn("seconds", F.pow(F.lit(10.0), "cost"))
    return [(schema.serialize(schema.decode(list(r.encoding))), r.seconds) for r in skyline.presented(linear, "seconds", k, apart).collect()]


def training_rows(postings: DataFrame, elems: DataFrame, encodings: DataFrame, measured: DataFrame) -> DataFrame:
    """Features joined with ``measured(config, seconds, bytes)`` of runs: what the model learns from."""
    rows = costmodel.features(stats.summary(postings), stats.extent_bins(postings), stats.element_bins(postings), stats.query_stats(elems, postings), encodings)
    return rows.join(measured, "config").select("qid", "config", "features", F.log10("seconds").alias("throughput_log"), F.log10(F.col("bytes").cast("double")).alias("size_log"))


def verified(postings: DataFrame, elems: DataFrame, config: str) -> bool:
    """Whether a configuration gives the plain answer."""
    from .engine import answer

    got, want = answer(postings, elems, config), core(postings, elems)
    return not got.exceptAll(want).limit(1).count() and not want.exceptAll(got).limit(1).count()


def synthesize_bands(spark: SparkSession, postings: DataFrame, elems: DataFrame, net: costmodel.Network, bands: Sequence[tuple[int, int]], groups: Sequence[str] = ("pure", "dict2"), rounds: Sequence[tuple[int, int]] = search.ROUNDS) -> str:
    """A banded configuration: of every band the cheapest one for the parts of objects and queries
    that lie in it. A band without objects or queries takes its neighbour's. ``bands`` are closed, in
    order, and cover the domain."""
    objects = slices.in_bands(postings, list(bands), "t_start", "t_end")
    queries = slices.in_bands(elems, list(bands), "q_start", "q_end")
    found = []
    for i in range(len(bands)):
        p, q = objects.where(F.col("band") == i).drop("band"), queries.where(F.col("band") == i).drop("band")
        if p.limit(1).count() and q.limit(1).count():
            config, cost = suggestions(synthesize(spark, p, q, net, groups, rounds), 1)[0]
            found.append((i, config, cost))
    if not found:
        raise ValueError("no band has objects and queries")
    best = spark.createDataFrame(found, "band long, config string, cost double")
    filled = skyline.fill_bands(best, spark.range(len(bands)).select(F.col("id").alias("band"))).orderBy("band").collect()
    lo, hi = bands[0][0], bands[-1][1]
    rel = lambda t: schema._number((t - lo) / max(1, hi - lo))
    out = []
    for (a, z), row in zip(bands, filled, strict=True):
        one = schema.parse(row.config)[0]
        one.band_range = f"{rel(a - (a > lo))}-{rel(z)}"
        out.append(one)
    return schema.serialize(out)
