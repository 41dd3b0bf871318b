"""Shared pieces: tables, scratch tables in the cluster's shared folder, components of links."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import Files, shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller slices, so that what Python makes of them stays small too."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


class Scratch:
    """Written tables that cut lineage: each is computed once, lives in the shared folder and
    outlasts the loss of any executor. ``drop`` and ``keep`` free the ones that no later step reads."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/kairoframe/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("errorifexists").parquet(self.path(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        files = Files(self.spark)
        for name in names:
            files.delete(self.path(name))
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        self.drop(*sorted(self.names - set(names)))


def components(scratch: Scratch, links: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)`` (long ids) as ``(id, component)``, where component is
    the smallest id reachable; ids without links are not listed.

    Alternating large-star and small-star rounds, DataFrame operations only. Every round hangs
    each node's neighbours on the node's minimum, so a hub costs one row per spoke and never a
    pair of spokes; minima are pre-aggregated before the shuffle. Links live in a written table
    per round. Null ends, self links and repeated links are ignored.
    """
    def settled(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges, last = scratch.write(edges, f"{name}-0"), f"{name}-0"
    before = settled(edges)
    for turn in range(1, max_rounds + 1 if before[0] else 1):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above u move to the minimum around u.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star: u and its neighbours below u move to the minimum below u.
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        now = scratch.write(small, f"{name}-{turn}")
        after = settled(now)  # done when the link set is the same as before
        scratch.drop(last)
        edges, last = now, f"{name}-{turn}"
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
