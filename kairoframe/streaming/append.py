"""Appending objects from a stream of files to a banded layout: the update of a collection as it
grows. Replays of a batch do not append twice, since each batch writes folders of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "rec_id long, t_start long, t_end long, elements array<bigint>"


def bands(start: str, end: str, edges: Sequence[tuple[int, int]]):
    """The bands that a closed interval overlaps, the last one for all that lies outside."""
    hit = F.array_compact(F.array(*(F.when((F.col(start) <= hi) & (F.col(end) >= lo), F.lit(i)) for i, (lo, hi) in enumerate(edges))))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit(len(edges))))


def append_stream(spark: SparkSession, source: str, target: str, checkpoint: str, edges: Sequence[tuple[int, int]]) -> StreamingQuery:
    """Reads Parquet files of objects as they arrive and appends their postings by band."""
    objects = spark.readStream.schema(SCHEMA).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("rec_id", "t_start", "t_end", F.explode(F.array_distinct("elements")).alias("elem_id"))
        rows = rows.withColumn("band", F.explode(bands("t_start", "t_end", edges)))
        rows.sortWithinPartitions("band", "elem_id", "t_start").write.mode("overwrite").partitionBy("band").parquet(f"{target}/batch={number}")

    return objects.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    """All postings so far; replicas over bands are left to the query's rule, or to ``distinct``."""
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*")
