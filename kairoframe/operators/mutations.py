"""Updates, deletes and soft deletes of a collection, as relations: one logical table, so nothing
has to be passed on to layouts. Tombstones are a table of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import Files


def update(objects: DataFrame, more: DataFrame) -> DataFrame:
    """Appends; the new ids are shifted behind the greatest id so far."""
    shift = objects.agg(F.coalesce(F.max("rec_id") + 1, F.lit(0)).alias("shift"))
    moved = more.crossJoin(F.broadcast(shift)).withColumn("rec_id", F.col("rec_id") + F.col("shift")).drop("shift")  # one row
    return objects.unionByName(moved)


def delete(objects: DataFrame, ids: DataFrame) -> DataFrame:
    return objects.join(ids.select("rec_id").distinct(), "rec_id", "left_anti")


def soft_delete(tombstones: DataFrame, ids: DataFrame) -> DataFrame:
    return tombstones.select("rec_id").unionByName(ids.select("rec_id")).distinct()


def alive(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows or results without those of dead ids; no sentinel ever shows."""
    return rows.join(tombstones.select("rec_id").distinct(), "rec_id", "left_anti")


def restore(tombstones: DataFrame, ids: DataFrame) -> DataFrame:
    return tombstones.join(ids.select("rec_id"), "rec_id", "left_anti")


def rewrite_touched(spark, path: str, ids: DataFrame, by: str = "band") -> list:
    """Deletes from a layout in folders by ``by``, rewriting only those that hold a deleted id, and
    tells their values. New folders are written whole beside the old ones and then take their
    places one by one; a failure in between leaves each folder old or new, and a second call ends
    the work. ``Stored`` swaps all of them at once."""
    stored = spark.read.parquet(path)
    dead = ids.select("rec_id").distinct()
    touched = [r[0] for r in stored.select(by, "rec_id").join(dead, "rec_id", "left_semi").select(by).distinct().collect()]
    if touched:
        files, side = Files(spark), f"{path.rstrip('/')}.rewrite"
        stored.where(F.col(by).isin(touched)).join(dead, "rec_id", "left_anti").write.mode("overwrite").partitionBy(by).parquet(side)
        for value in touched:
            files.delete(f"{path}/{by}={value}")
            if files.exists(f"{side}/{by}={value}"):
                files.rename(f"{side}/{by}={value}", f"{path}/{by}={value}")
        files.delete(side)
    return touched
