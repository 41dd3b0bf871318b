"""Layouts of a collection that are written once, asked many times, and changed in place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layouts, mutations, query
from ..sources.stored import Stored


@dataclass(frozen=True)
class Kind:
    """How a method lays out postings: its bounds, its rows under bounds, its query, and the column
    that its folders are named by."""

    bounds: Callable[[DataFrame], DataFrame] | None
    rows: Callable[[DataFrame, DataFrame | None], DataFrame]
    ask: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame]
    by: str | None = None
    sort: tuple[str, ...] = ("elem_id", "t_start")


def kind_of(method: str) -> Kind:
    """The layout of a method as configurations name it."""
    name, *args = method.split(";")
    family = ";".join([name, args[0]]) if args else name
    if family == "tif;basic":
        return Kind(None, lambda p, b: p, lambda rows, q, b: query.core(rows, q))
    if family == "tif;slicing":
        if args[2] == "static":
            return Kind(lambda p: layouts.grid_bounds(p, int(float(args[3]))), layouts.grid, layouts.grid_query, "pid")
        return Kind(lambda p: layouts.grid_dynamic_bounds(p, float(args[3]), float(args[4])), layouts.grid_dynamic_rows, layouts.grid_dynamic_query)
    if family in ("tif;hint", "irhint;perf"):
        if family == "tif;hint" and args[2] != "static":
            bounds = lambda p: layouts.hint_dynamic_bounds(p, float(args[3]), float(args[4]))
        else:
            levels = int(float(args[3] if family == "tif;hint" else args[1]))
            bounds = lambda p: layouts.hint_bounds(p, levels)
        sort = ("elem_id", "t_start") if family == "tif;hint" else ("part", "elem_id")
        return Kind(bounds, layouts.hint, layouts.hint_query, "lvl", sort)
    if family == "tif;sharding":
        slack = layouts.shard_slack(*args[1:])
        return Kind(lambda p: slack(p), layouts.shard_rows, lambda rows, q, b: layouts.shard_query(rows, q, layouts.shard_zones(rows)), None, ("elem_id", "shard", "t_start"))
    raise ValueError(f"unknown method {method}")


class StoredLayout:
    """A method's rows, bounds and tombstones under one path."""

    def __init__(self, spark: SparkSession, path: str, method: str) -> None:
        self.spark, self.kind = spark, kind_of(method)
        self.data, self.edges, self.dead = (Stored(spark, f"{path}/{n}") for n in ("rows", "bounds", "tombstones"))

    def create(self, postings: DataFrame) -> StoredLayout:
        bounds = None
        if self.kind.bounds:
            bounds = self.edges.create(self.kind.bounds(postings)).rows()
        self.data.create(self.kind.rows(postings, bounds), self.kind.by, self.kind.sort)
        return self

    def query(self, elems: DataFrame) -> DataFrame:
        """``(qid, rec_id)`` of a workload."""
        bounds = self.edges.rows() if self.kind.bounds else None
        found = self.kind.ask(self.data.rows(), elems, bounds)
        return (mutations.alive(found, self.dead.rows()) if self.dead.exists() else found).select("qid", "rec_id")

    def update(self, postings: DataFrame) -> None:
        """Appends new objects' postings under the bounds of old. Elements without bounds get theirs
        from the new rows; times outside the domain fall into its first or last parts."""
        bounds = None
        if self.kind.bounds:
            bounds = self.edges.rows()
            if "elem_id" in bounds.columns:
                fresh = postings.join(bounds.select("elem_id"), "elem_id", "left_anti")
                self.edges.append(self.kind.bounds(fresh))
                bounds = self.edges.rows()
        self.data.append(self.kind.rows(postings, bounds))

    def delete(self, ids: DataFrame) -> list[str]:
        """Rewrites the partitions that hold one of the ids."""
        return self.data.delete(ids)

    def soft_delete(self, ids: DataFrame) -> None:
        """Adds tombstones; rows stay."""
        ids = ids.select("rec_id").distinct()
        if self.dead.exists():
            self.dead.append(ids.join(self.dead.rows(), "rec_id", "left_anti"))
        else:
            self.dead.create(ids)

    def compact(self) -> None:
        """Deletes what tombstones name, and forgets them."""
        if self.dead.exists():
            self.data.delete(self.dead.rows())
            self.dead.create(self.dead.rows().limit(0))

    def size(self) -> DataFrame:
        return self.data.rows().agg(F.count("*").alias("entries"))
