"""From a layout configuration to a DataFrame plan that answers a workload.

A registry maps methods to access paths ``(postings, elems) -> pairs``; new ones are registered
by name. Compositions follow the schema. Whatever the schema, the answer is the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import element_bound, time_bound
from ..operators import ensembles, layouts, mutations, query
from ..operators.postings import explode_objects
from .schema import Schema, parse

Path = Callable[[DataFrame, DataFrame], DataFrame]
REGISTRY: dict[str, Callable[[list[str]], Path]] = {}


def register(prefix: str):
    """Registers a builder of access paths for methods that start with ``prefix``."""

    def keep(builder: Callable[[list[str]], Path]):
        REGISTRY[prefix] = builder
        return builder

    return keep


@register("tif;basic")
def _basic(args: list[str]) -> Path:
    return query.core


@register("tif;slicing")
def _slicing(args: list[str]) -> Path:
    kind, rest = args[3], args[4:]
    if kind == "static":

        def path(p: DataFrame, q: DataFrame) -> DataFrame:
            bounds = layouts.grid_bounds(p, int(float(rest[0])))
            return layouts.grid_query(layouts.grid(p, bounds), q, bounds)
    else:

        def path(p: DataFrame, q: DataFrame) -> DataFrame:
            rows, own = layouts.grid_dynamic(p, float(rest[0]), float(rest[1]))
            return layouts.grid_dynamic_query(rows, q, own)

    return path


@register("tif;sharding")
def _sharding(args: list[str]) -> Path:
    slack = layouts.shard_slack(*args[2:])

    def path(p: DataFrame, q: DataFrame) -> DataFrame:
        rows = layouts.shard_rows(p, slack(p))
        return layouts.shard_query(rows, q, layouts.shard_zones(rows))

    return path


@register("tif;hint")
def _hint(args: list[str]) -> Path:
    numbers = [float(x) for x in args[4:]]

    def path(p: DataFrame, q: DataFrame) -> DataFrame:
        bounds = layouts.hint_bounds(p, int(numbers[0])) if args[3] == "static" else layouts.hint_dynamic_bounds(p, *numbers)
        return layouts.hint_query(layouts.hint(p, bounds), q, bounds)

    return path


@register("irhint")
def _irhint(args: list[str]) -> Path:
    levels = int(float(args[2]))

    def path(p: DataFrame, q: DataFrame) -> DataFrame:
        bounds = layouts.hint_bounds(p, levels)
        return layouts.hint_query(layouts.irhint(p, bounds), q, bounds)

    return path


def access_path(method: list[str]) -> Path:
    name = ";".join(method)
    fits = [p for p in REGISTRY if name == p or name.startswith(p + ";")]
    if not fits:
        raise ValueError(f"unknown method {name}")
    return REGISTRY[max(fits, key=len)](method)


@dataclass
class Bounds:
    g0: int
    g1: int
    dict_size: int

    @staticmethod
    def of(postings: DataFrame) -> Bounds:
        row = postings.agg(F.min("t_start"), F.max("t_end"), F.max("elem_id")).first()
        return Bounds(row[0] or 0, row[1] or 0, row[2] or 0)


def _pages(children: list[Schema], b: Bounds) -> list[tuple[int, int]]:
    return [(time_bound(lo, b.g0, b.g1), time_bound(hi, b.g0, b.g1)) for lo, hi in (map(float, c.range.split("-")) for c in children)]


def build(schema: Schema, bounds: Bounds) -> Path:
    """Precedence as in the configurations: hybrid, refine, split, slice, then a plain method. Each
    child is a path of its own over its share of the postings, to any depth."""
    children = schema.fanout
    if schema.hybrid:
        if len(children) != 2:
            raise ValueError("a hybrid has two children")
        return lambda p, q: ensembles.hybrid(p, q, *(build(c, bounds) for c in children))
    if schema.refine:
        if schema.refine != "elemfreq":
            raise ValueError(f"unknown refinement {schema.refine}")
        low = {element_bound(float(c.range.split("-")[0]), bounds.dict_size): c for c in children}
        if len(low) != len(children) or 0 not in low:
            raise ValueError("ranges of elements must differ and reach down to 0")
        paths = [build(low[cut], bounds) for cut in sorted(low, reverse=True)]
        return lambda p, q: ensembles.elemfreq(p, q, [c for c in sorted(low) if c > 0], paths)
    if schema.split or schema.slice:
        if (schema.split or schema.slice) != "temporal":
            raise ValueError(f"unknown fanout {schema.split or schema.slice}")
        combine = ensembles.split if schema.split else ensembles.sliced
        return lambda p, q: combine(p, q, _pages(children, bounds), [build(c, bounds) for c in children])
    if len(schema.fanout) == 1:
        return build(schema.fanout[0], bounds)
    return access_path(schema.method)


def answer(postings: DataFrame, elems: DataFrame, config: str, bounds: Bounds | None = None) -> DataFrame:
    """``(qid, rec_id)`` of a workload under a configuration in JSON, banded ones included."""
    schemas = parse(config)
    b = bounds or Bounds.of(postings)
    if len(schemas) == 1 and not schemas[0].band_range:
        return build(schemas[0], b)(postings, elems)
    edges = [tuple(map(float, s.band_range.split("-"))) for s in schemas]
    bands = [(time_bound(lo, b.g0, b.g1) + (i > 0), time_bound(hi, b.g0, b.g1)) for i, (lo, hi) in enumerate(edges)]
    return ensembles.banded(postings, elems, bands, lambda i: build(schemas[i], b))


class Collection:
    """Objects with their mutations and tombstones, queried under any configuration."""

    def __init__(self, objects: DataFrame, tombstones: DataFrame | None = None) -> None:
        self.objects, self.tombstones = objects, tombstones

    def update(self, more: DataFrame) -> Collection:
        return Collection(mutations.update(self.objects, more), self.tombstones)

    def delete(self, ids: DataFrame) -> Collection:
        return Collection(mutations.delete(self.objects, ids), self.tombstones)

    def soft_delete(self, ids: DataFrame) -> Collection:
        dead = ids.select("rec_id").distinct() if self.tombstones is None else mutations.soft_delete(self.tombstones, ids)
        return Collection(self.objects, dead)

    def postings(self) -> DataFrame:
        rows = explode_objects(self.objects)
        return rows if self.tombstones is None else mutations.alive(rows, self.tombstones)

    def query(self, queries: DataFrame, config: str = '{"method":"tif;basic"}') -> DataFrame:
        return answer(self.postings(), query.query_elems(queries), config)
