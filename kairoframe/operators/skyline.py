"""Skylines, tolerance pruning, and work on score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .postings import ONE_TASK, in_ranges


def skyline(rows: DataFrame, x: str, y: str, by: Sequence[str] = (), one_task: int = ONE_TASK) -> DataFrame:
    """Rows that no other row of their group beats: at most as much in both and less in one. By a
    sort and a running minimum; equal points stay together. Nulls in x or y take no part. Without
    groups and with over ``one_task`` values of x, the minimum runs by ranges of x."""
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = own.groupBy(*by, x).agg(F.min(y).alias("__low"))
    ahead = Window.unboundedPreceding
    if by or (n := points.count()) <= one_task:
        points = points.withColumn("__least", F.min("__low").over(Window.partitionBy(*by).orderBy(x).rowsBetween(ahead, -1)))
    else:
        keyed = in_ranges(points, F.col(x), n)
        lows = keyed.groupBy("range").agg(F.min("__low").alias("__own"))
        lows = lows.select("range", F.min("__own").over(Window.orderBy("range").rowsBetween(ahead, -1)).alias("__before"))
        within = F.min("__low").over(Window.partitionBy("range").orderBy(x).rowsBetween(ahead, -1))
        points = keyed.join(F.broadcast(lows), "range").withColumn("__least", F.least("__before", within)).drop("range", "__before")  # a row for each range
    kept = points.where("__least is null or __low < __least").drop("__least")
    return own.join(kept, [*by, x]).where(F.col(y) == F.col("__low")).select(*rows.columns)


def skyline_anti(rows: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The same for any number of columns, by an anti join within groups."""
    other = rows.select(*(F.col(c).alias(f"o_{c}") for c in [*by, *columns]))
    same = [F.col(c) == F.col(f"o_{c}") for c in by]
    le = [F.col(f"o_{c}") <= F.col(c) for c in columns]
    lt = F.lit(False)
    for c in columns:
        lt = lt | (F.col(f"o_{c}") < F.col(c))
    return rows.join(other, [*same, *le, lt], "left_anti")


def prune(rows: Sequence[tuple], dims: Sequence[int], tolerance: float = 0.005) -> list[tuple]:
    """Of rows sorted by ``dims``, those that improve on the last kept one by more than the
    tolerance in some dimension. Depends on the order: a fold over a small skyline."""
    kept: list[tuple] = []
    for row in sorted(rows, key=lambda r: tuple(r[d] for d in dims)):
        if not kept or any(row[d] < kept[-1][d] * (1 - tolerance) for d in dims):
            kept.append(row)
    return kept


def prune_frame(rows: DataFrame, x: str, y: str, tolerance: float, by: Sequence[str] = ()) -> DataFrame:
    """The fold inside Spark, over each group's sorted array (a skyline, so small): (by, x, y)."""
    kind = f"array<struct<{x}:double,{y}:double>>"
    point = F.struct(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    points = rows.groupBy(*by).agg(F.sort_array(F.collect_set(point)).alias("p"))

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        better = (p[x] < last[x] * (1 - tolerance)) | (p[y] < last[y] * (1 - tolerance))
        return F.when(F.size(acc) == 0, F.array(p)).when(better, F.concat(acc, F.array(p))).otherwise(acc)

    folded = points.withColumn("p", F.aggregate("p", F.array().cast(kind), step))
    return folded.select(*by, F.explode("p").alias("k")).select(*by, f"k.{x}", f"k.{y}")


def dedup(scores: DataFrame, key: Sequence[str] = ("objects", "queries", "schema", "xor_result", "size_mb", "construction_s")) -> DataFrame:
    """The fastest of equal runs."""
    return scores.groupBy(*key).agg(F.max("qps").alias("qps"), F.max_by("category", "qps").alias("category"))


def not_done(configs: DataFrame, scores: DataFrame, key: Sequence[str] = ("objects", "queries", "schema")) -> DataFrame:
    """The runs that no score tells of yet."""
    return configs.join(scores.select(*key).distinct(), list(key), "left_anti")


def matching(column: Column, spec: str) -> Column:
    """``a,b|c,d``: one of a, b and one of c, d occur; without a bar one of the words."""
    out = F.lit(True)
    for part in spec.split("|"):
        any_of = F.lit(False)
        for word in filter(None, part.split(",")):
            any_of = any_of | column.contains(word)
        out = out & any_of
    return out


def template(schema: Column) -> Column:
    """A configuration's template: numbers cut off the end of its methods and ranges."""
    return F.regexp_replace(schema, r"(;?-?[0-9.]+)+(?=\"|$)", "")


def template_name(schema: Column) -> Column:
    """What a configuration in JSON is an instance of: the kind of its composition, and its methods
    without their numbers. Text without a method is an error."""
    plain = lambda m: F.regexp_replace(m, r"(;[-+.0-9]*[0-9][-+.0-9]*)+$", "")
    methods = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r'"method":"([^"]*)"'), F.lit(1)), plain)
    below = methods(F.regexp_extract(schema, r'(?s)"fanout":(.*)$', 1))
    kind = F.when(schema.contains('"refine":"elemfreq"'), "dref-p-").when(schema.contains('"split":"temporal"'), "tspl-p-").when(schema.contains('"slice":"temporal"'), "tsli-p-")
    unknown = F.raise_error(F.concat(F.lit("no template for "), schema)).cast("string")
    composed = F.concat(F.coalesce(kind, unknown), F.size(below).cast("string"), F.lit(": { "), F.array_join(below, " | "), F.lit(" }"))
    alone = F.concat(F.lit("pure-unp: "), F.coalesce(F.get(methods(schema), 0), unknown))
    return F.when(schema == "", "").when(schema.contains('"fanout":'), composed).otherwise(alone)


def relative(scores: DataFrame, by: Sequence[str] = ("objects", "queries")) -> DataFrame:
    """Throughput and size in percent of the group's fastest entry's."""
    best = scores.groupBy(*by).agg(F.max(F.struct("qps", (-F.col("size_mb")).alias("s"))).alias("b"))
    return scores.join(best, list(by)).select(
        *scores.columns, (F.col("qps") * 100 / F.col("b.qps")).alias("qps_percent"), (F.col("size_mb") * -100 / F.col("b.s")).alias("size_percent")
    )


def pivot_best(scores: DataFrame, column: str, values: Sequence[str], by: Sequence[str] = ("objects", "queries")) -> DataFrame:
    """For each group and template the best throughput."""
    return scores.groupBy(*by).pivot(column, list(values)).agg(F.max("qps"))


def presented(suggestions: DataFrame, cost: str, k: int, threshold: float) -> DataFrame:
    """The ``k`` cheapest, without those within ``threshold`` of the one before. Of equal costs the
    first by the other columns stands; rows without a cost are the last, as in SQL."""
    order = [F.col(cost).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in suggestions.columns if c != cost)]
    place = Window.orderBy(*order)
    rows = suggestions.select("*", F.lag(cost).over(place).alias("__before"), F.row_number().over(place).alias("__place"))
    far = (F.col("__place") == 1) | (F.col(cost) > F.col("__before") * (1 + threshold))
    return rows.where(far).orderBy("__place").limit(k).drop("__before", "__place")


def consistent(results: DataFrame) -> DataFrame:
    """Of ``results(layout, workload, results, xor_ids)`` the workloads whose layouts disagree."""
    return results.groupBy("workload").agg(F.countDistinct("results", "xor_ids").alias("answers")).where("answers > 1")


def best_per_band(configs: DataFrame) -> DataFrame:
    """Of ``configs(band, config, cost)`` the cheapest of each band."""
    return configs.groupBy("band").agg(F.min(F.struct("cost", "config")).alias("b")).select("band", "b.config", "b.cost")


def fill_bands(best: DataFrame, bands: DataFrame) -> DataFrame:
    """Bands without a configuration take their left neighbour's, else their right one's."""
    back = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("band").rowsBetween(0, Window.unboundedFollowing)
    rows = bands.join(best, "band", "left")
    pick = lambda c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)).alias(c)
    return rows.select(*bands.columns, pick("config"), pick("cost"))


def combined_qps(parts: DataFrame) -> DataFrame:
    """Of ``parts(queries, sec_per_query)`` the queries over all their seconds."""
    return parts.agg((F.sum("queries") / F.sum(F.col("queries") * F.col("sec_per_query"))).alias("qps"))
