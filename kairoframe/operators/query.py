"""The time-travel containment query: all objects whose interval overlaps the query's and whose
elements include all of the query's. A whole workload is one job.

queries(qid, q_start, q_end, elems) and exploded query_elems(qid, q_start, q_end, elem_id, n).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import contains_all, overlaps, starts_before_end, ends_after_start

#: Windows of time that a workload is dealt to, and up to how many elements an object is small.
WINDOWS = 64
SMALL = 16
#: Pairs of a query's element and a posting of it that one job compares at most, or one window's.
PAIRS = 125_000_000


def query_elems(queries: DataFrame) -> DataFrame:
    """Exploded queries. Queries without elements are refused: they would ask for time alone,
    which ``interval_only`` does."""
    elems = F.array_distinct("elems")
    sound = F.when(F.size(elems) > 0, elems).otherwise(F.raise_error(F.lit("a query has no elements")))
    return queries.select("qid", "q_start", "q_end", F.explode(sound).alias("elem_id"), F.size(elems).cast("long").alias("n"))


def core(postings: DataFrame, elems: DataFrame) -> DataFrame:
    """``(qid, rec_id)`` by an equi-join on the element with the overlap as residual."""
    met = postings.join(elems, "elem_id").where(overlaps())
    return met.groupBy("qid", "rec_id", "n").agg(F.count("*").alias("met")).where("met = n").select("qid", "rec_id")


def naive(objects: DataFrame, queries: DataFrame) -> DataFrame:
    """The predicate as it stands: every query meets every object. For checks on small data."""
    q = queries.select("qid", "q_start", "q_end", "elems")
    return objects.join(q, overlaps() & contains_all()).select("qid", "rec_id")


def windowed(rows: DataFrame, queries: DataFrame, times: DataFrame | None = None, windows: int = WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with a window of time each: a query lies in the one of its start, a row in
    all whose queries may overlap it, so that a pair shares exactly one. ``times``: any rows with the
    same intervals."""
    g0, g1 = (rows if times is None else times).agg(F.min("t_start"), F.max("t_end")).first()
    reach = queries.agg(F.max(F.col("q_end") - F.col("q_start"))).first()[0]
    g0, g1, reach = g0 or 0, g1 or 0, max(0, reach or 0)
    width = (g1 - g0) // windows + 1
    at = lambda t: F.least(F.lit(windows - 1).cast("long"), F.expr(f"greatest(0L, {t} - ({g0}L)) div {width}L"))
    spread = rows.withColumn("window", F.explode(F.sequence(at(f"(t_start - {reach}L)"), at("t_end"))))
    return spread, queries.withColumn("window", at("q_start"))


def naive_in_windows(postings: DataFrame, objects: DataFrame, queries: DataFrame) -> DataFrame:
    """The predicate on whole objects, which queries meet in their window of time; objects that are
    small on the average are also dealt by element, and meet there the queries whose rarest it is.
    Every object that overlaps is compared, so the answer is that of ``naive``."""
    entries, ids = postings.agg(F.count("*"), F.approx_count_distinct("rec_id")).first()
    o, q = windowed(objects, queries.select("qid", "q_start", "q_end", "elems"), postings)
    rarest = F.array_max("elems")
    if entries <= SMALL * ids:
        met = o.withColumn("elem_id", F.explode("elements")).join(q.withColumn("elem_id", rarest), ["window", "elem_id"])
    else:
        met = o.join(q, "window")
    return met.where(overlaps() & F.array_contains("elements", rarest) & contains_all()).select("qid", "rec_id")


def rarest_first(postings: DataFrame, elems: DataFrame) -> DataFrame:
    """Candidates from each query's rarest element, where alone time is checked; the other elements
    only semi-join candidates. Their postings are cut to the workload's elements and candidates."""
    top = elems.groupBy("qid").agg(F.max("elem_id").alias("rarest"))
    marked = elems.join(top, "qid")
    seeds = marked.where("elem_id = rarest")
    candidates = postings.join(seeds, "elem_id").where(overlaps()).select("qid", "rec_id", "n")
    others = marked.where("elem_id <> rarest").select("qid", "elem_id")
    wanted = candidates.where("n > 1").join(others, "qid")
    held = wanted.join(postings.select("rec_id", "elem_id"), ["rec_id", "elem_id"], "left_semi")
    full = held.groupBy("qid", "rec_id", "n").agg(F.count("*").alias("met")).where("met = n - 1").select("qid", "rec_id")
    return candidates.where("n = 1").select("qid", "rec_id").unionByName(full)


def interval_only(objects: DataFrame, queries: DataFrame, pages: int | None = None) -> DataFrame:
    """Overlap alone, by pages of time: both sides are dealt to the pages that they span, and a
    pair counts in the first page that the two share. There are 64 pages at least and, where not
    told otherwise, one for every 50,000 objects."""
    pages = pages or max(64, min(1 << 16, objects.count() // 50_000))
    lo = objects.agg(F.min("t_start").alias("g0"), F.max("t_end").alias("g1")).withColumn("ext", F.greatest(F.lit(1), F.ceil((F.col("g1") - F.col("g0") + 1) / pages)))
    page = lambda t: F.greatest(F.lit(0), F.least(F.lit(pages - 1), F.expr(f"({t} - g0) div ext")))
    o = objects.crossJoin(F.broadcast(lo)).withColumn("first", page("t_start"))  # one row
    q = queries.crossJoin(F.broadcast(lo)).withColumn("q_first", page("q_start"))
    o = o.select("rec_id", "t_start", "t_end", "first", F.explode(F.sequence("first", page("t_end"))).alias("page"))
    q = q.select("qid", "q_start", "q_end", "q_first", F.explode(F.sequence("q_first", page("q_end"))).alias("page"))
    return o.join(q, "page").where(overlaps() & (F.col("page") == F.greatest("first", "q_first"))).select("qid", "rec_id")


def containment_only(postings: DataFrame, elems: DataFrame) -> DataFrame:
    """Containment without time: the plain inverted file."""
    met = postings.select("rec_id", "elem_id").join(elems, "elem_id")
    return met.groupBy("qid", "rec_id", "n").agg(F.count("*").alias("met")).where("met = n").select("qid", "rec_id")


def overlap_checks(postings: DataFrame, elems: DataFrame) -> DataFrame:
    """Postings of each query's elements that pass both checks, either one, or none."""
    met = postings.join(elems, "elem_id")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return met.groupBy("qid").agg(
        count(overlaps()).alias("both"), count(starts_before_end()).alias("start_only"), count(ends_after_start()).alias("end_only"), F.count("*").alias("no_check")
    )


def checksum(pairs: DataFrame) -> DataFrame:
    """Result count and XOR of the ids, by query."""
    return pairs.groupBy("qid").agg(F.count("*").alias("results"), F.bit_xor("rec_id").alias("xor_ids"))


def told_in_windows(postings: DataFrame, elems: DataFrame, paths: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], pairs: int = PAIRS) -> dict[str, tuple[int, int | None]]:
    """Of each path over ``(postings, elems)`` the number of results and the XOR of their ids, by
    jobs of as many windows as compare ``pairs`` pairs. An element of a window has an id of its own,
    so a path meets only the postings that its window may overlap; all windows are answered."""
    spark = postings.sparkSession
    p, q = windowed(postings, elems)
    sizes = [x.groupBy("window", "elem_id").agg(F.count("*").alias(n)) for x, n in ((p, "a"), (q, "b"))]
    volume = sizes[0].join(sizes[1], ["window", "elem_id"]).groupBy("window").agg(F.sum(F.col("a") * F.col("b")).alias("pairs")).orderBy("window").collect()
    jobs: list[list[int]] = []
    room = 0
    for window, own in volume:
        if own > room:
            jobs.append([])
            room = pairs
        jobs[-1].append(window)
        room -= own
    own_id = (F.col("elem_id") * WINDOWS + F.col("window")).alias("elem_id")
    found: dict[str, tuple[int, int | None]] = {name: (0, None) for name in paths}
    whole = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(whole)
    spark.conf.set(whole, "false")  # a join's input is small here and its pairs are many
    try:
        for windows in jobs:
            some = p.where(F.col("window").isin(windows)).select("rec_id", own_id, "t_start", "t_end")
            asked = q.where(F.col("window").isin(windows)).select("qid", "q_start", "q_end", own_id, "n")
            for name, path in paths.items():
                n, x = path(some, asked).agg(F.count("*"), F.bit_xor("rec_id")).first()
                had, xor = found[name]
                found[name] = (had + n, x if xor is None else xor if x is None else xor ^ x)
                spark._jvm.System.gc()  # what the job shuffled is removed once nothing refers to it
    finally:
        spark.conf.set(whole, before)
    return found


def workload(postings: DataFrame, every: int, width: int, n: int = 3) -> DataFrame:
    """A deterministic workload: every ``every``-th object asks for ``n`` of its elements, at places
    by a fixed rule, ``width`` to both sides of its start; so no query is without a result."""
    mine = postings.where(F.col("rec_id") % every == 0)
    w = Window.partitionBy("rec_id")
    placed = mine.withColumn("i", F.row_number().over(w.orderBy("elem_id")).cast("long")).withColumn("size", F.count("*").over(w))
    hit = F.lit(False)
    for j in range(n):
        hit = hit | (F.col("i") == 1 + (F.col("rec_id") * 7 + j * 13) % F.col("size"))
    some = placed.where(hit)
    return some.select(
        F.col("rec_id").alias("qid"), (F.col("t_start") - width).alias("q_start"), (F.col("t_start") + width).alias("q_end"), "elem_id", F.count("*").over(w).alias("n")
    )


def as_queries(elems: DataFrame) -> DataFrame:
    return elems.groupBy("qid").agg(F.first("q_start").alias("q_start"), F.first("q_end").alias("q_end"), F.sort_array(F.collect_set("elem_id"), False).alias("elems"))
