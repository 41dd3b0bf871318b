"""Partitioned evaluation: by element range, by pages or slices of time, by bands, or both.

Pages, slices and bands are in absolute time and closed; what fits no page goes to an overflow
page, and element ranges are half-open, so that no object is lost or counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import core

Path = Callable[[DataFrame, DataFrame], DataFrame]


def elemfreq(postings: DataFrame, elems: DataFrame, cuts: Sequence[int], paths: Sequence[Path] | None = None) -> DataFrame:
    """Element ranges [cut, next cut), from rare to frequent, each with a path of its own over its
    postings. A range answers for the query's elements in it, and a pair must be found in every
    range that the query touches."""
    edges = [0, *sorted(cuts), None]
    ranges = list(zip(edges[:-1], edges[1:], strict=True))[::-1]
    paths = paths or [core] * len(ranges)
    inside = lambda lo, hi: (F.col("elem_id") >= lo) & (F.lit(True) if hi is None else F.col("elem_id") < hi)
    level = F.coalesce(*(F.when(inside(lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(ranges)))
    q = elems.withColumn("level", level)
    here = q.groupBy("qid", "level").agg(F.count("*").alias("here"))
    q = q.drop("n").join(here, ["qid", "level"]).withColumnRenamed("here", "n")
    touched = here.groupBy("qid").agg(F.count("*").alias("ranges"))
    found = None
    for i, ((lo, hi), path) in enumerate(zip(ranges, paths, strict=True)):
        own = path(postings.where(inside(lo, hi)), q.where(F.col("level") == i).drop("level")).select("qid", "rec_id")
        found = own if found is None else found.unionByName(own)
    met = found.groupBy("qid", "rec_id").agg(F.count("*").alias("met"))
    return met.join(touched, "qid").where("met = ranges").select("qid", "rec_id")


def page_of(pages: Sequence[tuple[int, int]]) -> Column:
    """The first page that holds the whole interval; else the overflow page, numbered after all."""
    page = F.lit(len(pages))
    for i, (lo, hi) in reversed(list(enumerate(pages))):
        page = F.when((F.col("t_start") >= lo) & (F.col("t_end") <= hi), F.lit(i)).otherwise(page)
    return page


def split(postings: DataFrame, elems: DataFrame, pages: Sequence[tuple[int, int]], paths: Sequence[Path] | None = None) -> DataFrame:
    """Every object in one page, each page with a path of its own; queries visit the pages that they
    overlap, and the overflow page."""
    paths = [*(paths or [core] * len(pages)), core]
    p = postings.withColumn("page", page_of(pages))
    out = None
    for i, path in enumerate(paths):
        asked = elems if i == len(pages) else elems.where((F.col("q_start") <= pages[i][1]) & (F.col("q_end") >= pages[i][0]))
        own = path(p.where(F.col("page") == i).drop("page"), asked).select("qid", "rec_id")
        out = own if out is None else out.unionByName(own)
    return out


def gaps_of(pages: Sequence[tuple[int, int]]) -> list[tuple[int | None, int | None]]:
    """The stretches of time that no page covers; None is without end."""
    out, at = [], None
    for lo, hi in sorted(pages):
        if at is None or lo > at:
            out.append((at, lo - 1))
        at = hi + 1 if at is None else max(at, hi + 1)
    return [*out, (at, None)]


def sliced(postings: DataFrame, elems: DataFrame, pages: Sequence[tuple[int, int]], paths: Sequence[Path] | None = None) -> DataFrame:
    """Objects in every page that they overlap, and in the overflow page where they reach beyond all
    pages; queries too. A pair that overlaps shares an instant, and so a page. What is found in
    several pages counts once."""
    paths = [*(paths or [core] * len(pages)), core]
    zones: list[list] = [[page] for page in pages] + [gaps_of(pages)]

    def touches(start: str, end: str, zone: list) -> Column:
        hit = F.lit(False)
        for lo, hi in zone:
            hit = hit | ((F.lit(True) if hi is None else F.col(start) <= hi) & (F.lit(True) if lo is None else F.col(end) >= lo))
        return hit

    out = None
    for zone, path in zip(zones, paths, strict=True):
        own = path(postings.where(touches("t_start", "t_end", zone)), elems.where(touches("q_start", "q_end", zone))).select("qid", "rec_id")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def hybrid(postings: DataFrame, elems: DataFrame, seed: Path, refine: Path = core) -> DataFrame:
    """One path answers for each query's rarest element, another for its other elements; a pair must
    be found by both."""
    top = elems.groupBy("qid").agg(F.max("elem_id").alias("rarest"))
    marked = elems.join(top, "qid")
    seeds = marked.where("elem_id = rarest").select("qid", "q_start", "q_end", "elem_id", F.lit(1).cast("long").alias("n"))
    candidates = seed(postings, seeds).join(elems.groupBy("qid").agg(F.first("n").alias("n")), "qid")
    others = marked.where("elem_id <> rarest").select("qid", "q_start", "q_end", "elem_id", (F.col("n") - 1).alias("n"))
    held = refine(postings, others).select("qid", "rec_id")
    full = candidates.where("n > 1").join(held, ["qid", "rec_id"], "left_semi").select("qid", "rec_id")
    return candidates.where("n = 1").select("qid", "rec_id").unionByName(full)


def bands_of(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """``n`` equal bands of a domain, closed, without gaps between integers."""
    width = -(-(hi - lo + 1) // n)
    return [(lo + i * width, min(hi, lo + (i + 1) * width - 1)) for i in range(n) if lo + i * width <= hi]


def banded(postings: DataFrame, elems: DataFrame, bands: Sequence[tuple[int, int]], path: Callable[[int], Path]) -> DataFrame:
    """Each band has a path of its own over the objects that overlap it; a pair that is found in
    several bands counts once. ``bands`` must cover the domain. The band is known when the plan is made,
    so a layout stored by band is pruned by it."""
    out = None
    for i, (lo, hi) in enumerate(bands):
        mine = postings.where((F.col("t_start") <= hi) & (F.col("t_end") >= lo))
        ours = elems.where((F.col("q_start") <= hi) & (F.col("q_end") >= lo))
        got = path(i)(mine, ours).select("qid", "rec_id")
        out = got if out is None else out.unionByName(got)
    return out.distinct()
