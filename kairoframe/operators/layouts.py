"""Physical layouts of postings as derived columns, and the query over each.

A layout never changes the answer. It adds a partition column to postings and to queries, so that
the equi-join on (element, partition) meets fewer rows; replicas are told apart by a predicate
and never need a distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import overlaps
from .postings import domain


def _with_domain(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(bounds))  # one row


def _result(met: DataFrame) -> DataFrame:
    return met.groupBy("qid", "rec_id", "n").agg(F.count("*").alias("met")).where("met = n").select("qid", "rec_id")


# ---- slicing: equal-width slices of time


def grid_bounds(rows: DataFrame, slices: int) -> DataFrame:
    return domain(rows).withColumn("ext", F.greatest(F.lit(1), F.ceil((F.col("g1") - F.col("g0")) / F.lit(slices))).cast("long")).withColumn("slices", F.lit(slices).cast("long"))


def _slice(t: str) -> Column:
    return F.expr(f"greatest(0L, least(slices - 1, case when {t} < g0 then 0L else ({t} - g0) div ext end))")


def grid(postings: DataFrame, bounds: DataFrame) -> DataFrame:
    """postings + pid, s0: one row for each slice that the interval spans; s0 is the first."""
    rows = _with_domain(postings, bounds).withColumn("s0", _slice("t_start")).withColumn("s1", _slice("t_end"))
    return rows.select("rec_id", "elem_id", "t_start", "t_end", "s0", F.explode(F.sequence("s0", "s1")).alias("pid"))


def grid_query(layout: DataFrame, elems: DataFrame, bounds: DataFrame) -> DataFrame:
    """A pair counts in the first slice that both share."""
    q = _with_domain(elems, bounds).withColumn("q0", _slice("q_start")).withColumn("q1", _slice("q_end"))
    q = q.select("qid", "q_start", "q_end", "elem_id", "n", "q0", F.explode(F.sequence("q0", "q1")).alias("pid"))
    return _result(layout.join(q, ["elem_id", "pid"]).where(overlaps() & ((F.col("pid") == F.col("s0")) | (F.col("pid") == F.col("q0")))))


def dynamic_slices(freq: Column, alpha: float, beta: float) -> Column:
    """Slices of an element from its frequency; one at least."""
    return F.greatest(F.lit(1), F.round(F.pow(F.lit(10.0), F.log10(freq / F.pow(F.lit(10.0), F.lit(alpha))) * beta))).cast("long")


def grid_dynamic_bounds(postings: DataFrame, alpha: float, beta: float) -> DataFrame:
    """The elements' bounds (elem_id, g0, ext, slices)."""
    own = postings.groupBy("elem_id").agg(F.count("*").alias("freq"), F.min("t_start").alias("g0"), F.max("t_end").alias("g1"))
    own = own.withColumn("slices", dynamic_slices(F.col("freq"), alpha, beta))
    return own.withColumn("ext", F.greatest(F.lit(1), F.ceil((F.col("g1") - F.col("g0")) / F.col("slices"))).cast("long")).select("elem_id", "g0", "ext", "slices")


def grid_dynamic_rows(postings: DataFrame, own: DataFrame) -> DataFrame:
    """The layout with slices by element."""
    rows = postings.join(own, "elem_id").withColumn("s0", _slice("t_start")).withColumn("s1", _slice("t_end"))
    return rows.select("rec_id", "elem_id", "t_start", "t_end", "s0", F.explode(F.sequence("s0", "s1")).alias("pid"))


def grid_dynamic(postings: DataFrame, alpha: float, beta: float) -> tuple[DataFrame, DataFrame]:
    own = grid_dynamic_bounds(postings, alpha, beta)
    return grid_dynamic_rows(postings, own), own


def grid_dynamic_query(layout: DataFrame, elems: DataFrame, own: DataFrame) -> DataFrame:
    q = elems.join(own, "elem_id").withColumn("q0", _slice("q_start")).withColumn("q1", _slice("q_end"))
    q = q.select("qid", "q_start", "q_end", "elem_id", "n", "q0", F.explode(F.sequence("q0", "q1")).alias("pid"))
    return _result(layout.join(q, ["elem_id", "pid"]).where(overlaps() & ((F.col("pid") == F.col("s0")) | (F.col("pid") == F.col("q0")))))


# ---- dyadic hierarchy of intervals


def hint_bounds(rows: DataFrame, m: int) -> DataFrame:
    """Domain with the shift that leaves ``m`` bits."""
    bits = F.length(F.conv((F.col("g1") - F.col("g0")).cast("string"), 10, 2))
    return domain(rows).withColumn("m", F.lit(m)).withColumn("shift", F.greatest(F.lit(0), bits - m).cast("int"))


def dynamic_levels(freq: Column, alpha: float, beta: float) -> Column:
    return F.greatest(F.lit(1), F.round(F.log10(freq / F.pow(F.lit(10.0), F.lit(alpha))) * beta)).cast("int")


def hint_dynamic_bounds(postings: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Bounds by element: its own domain, and levels from its frequency."""
    own = postings.groupBy("elem_id").agg(F.count("*").alias("freq"), F.min("t_start").alias("g0"), F.max("t_end").alias("g1"))
    bits = F.length(F.conv((F.col("g1") - F.col("g0")).cast("string"), 10, 2))
    return own.withColumn("m", dynamic_levels(F.col("freq"), alpha, beta)).withColumn("shift", F.greatest(F.lit(0), bits - F.col("m")).cast("int")).drop("freq")


def _bounded(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    return rows.join(bounds, "elem_id") if "elem_id" in bounds.columns else _with_domain(rows, bounds)


def _prefix(t: str) -> Column:
    return F.expr(f"shiftright(greatest(g0, least(g1, {t})) - g0, shift)")


def hint(postings: DataFrame, bounds: DataFrame) -> DataFrame:
    """postings + lvl, part, org, inside. On each level at most two parts, in closed form: of the
    prefixes rounded inwards, the first if odd and the last if even. org: the part of the start;
    inside: the part of the end."""
    rows = _bounded(postings, bounds).withColumn("a", _prefix("t_start")).withColumn("b", _prefix("t_end"))
    levels = rows.select("rec_id", "elem_id", "t_start", "t_end", "a", "b", F.explode(F.expr("sequence(0, m)")).alias("lvl"))
    size = F.expr("shiftleft(1L, lvl)")
    lo, hi = F.expr("(a + shiftleft(1L, lvl) - 1) div shiftleft(1L, lvl)"), F.expr("(b + 1) div shiftleft(1L, lvl) - 1")
    levels = levels.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    parts = F.array_distinct(F.array_compact(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo")), F.when(F.col("hi") % 2 == 0, F.col("hi")))))
    out = levels.withColumn("part", F.explode(parts))
    org, inside = F.col("part") == F.floor(F.col("a") / size), F.col("part") == F.floor(F.col("b") / size)
    return out.select("rec_id", "elem_id", "t_start", "t_end", "lvl", "part", org.alias("org"), inside.alias("inside"))


def hint_query(layout: DataFrame, elems: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row for each level of a query's element, with the range of parts that it touches there.
    Replicas count only in the first of these parts."""
    q = _bounded(elems, bounds).withColumn("qa", _prefix("q_start")).withColumn("qb", _prefix("q_end"))
    q = q.select("qid", "q_start", "q_end", "elem_id", "n", "qa", "qb", F.explode(F.expr("sequence(0, m)")).alias("lvl"))
    q = q.select("qid", "q_start", "q_end", "elem_id", "n", "lvl", F.expr("shiftright(qa, lvl)").alias("q_first"), F.expr("shiftright(qb, lvl)").alias("q_last"))
    met = layout.join(q, ["elem_id", "lvl"]).where(F.col("part").between(F.col("q_first"), F.col("q_last")) & overlaps())
    return _result(met.where(F.col("org") | (F.col("part") == F.col("q_first"))))


def irhint(postings: DataFrame, bounds: DataFrame) -> DataFrame:
    """The same rows clustered time first: by level and part, then element."""
    return hint(postings, bounds).repartition("lvl", "part").sortWithinPartitions("lvl", "part", "elem_id")


# ---- sharding: postings of like duration with a zone map


def shards(postings: DataFrame) -> DataFrame:
    """postings + shard: the duration's binary order of magnitude, so that within a shard, sorted
    by start, ends are nearly monotone."""
    return postings.withColumn("shard", F.length(F.conv((F.col("t_end") - F.col("t_start")).cast("string"), 10, 2)).cast("long"))


def shard_zones(layout: DataFrame) -> DataFrame:
    """Zone map: of each element and shard the first start, the last end and the longest interval."""
    return layout.groupBy("elem_id", "shard").agg(
        F.min("t_start").alias("zone_start"), F.max("t_end").alias("zone_end"), F.max(F.col("t_end") - F.col("t_start")).alias("longest"), F.count("*").alias("entries")
    )


def shard_query(layout: DataFrame, elems: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones drop shards; in a shard no start before q_start - longest can overlap."""
    live = elems.join(zones, "elem_id").where("zone_start <= q_end and zone_end >= q_start")
    met = layout.join(live.select("qid", "q_start", "q_end", "elem_id", "n", "shard", "longest"), ["elem_id", "shard"])
    return _result(met.where((F.col("t_start") >= F.col("q_start") - F.col("longest")) & overlaps()))


def relaxation(freq: Column, alpha: float, beta: float) -> Column:
    """Percent of the domain by which ends in a shard may fall back, from an element's frequency."""
    return F.least(F.lit(100.0), 100 * F.exp(-beta * F.greatest(F.lit(0.0), F.log10(freq) - alpha)))


def shard_slack(*args: str):
    """From a configuration's arguments (``static;percent`` or ``dyn;alpha;beta``; nothing: 2 %) to a
    function of postings that tells by element how far an end may fall back: ``(elem_id, slack)``."""
    if args and args[0] == "dyn":
        percent = lambda freq: relaxation(freq, float(args[1]), float(args[2]))
    else:
        percent = lambda freq: F.lit(float(args[1]) if args else 2.0)

    def slack(postings: DataFrame) -> DataFrame:
        own = postings.groupBy("elem_id").agg(F.count("*").alias("freq"), (F.max("t_end") - F.min("t_start")).alias("domain"))
        return own.select("elem_id", F.floor(percent(F.col("freq")) / 100 * F.col("domain")).cast("long").alias("slack"))

    return slack


def shard_rows(postings: DataFrame, slack: DataFrame) -> DataFrame:
    """postings + shard: in start order each posting joins the first shard of its element whose last
    end it does not undercut by more than the element's slack. Sequential by nature within an
    element: its postings stream through one task in start order and only the last end of each shard
    is held, so a frequent element costs time there but no memory."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        now, last = None, []
        for batch in batches:
            elem, end, slacks = (batch.column(c).to_numpy() for c in ("elem_id", "t_end", "slack"))
            out = np.empty(len(batch), np.int64)
            for j, (e, z, free) in enumerate(zip(elem.tolist(), end.tolist(), slacks.tolist(), strict=True)):
                if e != now:
                    now, last = e, []
                for i, before in enumerate(last):
                    if z >= before - free:
                        last[i] = max(before, z)
                        break
                else:
                    i = len(last)
                    last.append(z)
                out[j] = i
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rec_id", "elem_id", "t_start", "t_end")), pa.array(out)], names=["rec_id", "elem_id", "t_start", "t_end", "shard"])

    ordered = postings.join(slack, "elem_id").select("rec_id", "elem_id", "t_start", "t_end", "slack").repartition("elem_id").sortWithinPartitions("elem_id", "t_start", "t_end", "rec_id")
    return ordered.mapInArrow(run, "rec_id long, elem_id long, t_start long, t_end long, shard long")


def greedy_shards(postings: DataFrame, slack: int) -> DataFrame:
    return shard_rows(postings, postings.select("elem_id").distinct().withColumn("slack", F.lit(slack).cast("long")))


# ---- size accounting


def sizes(layouts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(layout, entries, bytes): rows of each layout, times its width in bytes."""
    out = None
    for name, (rows, width) in layouts.items():
        own = rows.agg(F.count("*").alias("entries")).select(F.lit(name).alias("layout"), "entries", (F.col("entries") * width).alias("bytes"))
        out = own if out is None else out.unionByName(own)
    return out


def size_of_elements(layout: DataFrame) -> DataFrame:
    """Entries by element with their running share, the most frequent first."""
    own = layout.groupBy("elem_id").agg(F.count("*").alias("entries"))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("entries"), "elem_id")))
