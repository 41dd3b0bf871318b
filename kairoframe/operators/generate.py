"""Generated objects, workloads and selectivity control.

Draws come from an integer congruence over ids, so that a seed gives the same rows in any engine
and for any partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import overlaps
from .postings import ONE_TASK, in_ranges, summed_before

MODULUS = 2147483648


def draw(x: Column, salt: int = 0) -> Column:
    """A number in 0..2^31-1 from an id: two congruence steps with a fold of the high bits."""
    one = (x % MODULUS * 1103515245 + 12345 + salt * 7919) % MODULUS
    folded = one.bitwiseXOR(F.shiftright(one, 15))
    return (folded * 1103515245 + 12345) % MODULUS


def draw_sql(x: str, salt: int = 0) -> str:
    one = f"((({x}) % {MODULUS} * 1103515245 + 12345 + {salt * 7919}) % {MODULUS})"
    return f"((xor({one}, {one} >> 15) * 1103515245 + 12345) % {MODULUS})"


def unit(x: Column, salt: int = 0) -> Column:
    return draw(x, salt) / float(MODULUS)


# ---- objects


def objects(spark: SparkSession, card: int, domain: int, dict_size: int, mean_elems: int = 4, min_len: int = 0, max_len: int | None = None) -> DataFrame:
    """``card`` objects: lengths log-uniform in min_len..max_len, starts uniform, 1 to
    2 * mean_elems - 1 distinct elements with log-uniform ranks. The first object starts at 0 and
    the first holds element dict_size - 1, so that domain and dictionary are met."""
    ids = spark.range(card).select(F.col("id").alias("rec_id"))
    top = max_len or domain
    length = F.least(F.lit(domain), F.floor(F.pow(F.lit(float(top - min_len + 1)), unit(F.col("rec_id"), 1))) - 1 + min_len).cast("long")
    start = F.floor(unit(F.col("rec_id"), 2) * (F.lit(domain + 1) - F.col("length"))).cast("long")
    n = (1 + draw(F.col("rec_id"), 3) % (2 * mean_elems - 1)).cast("int")
    one = lambda i: F.least(F.lit(dict_size - 1), F.floor(F.pow(F.lit(float(dict_size)), unit(F.col("rec_id") * 64 + i, 4))) - 1).cast("long")
    rows = ids.withColumn("length", length).withColumn("t_start", F.when(F.col("rec_id") == 0, F.lit(0)).otherwise(start).cast("long"))
    elements = F.array_distinct(F.transform(F.sequence(F.lit(1), n), one))
    first = F.array_distinct(F.concat(elements, F.array(F.lit(dict_size - 1).cast("long"))))
    return rows.select(
        "rec_id", "t_start", (F.col("t_start") + F.col("length")).alias("t_end"),
        F.sort_array(F.when(F.col("rec_id") == 0, first).otherwise(elements), False).alias("elements"),
    )


def objects_like(spark: SparkSession, stats: dict, card: int | None = None) -> DataFrame:
    """Objects after collection statistics: ``card``, ``domain``, ``dict`` and ``extents``, a list of
    (min_len, max_len, avg_elems, dev_elems), one for each equal-count bin."""
    n, bins = card or stats["card"], stats["extents"]
    ids = spark.range(n).select(F.col("id").alias("rec_id"), (F.col("id") % len(bins)).cast("int").alias("bin"))
    table = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(z)).alias("z"), F.lit(float(m)).alias("m"), F.lit(float(d)).alias("d")) for a, z, m, d in bins))
    rows = ids.withColumn("b", F.get(table, F.col("bin")))
    length = F.floor(F.col("b.a") + unit(F.col("rec_id"), 1) * (F.col("b.z") - F.col("b.a") + 1)).cast("long")
    normal = F.sqrt(-2 * F.log(F.greatest(F.lit(1e-9), unit(F.col("rec_id"), 5)))) * F.cos(2 * math.pi * unit(F.col("rec_id"), 6))
    s2 = F.log(1 + F.pow(F.col("b.d") / F.col("b.m"), F.lit(2.0)))
    k = F.greatest(F.lit(1), F.round(F.exp(F.log("b.m") - s2 / 2 + F.sqrt(s2) * normal))).cast("int")
    size = float(stats["dict"] + 1)
    one = lambda i: F.least(F.lit(stats["dict"]), F.floor(F.pow(F.lit(size), unit(F.col("rec_id") * 64 + i, 4))) - 1).cast("long")
    rows = rows.withColumn("length", F.least(F.lit(stats["domain"]), length)).withColumn("k", F.least(F.lit(1000), k))
    start = F.floor(unit(F.col("rec_id"), 2) * (F.lit(stats["domain"] + 1) - F.col("length"))).cast("long")
    rows = rows.withColumn("t_start", start)
    return rows.select("rec_id", "t_start", (F.col("t_start") + F.col("length")).alias("t_end"), F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("k")), one)), False).alias("elements"))


def random_stats(low: dict[str, float], high: dict[str, float], seed: int, accept: Callable[[dict], bool] = lambda s: True, tries: int = 100) -> dict[str, float]:
    """Statistics between two templates, up to 10 % beyond, until they are accepted."""
    rng = np.random.default_rng(seed)
    for _ in range(tries):
        found = {k: float(rng.uniform(0.9 * min(low[k], high[k]), 1.1 * max(low[k], high[k]))) for k in low}
        if accept(found):
            return found
    raise ValueError("no statistics were accepted")


# ---- workloads


def frequency_buckets(postings: DataFrame, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """(bucket, elem_id, freq): elements whose share of the objects, in percent, lies in (lo, hi]."""
    freq = postings.groupBy("elem_id").agg(F.count("*").alias("freq"))
    card = postings.agg(F.countDistinct("rec_id").alias("card"))
    share = F.col("freq") * 100.0 / F.col("card")
    hits = F.array_compact(F.array(*(F.when((share > lo) & (share <= hi), F.lit(i).cast("long")) for i, (lo, hi) in enumerate(ranges))))
    return freq.crossJoin(F.broadcast(card)).select(F.explode(hits).alias("bucket"), "elem_id", "freq")  # one row


def queries_from_objects(postings: DataFrame, every: int, extent: int, n: int = 3, ranges: Sequence[tuple[float, float]] | None = None, skew: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """query_elems of queries that have a result: every ``every``-th object gives ``n`` of its
    elements (of given frequency buckets), and a query of ``extent`` that overlaps it inside the
    window of the domain, where the object reaches that window."""
    mine = postings.where(F.col("rec_id") % every == 0)
    if ranges is not None:
        mine = mine.join(frequency_buckets(postings, ranges).select("elem_id").distinct(), "elem_id", "left_semi")
    base = postings.agg(F.min("t_start").alias("g0"), F.max("t_end").alias("g1"))
    order = Window.partitionBy("rec_id").orderBy(draw(F.col("rec_id") * 31 + F.col("elem_id")), "elem_id")
    some = mine.withColumn("i", F.row_number().over(order)).where(F.col("i") <= n).crossJoin(F.broadcast(base))  # one row
    width = F.col("g1") - F.col("g0")
    lo = F.greatest(F.col("g0") + F.floor(width * skew[0]).cast("long"), F.col("t_start") - extent)
    hi = F.greatest(lo, F.least(F.col("g0") + F.floor(width * skew[1]).cast("long") - extent, F.col("t_end")))
    start = lo + draw(F.col("rec_id"), 9) % (hi - lo + 1)
    w = Window.partitionBy("rec_id")
    return some.select(F.col("rec_id").alias("qid"), start.alias("q_start"), (start + extent).alias("q_end"), "elem_id", F.count("*").over(w).alias("n"))


def allocate(total: int, weights: Sequence[float]) -> list[int]:
    """Whole parts in proportion, by the largest remainders; ties to the earlier one."""
    exact = [total * w / sum(weights) for w in weights]
    out = [math.floor(x) for x in exact]
    for i in sorted(range(len(exact)), key=lambda i: (out[i] - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def select_by_results(elems: DataFrame, pairs: DataFrame, card: int, lo: float, hi: float) -> DataFrame:
    """The queries whose number of results lies in floor(lo * card)..ceil(hi * card)."""
    counts = elems.select("qid").distinct().join(pairs.groupBy("qid").agg(F.count("*").alias("results")), "qid", "left").fillna(0, ["results"])
    good = counts.where(F.col("results").between(math.floor(lo * card), math.ceil(hi * card))).select("qid")
    return elems.join(good, "qid", "left_semi")


def until_selected(make: Callable[[int], DataFrame], answer: Callable[[DataFrame], DataFrame], card: int, lo: float, hi: float, want: int, rounds: int = 100) -> DataFrame:
    """Batches of candidates until ``want`` queries have a number of results in range."""
    out, found = None, 0
    for i in range(rounds):
        batch = make(i)
        good = select_by_results(batch, answer(batch), card, lo, hi)
        out = good if out is None else out.unionByName(good)
        found += good.select("qid").distinct().count()
        if found >= want:
            break
    if found < want:
        raise ValueError(f"{found} of {want} queries found")
    keep = out.select("qid").distinct().orderBy("qid").limit(want)
    return out.join(keep, "qid", "left_semi")


def without_results(elems: DataFrame, answer: Callable[[DataFrame], DataFrame], one_task: int = ONE_TASK) -> DataFrame:
    """Elements of one query with the extent of the next one in id order, where that has no result.
    Beyond ``one_task`` queries the order is by ranges, and the last of a range looks at the first
    of the next."""
    heads = elems.select("qid", "q_start", "q_end").distinct()
    n = heads.count()
    this = F.struct("q_start", "q_end")
    if n <= one_task:
        moved = heads.select("qid", F.lead(this).over(Window.orderBy("qid")).alias("to"))
    else:
        keyed = in_ranges(heads, F.col("qid"), n)
        firsts = keyed.groupBy("range").agg(F.min_by(this, "qid").alias("first"))
        firsts = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("next"))
        here = F.lead(this).over(Window.partitionBy("range").orderBy("qid"))
        moved = keyed.join(F.broadcast(firsts), "range").select("qid", F.coalesce(here, "next").alias("to"))  # a row for each range
    moved = moved.where("to is not null").select("qid", F.col("to.q_start").alias("s"), F.col("to.q_end").alias("e"))
    mixed = elems.join(moved, "qid").select("qid", F.col("s").alias("q_start"), F.col("e").alias("q_end"), "elem_id", "n")
    return mixed.join(answer(mixed).select("qid").distinct(), "qid", "left_anti")


_EIGHT = [(0, 100), (0, 0.0001), (0.0001, 0.001), (0.001, 0.01), (0.01, 0.1), (0.1, 1), (1, 10), (10, 100)]
_SIX = [(0, 0.001), (0.001, 0.01), (0.01, 0.1), (0.1, 1), (1, 10), (10, 100)]
_ANY = {"cnt": [1, 2, 3, 4, 5, 6, 7, 8, 9], "freqs": _EIGHT, "ext": _SIX, "skew": (0, 100)}
#: Number of queries, numbers of elements, and ranges in percent of element
#: frequencies, extents, places and, where given, results.
WORKLOADS = {
    "BASE": {"num": 100, "cnt": [3], "freqs": [(0, 100)], "ext": [(0.1, 0.1)], "skew": (0, 100)},
    "LOW": {"num": 200, "cnt": [3], "freqs": [(0, 0.1), (0, 0.01), (0, 0.001)], "ext": [(0.1, 0.1)], "skew": (0, 100)},
    "HIGH": {"num": 100, "cnt": [3], "freqs": [(10, 100), (1, 10), (0.1, 1)], "ext": [(0.1, 0.1)], "skew": (0, 100)},
    "SHORT": {"num": 100, "cnt": [3], "freqs": [(0, 100)], "ext": [(0, 0.1)], "skew": (0, 100)},
    "LONG": {"num": 100, "cnt": [3], "freqs": [(0, 100)], "ext": [(0.1, 10)], "skew": (0, 100)},
    "FEW": {"num": 100, "cnt": [1, 2], "freqs": [(0, 100)], "ext": [(0.1, 0.1)], "skew": (0, 100)},
    "MANY": {"num": 100, "cnt": [4, 5, 6, 7, 8, 9], "freqs": [(0, 100)], "ext": [(0.1, 0.1)], "skew": (0, 100)},
    "RND": {"num": 700, **_ANY},
    "RND2": {"num": 200, "cnt": _ANY["cnt"], "freqs": [(0, 100)], "ext": [(0, 100)], "skew": (0, 100)},
    "NORESULTS": {"num": 30, "select": (0, 0), **_ANY},
    "FEWRESULTS": {"num": 10, "select": (0, 0.001), **_ANY},
    "MANYRESULTS": {"num": 10, "select": (5, 100), **_ANY},
    "SELECTIVEWIDE": {"num": 100, "cnt": [3], "freqs": [(0, 0.01), (0, 0.001)], "ext": [(1, 10)], "skew": (0, 100)},
    "BROADNARROW": {"num": 3, "cnt": [1, 2], "freqs": [(1, 100)], "ext": [(0, 0.01), (0, 0.001)], "skew": (0, 100)},
    "HOT": {"num": 100, "cnt": [3], "freqs": [(0, 0.01)], "ext": [(5, 10)], "skew": (90, 100)},
    "COLD": {"num": 3, "cnt": [3], "freqs": [(1, 100)], "ext": [(0, 0.01)], "skew": (0, 80)},
    "SELECTIVE": {"num": 200, "cnt": [1], "freqs": [(0, 0.1)], "ext": [(0.1, 100)], "skew": (0, 100)},
    "BROAD": {"num": 100, "cnt": [1, 2, 3], "freqs": [(0, 100)], "ext": [(0, 0.1)], "skew": (0, 100)},
    "H1": {"num": 200, "cnt": [1, 2, 3], "freqs": [(0, 0.01)], "ext": [(5, 10)], "skew": (90, 100)},
    "H2": {"num": 100, "cnt": [3], "freqs": [(0, 10)], "ext": [(0.1, 5)], "skew": (40, 70)},
    "H3": {"num": 100, "cnt": [2, 3], "freqs": [(0, 100)], "ext": [(0.01, 0.01)], "skew": (0, 40)},
}


def drawn_queries(postings: DataFrame, pattern: dict, every: int, salt: int = 0) -> DataFrame:
    """query_elems after a pattern, one query at most for every ``every``-th object. Each place for
    an element draws a range of frequencies, and from it one of the object's elements not drawn
    yet; an object that has none there, or does not reach the window of time, gives no query."""
    freq = postings.groupBy("elem_id").agg(F.count("*").alias("freq"))
    base = postings.agg(F.min("t_start").alias("g0"), F.max("t_end").alias("g1"), F.countDistinct("rec_id").alias("card"))
    mine = postings.where(F.col("rec_id") % every == 0).join(freq, "elem_id").crossJoin(F.broadcast(base))  # one row
    one = F.struct(draw(F.col("rec_id") * 31 + F.col("elem_id"), salt).alias("d"), "elem_id", (F.col("freq") * 100.0 / F.col("card")).alias("share"))
    o = mine.groupBy("rec_id", "t_start", "t_end", "g0", "g1").agg(F.sort_array(F.collect_list(one)).alias("own"))
    pick = lambda values, s: F.get(values, (draw(F.col("rec_id"), s + salt) % F.size(values)).cast("int"))
    ranges = lambda r: F.array(*(F.struct(F.lit(float(a)).alias("lo"), F.lit(float(z)).alias("hi")) for a, z in r))
    freqs = ranges(pattern["freqs"])

    def place(acc: Column, j: Column) -> Column:
        want = F.get(freqs, (draw(F.col("rec_id") * 16 + j, salt) % F.size(freqs)).cast("int"))
        fit = F.filter("own", lambda e: (e["share"] > want["lo"]) & (e["share"] <= want["hi"]) & ~F.array_contains(acc, e["elem_id"]))
        return F.when(F.size(fit) > 0, F.concat(acc, F.array(F.get(fit, 0)["elem_id"])))

    o = o.withColumn("k", pick(F.array(*map(F.lit, pattern["cnt"])), 1)).where(F.col("k") <= F.size("own"))
    o = o.withColumn("elems", F.aggregate(F.sequence(F.lit(1), F.col("k")), F.array().cast("array<bigint>"), place)).where("elems is not null")
    width = (F.col("g1") - F.col("g0")).cast("double")
    o = o.withColumn("x", pick(ranges(pattern["ext"]), 2))
    lo, hi = F.floor(F.col("x.lo") / 100 * width), F.floor(F.col("x.hi") / 100 * width)
    o = o.withColumn("ext", F.greatest(F.lit(1), lo + draw(F.col("rec_id"), 3 + salt) % (hi - lo + 1)).cast("long"))
    w0, w1 = (F.col("g0") + F.floor(width * (x / 100)).cast("long") for x in pattern["skew"])
    first = F.greatest(F.col("g0"), F.col("t_start") - F.col("ext"), w0 - F.col("ext"))
    last = F.least(F.col("g1") - F.col("ext"), F.col("t_end"), w1)
    o = o.where((F.col("t_end") >= w0) & (F.col("t_start") <= w1)).withColumn("s0", first).withColumn("s1", last).where("s0 <= s1")
    start = F.col("s0") + draw(F.col("rec_id"), 4 + salt) % (F.col("s1") - F.col("s0") + 1)
    return o.select(F.col("rec_id").alias("qid"), start.alias("q_start"), (start + F.col("ext")).alias("q_end"), F.explode("elems").alias("elem_id"), F.size("elems").cast("long").alias("n"))


def named_workload(postings: DataFrame, name: str, every: int, answer: Callable[[DataFrame], DataFrame] | None = None, total: int | None = None) -> DataFrame:
    """query_elems and ``workload`` of a named pattern, or of several joined by ``+`` that take
    objects in turn. ``total`` queries are shared out by the patterns' numbers. Patterns with a
    range of results need ``answer``, which runs a workload."""
    names = name.split("+")
    counts = allocate(total, [WORKLOADS[n]["num"] for n in names]) if total else [None] * len(names)
    out = None
    for i, (part, count) in enumerate(zip(names, counts, strict=True)):
        pattern = WORKLOADS[part]
        turn = F.expr(f"(rec_id div {every}) % {len(names)} = {i}")
        own = drawn_queries(postings, pattern, every, 20 * i).join(postings.select("rec_id").distinct().where(turn), F.col("qid") == F.col("rec_id"), "left_semi")
        if "select" in pattern:
            if answer is None:
                raise ValueError(f"{part} needs a way to answer queries")
            lo, hi = (x / 100 for x in pattern["select"])
            own = without_results(own, answer) if hi == 0 else select_by_results(own, answer(own), postings.select("rec_id").distinct().count(), lo, hi)
        if count is not None:
            own = own.join(own.select("qid").distinct().orderBy("qid").limit(count), "qid", "left_semi")
        own = own.withColumn("workload", F.lit(part))
        out = own if out is None else out.unionByName(own)
    return out


def shuffled(elems: DataFrame, seed: int = 42, one_task: int = ONE_TASK) -> DataFrame:
    """New query ids in an order by draw; by ranges of it beyond ``one_task`` queries."""
    heads = elems.select("qid").distinct().withColumn("drawn", draw(F.col("qid"), seed))
    n = heads.count()
    if n <= one_task:
        fresh = heads.select("qid", (F.row_number().over(Window.orderBy("drawn", "qid")) - 1).cast("long").alias("fresh"))
    else:
        keyed = in_ranges(heads, F.struct("drawn", "qid"), n)
        within = F.row_number().over(Window.partitionBy("range").orderBy("drawn", "qid"))
        fresh = keyed.join(F.broadcast(summed_before(keyed, F.lit(1))), "range").select("qid", (F.col("before") + within - 1).cast("long").alias("fresh"))
    return elems.join(fresh, "qid").drop("qid").withColumnRenamed("fresh", "qid")


def non_empty(elems: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, sound): whether the object that a generated query came from answers it."""
    own = postings.join(elems, (F.col("rec_id") == F.col("qid")) & (postings["elem_id"] == elems["elem_id"])).where(overlaps())
    return own.groupBy("qid", "n").agg(F.count("*").alias("met")).select("qid", (F.col("met") == F.col("n")).alias("sound"))
