"""Statistics of collections, workloads and results.

Where logarithms of zero could arise they are null; ties always have a second key; card, domain
and dictionary stay exact integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .postings import ONE_TASK, in_ranges, summed_before

ELEMENT_BINS = 12
EXTENT_BINS = 8
MOST_ELEMENTS = 9
LEAST_DEVIATION = 0.1
#: Bytes of an id, of a time and of an element in the size estimate.
WIDTHS = {"id": 4, "time": 4, "element": 4}


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def element_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("elem_id").agg(F.count("*").alias("freq"))


def object_sizes(postings: DataFrame) -> DataFrame:
    """One row per object: its length and its number of elements."""
    return postings.groupBy("rec_id", "t_start", "t_end").agg(F.count("*").alias("n_elems")).withColumn("length", F.col("t_end") - F.col("t_start"))


def summary(postings: DataFrame) -> DataFrame:
    """Cardinality, domain, dictionary (greatest id and distinct count) and estimated bytes."""
    o = object_sizes(postings).agg(
        F.count("*").alias("card"), F.min("t_start").alias("g0"), F.max("t_end").alias("g1"), F.sum("n_elems").alias("entries")
    )
    d = postings.agg(F.max("elem_id").alias("dict"), F.countDistinct("elem_id").alias("dict_distinct"))
    both = o.crossJoin(F.broadcast(d))  # one row each
    size = F.col("card") * (WIDTHS["id"] + 2 * WIDTHS["time"]) + F.col("entries") * WIDTHS["element"]
    return both.select(
        "card", (F.col("g1") - F.col("g0")).alias("domain"), "dict", "dict_distinct", "entries", size.cast("long").alias("bytes"),
        log10(F.col("card").cast("double")).alias("card_log"), log10((F.col("g1") - F.col("g0")).cast("double")).alias("domain_log"), log10(F.col("dict").cast("double")).alias("dict_log"),
    )


def element_bins(postings: DataFrame, bins: int = ELEMENT_BINS) -> DataFrame:
    """Bins at log-spaced positions of the frequency order: lo and hi rank, greatest frequency, the
    part of the dictionary and of the objects, and the drop against the bin before. Ranks come from
    the element ids, which are frequency ranks already; no sort is needed."""
    freq = element_frequency(postings)
    sizes = freq.agg(F.count("*").alias("n")).crossJoin(F.broadcast(postings.agg(F.countDistinct("rec_id").alias("card"))))
    edge = lambda i: F.floor(F.pow(F.lit(10.0), F.round(i / F.lit(float(bins)) * F.log10("n"), 12))).cast("long")
    ranges = sizes.select("n", "card", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    ranges = ranges.select("n", "card", "bin", F.when(F.col("bin") == 0, F.lit(1)).otherwise(edge(F.col("bin")) + 1).cast("long").alias("lo"), edge(F.col("bin") + 1).alias("hi")).where("lo <= hi")
    ranked = freq.select((F.col("elem_id") + 1).alias("rank"), "freq")
    met = ranked.join(F.broadcast(ranges), F.col("rank").between(F.col("lo"), F.col("hi")))  # a dozen rows
    out = met.groupBy("bin", "lo", "hi", "n", "card").agg(F.max("freq").alias("max_freq"))
    before = F.lag("max_freq").over(Window.orderBy("bin"))
    return out.select(
        F.col("bin").cast("long").alias("bin"), "lo", "hi", "max_freq",
        ((F.col("hi") - F.col("lo") + 1) / F.col("n")).alias("dict_ratio"), (F.col("max_freq") / F.col("card")).alias("post_ratio"), (F.col("max_freq") / before).alias("rel_drop"),
    )


def extent_bins(postings: DataFrame, bins: int = EXTENT_BINS, one_task: int = ONE_TASK) -> DataFrame:
    """Equal-count bins of the objects by (length, elements, id): lengths, mean number of elements
    and its log-normal deviation. The order is found by counts of equal (length, elements) pairs,
    beyond ``one_task`` of them by ranges, so that no task holds all objects or pairs."""
    objects = object_sizes(postings)
    kinds = objects.groupBy("length", "n_elems").agg(F.count("*").alias("k"))
    n = kinds.count()
    if n <= one_task:
        spans = kinds.withColumn("after", F.sum("k").over(Window.orderBy("length", "n_elems")))
    else:
        keyed = in_ranges(kinds, F.struct("length", "n_elems"), n)
        within = F.sum("k").over(Window.partitionBy("range").orderBy("length", "n_elems"))
        spans = keyed.join(F.broadcast(summed_before(keyed, F.col("k"))), "range").withColumn("after", F.col("before") + within).drop("range")
    spans = spans.withColumn("before", F.col("after") - F.col("k"))
    total = objects.agg(F.count("*").alias("card"))
    q, r = F.expr(f"card div {bins}"), F.expr(f"card % {bins}")
    edges = total.select("card", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin", (q * F.col("bin") + F.least(F.col("bin"), r)).alias("from"), (q * (F.col("bin") + 1) + F.least(F.col("bin") + 1, r)).alias("to")
    )
    met = spans.join(F.broadcast(edges), (F.col("before") < F.col("to")) & (F.col("after") > F.col("from")))  # eight rows
    part = met.withColumn("w", F.least("after", "to") - F.greatest("before", "from"))
    mean = F.sum(F.col("w") * F.col("n_elems")) / F.sum("w")
    ln = F.log(F.col("n_elems").cast("double"))
    var = F.sum(F.col("w") * ln * ln) / F.sum("w") - F.pow(F.sum(F.col("w") * ln) / F.sum("w"), F.lit(2.0))
    dev = mean * F.sqrt(F.exp(F.greatest(F.lit(0.0), var)) - 1)
    return part.groupBy("bin").agg(
        F.sum("w").cast("long").alias("objects"), F.min("length").alias("min_len"), F.max("length").alias("max_len"), mean.alias("avg_elems"), F.greatest(F.lit(LEAST_DEVIATION), dev).alias("dev_elems")
    ).withColumn("bin", F.col("bin").cast("long"))


def query_stats(elems: DataFrame, postings: DataFrame, most: int = MOST_ELEMENTS) -> DataFrame:
    """Per query: start and end relative to the domain, the extent's log, the number of elements,
    and the elements' rank logs relative to the dictionary's, rarest first, filled up with -1."""
    base = postings.agg(F.min("t_start").alias("g0"), F.max("t_end").alias("g1"), F.max("elem_id").alias("dict"))
    q = elems.groupBy("qid").agg(F.first("q_start").alias("q_start"), F.first("q_end").alias("q_end"), F.sort_array(F.collect_set("elem_id"), False).alias("elems"))
    q = q.crossJoin(F.broadcast(base))  # one row
    width = (F.col("g1") - F.col("g0")).cast("double")
    ranks = F.transform("elems", lambda e: F.log10((e + 1).cast("double")) / F.log10(F.col("dict").cast("double")))
    padded = F.slice(F.concat(ranks, F.array_repeat(F.lit(-1.0), most)), 1, most)
    return q.select(
        "qid", ((F.col("q_start") - F.col("g0")) / width).alias("start_rel"), ((F.col("q_end") - F.col("g0")) / width).alias("end_rel"),
        log10((F.col("q_end") - F.col("q_start")) / width).alias("extent_log"), F.size("elems").cast("long").alias("elem_count"),
        *(F.get(padded, i).alias(f"rank_{i}") for i in range(most)),
    )


def performance_stats(pairs: DataFrame, elems: DataFrame, postings: DataFrame) -> DataFrame:
    """Per query: results, selectivity in percent and its log; queries without results included."""
    card = postings.agg(F.countDistinct("rec_id").alias("card"))
    counts = elems.select("qid").distinct().join(pairs.groupBy("qid").agg(F.count("*").alias("results")), "qid", "left").fillna(0, ["results"])
    share = F.col("results") * 100.0 / F.col("card")
    return counts.crossJoin(F.broadcast(card)).select("qid", "results", share.alias("selectivity"), log10(share).alias("selectivity_log"))  # one row


def median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of the two middle values."""
    return rows.groupBy(key).agg(F.median(value).alias("median"))


def throughput(timings: DataFrame) -> DataFrame:
    """Queries over the sum of their median seconds, of ``timings(qid, seconds)``."""
    each = median(timings, "qid", "seconds")
    return each.agg((F.count("*") / F.sum("median")).alias("qps"), (F.sum("median") / F.count("*")).alias("sec_per_query"))
