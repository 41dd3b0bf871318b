"""Objects, dictionary and postings.

objects(rec_id, t_start, t_end, elements), postings(rec_id, elem_id, t_start, t_end); intervals are
closed. Element ids are frequency ranks: 0 is the most frequent, so a high id is a rare element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many distinct elements one sorted task ranks them; beyond, ranges do.
ONE_TASK = 2_000_000
RANGES = 512


def dictionary(tokens: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``(elem, elem_id, freq)`` of ``tokens(rec_id, elem, ...)``, by frequency and then by element."""
    freq = tokens.groupBy("elem").agg(F.count("*").alias("freq"))
    n = freq.count()
    if n <= one_task:
        return freq.withColumn("elem_id", F.row_number().over(Window.orderBy(F.desc("freq"), "elem")).cast("long") - 1)
    return ranked(freq, n)


def in_ranges(rows: DataFrame, key: Column, n: int, ranges: int = RANGES) -> DataFrame:
    """rows + range: the number of the range of ``key`` that a row lies in, in the key's order.
    Split points come from a hash sample of bounded size, so that every use of the rows agrees."""
    share = max(1, n // (64 * ranges))
    sample = rows.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(share)) == 0)
    step = max(1, sample.count() // ranges)
    cuts = sample.withColumn("i", F.row_number().over(Window.orderBy("k"))).where(F.col("i") % step == 0).agg(F.sort_array(F.collect_list("k")).alias("cuts"))
    keyed = rows.crossJoin(F.broadcast(cuts))  # one row of at most 64 x ranges points
    return keyed.withColumn("range", F.size(F.filter("cuts", lambda c: c < key))).drop("cuts")


def summed_before(keyed: DataFrame, value: Column) -> DataFrame:
    """(range, before): the sum of ``value`` over all ranges before, a row for each range."""
    sizes = keyed.groupBy("range").agg(F.sum(value).alias("size"))
    return sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))


def ranked(freq: DataFrame, n: int, ranges: int = RANGES) -> DataFrame:
    """The same ranks by ranges: counts per range, and a row number within each range."""
    keyed = in_ranges(freq, F.struct((-F.col("freq")).alias("f"), F.col("elem")), n, ranges)
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("freq"), "elem"))
    before = F.broadcast(summed_before(keyed, F.lit(1)))
    return keyed.join(before, "range").select("elem", "freq", (F.col("before") + within - 1).cast("long").alias("elem_id"))


def postings(tokens: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """postings of ``tokens(rec_id, t_start, t_end, elem)``; (rec_id, elem_id) is unique if (rec_id, elem) is."""
    words = dictionary(tokens) if words is None else words
    return tokens.join(words.select("elem", "elem_id"), "elem").select("rec_id", "elem_id", "t_start", "t_end")


def explode_objects(objects: DataFrame) -> DataFrame:
    return objects.select("rec_id", F.explode(F.array_distinct("elements")).alias("elem_id"), "t_start", "t_end")


def collect_objects(rows: DataFrame) -> DataFrame:
    """Objects of postings, or of any layout of them: replicas fall together."""
    return rows.groupBy("rec_id").agg(
        F.first("t_start").alias("t_start"), F.first("t_end").alias("t_end"), F.sort_array(F.collect_set("elem_id"), False).alias("elements")
    )


def domain(rows: DataFrame) -> DataFrame:
    """One row (g0, g1): the least start and the greatest end."""
    return rows.agg(F.min("t_start").alias("g0"), F.max("t_end").alias("g1"))


def subset(objects: DataFrame, lo: int, hi: int) -> DataFrame:
    """Objects with only the elements in lo..hi, and without those that keep none."""
    kept = F.filter("elements", lambda x: (x >= lo) & (x <= hi))
    return objects.withColumn("elements", kept).where(F.size("elements") > 0)
