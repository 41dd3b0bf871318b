"""Exact dedup by a heavy-hitter split.

Misra-Gries counters over the text digests name every digest that may own a large share of the
rows. Those few are counted exactly, and the verified winners are broadcast, so that copies of a
very common text are settled where they are read. All other digests, none of which can own more
than ``2 / (counters + 1)`` of the rows, take an ordinary pre-aggregated shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

COUNTERS = 1024


def normalised(text):
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def shrink(counts: pd.Series, counters: int) -> pd.Series:
    """The Misra-Gries reduction: take the next largest count off all, keep what stays positive."""
    if len(counts) <= counters:
        return counts
    counts = counts.sort_values(ascending=False)
    counts = counts - counts.iloc[counters]
    return counts[counts > 0]


def misra_gries(counters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.Series(dtype="int64")
        for batch in batches:
            kept = shrink(kept.add(batch["digest"].value_counts(), fill_value=0).astype("int64"), counters)
        yield pd.DataFrame({"digest": kept.index.astype(str), "low": kept.to_numpy("int64")})

    return run


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(digest, keep_id, group_size)`` of the digests that own over ``2 / (counters + 1)`` of the
    rows; exact counts, at most ``counters + 1`` rows whatever the input.

    Each partition's counters miss at most ``1 / (counters + 1)`` of its rows for any digest, so a
    digest above the threshold keeps a summed lower count of at least ``n / (counters + 1)``, and
    at most ``counters + 1`` digests can have that much.
    """
    n = digests.count()
    low = (
        digests.select("digest").mapInPandas(misra_gries(counters), "digest string, low long")
        .groupBy("digest").agg(F.sum("low").alias("low"))
        .where(F.col("low") * (counters + 1) >= n)
        .select("digest")
    )
    return (
        digests.join(F.broadcast(low), "digest")
        .groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") * (counters + 1) >= 2 * n)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is empty text; null ids lose to any other id and a group of null ids only keeps
    all of them; rows that repeat an id with an equal text share their decision; an empty table
    gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    digests = scratch.write(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest")), "digests"
    )
    heavy = scratch.write(heavy_digests(digests, counters), "heavy")
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    hot = marked.where("group_size is not null")
    rest = marked.where("group_size is null").select("digest", "doc_id")
    groups = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    cold = rest.join(groups, "digest")
    return hot.unionByName(cold.select(*hot.columns)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""
