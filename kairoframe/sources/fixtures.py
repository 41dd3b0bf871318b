"""Object collections derived from ordinary tables: rows of (rec_id, t_start, t_end, elem)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a lifespan; their words are the elements."""
    start = F.col("doc_id") * 7919 % 100000
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    return (
        _table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("rec_id"), start.alias("t_start"), (start + F.col("n_chars")).alias("t_end"), F.explode(words).alias("elem"))
        .where("elem <> ''")
    )


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day; their property is the element."""
    second = F.expr("unix_micros(cast(ts as timestamp)) div 1000000") - 1704067200
    rows = _table(spark, sf_dir, "events").select(
        (F.col("user_id") * 1000 + F.datediff("ts", F.lit("2024-01-01"))).alias("rec_id"), second.alias("t"), F.get_json_object("props", "$.k").cast("long").alias("elem")
    )
    return _grouped(rows)


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines; their parts are the elements."""
    day = F.datediff("l_shipdate", F.lit("1995-01-01")).cast("long")
    return _grouped(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec_id"), day.alias("t"), F.col("l_partkey").alias("elem")))


def _grouped(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("rec_id").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.collect_set("elem").alias("elems"))
    return grouped.select("rec_id", "t_start", "t_end", F.explode("elems").alias("elem"))


FIXTURES = {"archive": archive, "session": session, "basket": basket}

#: The same three in SQL: relation ``tok(rec_id, t_start, t_end, elem)``.
SQL = {
    "archive": r"""tok AS (SELECT DISTINCT doc_id AS rec_id, (doc_id * 7919) % 100000 AS t_start, (doc_id * 7919) % 100000 + n_chars AS t_end, elem
        FROM (SELECT doc_id, n_chars, unnest(string_split_regex(lower(text), '[^a-z]+')) AS elem FROM documents) WHERE elem <> '')""",
    "session": r"""ev AS (SELECT user_id * 1000 + date_diff('day', date '2024-01-01', ts::DATE) AS rec_id, epoch_us(ts) // 1000000 - 1704067200 AS t,
        json_extract_string(props, '$.k')::BIGINT AS elem FROM events),
        span AS (SELECT rec_id, min(t) AS t_start, max(t) AS t_end FROM ev GROUP BY rec_id),
        tok AS (SELECT DISTINCT rec_id, t_start, t_end, elem FROM ev JOIN span USING (rec_id) WHERE elem IS NOT NULL)""",
    "basket": r"""ev AS (SELECT l_orderkey AS rec_id, date_diff('day', date '1995-01-01', l_shipdate::DATE) AS t, l_partkey AS elem FROM lineitem),
        span AS (SELECT rec_id, min(t) AS t_start, max(t) AS t_end FROM ev GROUP BY rec_id),
        tok AS (SELECT DISTINCT rec_id, t_start, t_end, elem FROM ev JOIN span USING (rec_id))""",
}
