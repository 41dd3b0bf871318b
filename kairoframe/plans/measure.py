"""Measured runs of configurations: what score files hold and what the cost model learns from."""

from __future__ import annotations

import time
from collections.abc import Sequence
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import costmodel, skyline, stats
from ..sources import files
from ..sources.stored import Files
from . import engine, schema
from .layout import StoredLayout

REPEATS = 3
#: Bytes of a row of a layout: two ids and two times.
ROW = 24


def category(config: str) -> str:
    first = schema.parse(config)[0]
    return "bands" if first.band_range else first.hybrid and "hybrid" or first.refine and "refine" or first.split and "split" or first.slice and "slice" or first.method[0]


def measured(spark: SparkSession, name: str, postings: DataFrame, workload: str, elems: DataFrame, config: str, folder: str, repeats: int = REPEATS) -> tuple:
    """One score row. A single method's layout is written to ``folder`` and asked from there, so
    that construction and queries are told apart; composed ones are built within the query."""
    spec = schema.parse(config)
    plain = len(spec) == 1 and spec[0].method and not spec[0].fanout and not spec[0].band_range
    began = time.perf_counter()
    if plain:
        layout = StoredLayout(spark, folder, ";".join(spec[0].method)).create(postings)
        entries, answer = layout.size().first()[0], lambda: layout.query(elems)
    else:
        entries, answer = postings.count(), lambda: engine.answer(postings, elems, config)
    construction = time.perf_counter() - began
    seconds, result = [], None
    for _ in range(max(1, repeats)):
        began = time.perf_counter()
        result = answer().agg(F.bit_xor("rec_id")).first()[0] or 0
        seconds.append(time.perf_counter() - began)
    asked = elems.select("qid").distinct().count()
    return name, workload, result, entries * ROW / 1e6, construction, asked / max(median(seconds), 1e-9), category(config), config


def run_set(spark: SparkSession, name: str, postings: DataFrame, workloads: dict[str, DataFrame], configs: Sequence[str], scores: str, folder: str, repeats: int = REPEATS) -> DataFrame:
    """Runs every configuration on every workload that the score file does not hold yet, appends a
    row after each run, and returns all rows."""
    done = set()
    if Files(spark).exists(scores):
        done = {tuple(r) for r in files.read_scores(spark, scores).select("objects", "queries", "schema").collect()}
    for workload, elems in workloads.items():
        for i, config in enumerate(configs):
            if (name, workload, config) not in done:
                row = measured(spark, name, postings, workload, elems, config, f"{folder}/{workload}-{i}", repeats)
                files.write_tsv(spark.createDataFrame([row], files.SCORE_SCHEMA).coalesce(1), scores)
    return files.read_scores(spark, scores)


def disagreements(scores: DataFrame) -> DataFrame:
    """Workloads whose configurations gave different answers."""
    results = scores.select(F.concat_ws("/", "objects", "queries").alias("workload"), F.lit(0).alias("results"), F.col("xor_result").alias("xor_ids"))
    return skyline.consistent(results)


def features_of(spark: SparkSession, postings: DataFrame, elems: DataFrame, configs: Sequence[str]) -> DataFrame:
    rows = [(c, schema.encode(schema.parse(c)[0])) for c in configs]
    encodings = spark.createDataFrame(rows, "config string, encoding array<double>")
    return costmodel.features(stats.summary(postings), stats.extent_bins(postings), stats.element_bins(postings), stats.query_stats(elems, postings), encodings)


def training_rows(spark: SparkSession, postings: DataFrame, elems: DataFrame, scores: DataFrame) -> DataFrame:
    """Features of every query under every measured configuration, with the logs of its seconds and bytes."""
    runs = scores.select(F.col("schema").alias("config"), F.log10(1 / F.col("qps")).alias("throughput_log"), F.log10(F.col("size_mb") * 1e6).alias("size_log"))
    configs = sorted({r[0] for r in runs.select("config").distinct().collect()})
    return features_of(spark, postings, elems, configs).join(F.broadcast(runs), "config")  # a row for each run


def learn(spark: SparkSession, postings: DataFrame, elems: DataFrame, scores: DataFrame, **over) -> costmodel.Network:
    return costmodel.train_frame(training_rows(spark, postings, elems, scores), **over)[0]


def accuracy(spark: SparkSession, postings: DataFrame, elems: DataFrame, scores: DataFrame, net: costmodel.Network) -> DataFrame:
    """By configuration: how far predictions are from what was measured."""
    rows = training_rows(spark, postings, elems, scores).withColumnRenamed("throughput_log", "measured_log")
    found = costmodel.predict(rows, net, ("qid", "config", "measured_log"))
    return costmodel.accuracy(found, ["config"], "measured_log", "throughput_log")
