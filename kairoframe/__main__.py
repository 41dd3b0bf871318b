"""Commands over files: ``python -m kairoframe COMMAND ...``

query CONFIG OBJECTS QUERIES     results, count and checksum of each query file (joined by |)
update CONFIG OBJECTS MORE QUERIES      the same after appending MORE
delete|softdelete CONFIG OBJECTS IDS QUERIES    the same without the ids
analyze OBJECTS [QUERIES]        statistics as JSON
generate-O CARD DOMAIN DICT OUT  objects
generate-Q NAME EVERY OBJECTS OUT       a named workload, as Parquet
generate-OQ CARD DOMAIN DICT NAME EVERY OUT     both, to OUT/objects and OUT/queries
generate-O-stats LOW HIGH SEED          statistics between two of them, given as JSON
convert TSV OUT SCHEMA           training rows as Parquet, in train, val and test
measure OBJECTS QUERIES CONFIGS SCORES  runs each configuration (one a line) that SCORES lacks, and adds its score
learn OBJECTS QUERIES SCORES MODEL      a cost model of the measured runs
predict OBJECTS QUERIES CONFIGS MODEL   seconds a query that the model expects
accuracy OBJECTS QUERIES SCORES MODEL   how far it is from the measured runs
synthesize OBJECTS QUERIES MODEL [GROUPS]       the configurations that the model expects to be cheapest
score FILES [FILTER]             best runs of score files
sequence FILE FLOW               the steps of a flow in a configuration file, one after the other

CONFIG is JSON, or @FILE to read it from a file.
"""

from __future__ import annotations

import json
import shlex
import sys
import time

from pyspark.sql import functions as F

from .operators import costmodel, generate, query, skyline, stats
from .operators.postings import explode_objects
from .plans import config as files_of_config
from .plans import measure, synthesis
from .plans.engine import Collection
from .session import session
from .sources import files


def _config(text: str) -> str:
    return files_of_config.composed(text[1:]) if text.startswith("@") else text


def _report(collection: Collection, spark, config: str, paths: str) -> None:
    queries = files.read_queries(spark, paths)
    for (name,) in sorted(queries.select("workload").distinct().collect()):
        began = time.perf_counter()
        pairs = collection.query(queries.where(F.col("workload") == name).drop("workload"), config)
        n, x = pairs.agg(F.count("*"), F.bit_xor("rec_id")).first()
        print(f"{name}\t{n}\t{x or 0}\t{time.perf_counter() - began:.3f} s")


def _model(spark, command: str, objects: str, queries: str, *rest: str) -> None:
    """The commands that measure configurations or predict their cost."""
    p = explode_objects(files.read_objects(spark, objects))
    asked = files.read_queries(spark, queries)
    one = query.query_elems(asked.withColumn("qid", F.xxhash64("workload", "qid")).drop("workload"))
    lines = lambda path: [r[0] for r in spark.read.text(path).where(F.trim("value") != "").collect()]
    if command == "measure":
        workloads = {n: query.query_elems(asked.where(F.col("workload") == n).drop("workload")) for (n,) in sorted(asked.select("workload").distinct().collect())}
        name = objects.rstrip("/").rsplit("/", 1)[-1]
        scores = measure.run_set(spark, name, p, workloads, lines(rest[0]), rest[1], f"{rest[1].rstrip('/')}.layouts")
        scores.orderBy("objects", "queries", F.desc("qps")).show(100, False)
        if measure.disagreements(scores).limit(1).count():
            raise SystemExit("configurations gave different answers")
        return
    if command == "learn":
        measure.learn(spark, p, one, files.read_scores(spark, rest[0])).save(rest[1])
        return
    net = costmodel.Network.load(rest[-1 if command in ("predict", "accuracy") else 0])
    if command == "predict":
        costmodel.aggregate(costmodel.predict(measure.features_of(spark, p, one, lines(rest[0])), net)).orderBy("sec_per_query").show(100, False)
    elif command == "accuracy":
        measure.accuracy(spark, p, one, files.read_scores(spark, rest[0]), net).show(100, False)
    else:
        groups = rest[1].split(",") if len(rest) > 1 else ("pure", "dict2")
        for text, seconds in synthesis.suggestions(synthesis.synthesize(spark, p, one, net, groups)):
            print(f"{seconds:.6f}\t{text}")


def run(args: list[str]) -> None:
    if not args or args[0] == "help":
        print(__doc__)
        return
    command, rest = args[0], args[1:]
    if command == "sequence":
        flow = files_of_config.load(rest[0])["flows"][rest[1]]
        for _ in range(max(1, flow.get("repeat", 1))):
            for step in flow["steps"]:
                run(shlex.split(step))
        return
    spark = session()
    if command == "query":
        _report(Collection(files.read_objects(spark, rest[1])), spark, _config(rest[0]), rest[2])
    elif command in ("update", "delete", "softdelete"):
        before = Collection(files.read_objects(spark, rest[1]))
        if command == "update":
            after = before.update(files.read_objects(spark, rest[2]))
        else:
            ids = files.read_ids(spark, rest[2])
            after = before.delete(ids) if command == "delete" else before.soft_delete(ids)
        _report(after, spark, _config(rest[0]), rest[3])
    elif command == "analyze":
        p = explode_objects(files.read_objects(spark, rest[0]))
        frames = [stats.summary(p), stats.element_bins(p), stats.extent_bins(p)]
        if len(rest) > 1:
            frames.append(stats.query_stats(query.query_elems(files.read_queries(spark, rest[1])), p))
        for frame in frames:
            for line in frame.toJSON().toLocalIterator():
                print(line)
    elif command == "generate-O":
        files.write_objects(generate.objects(spark, *map(int, rest[:3])), rest[3])
    elif command == "generate-Q":
        p = explode_objects(files.read_objects(spark, rest[2]))
        generate.named_workload(p, rest[0], int(rest[1]), lambda e: query.core(p, e)).write.mode("overwrite").parquet(rest[3])
    elif command == "generate-OQ":
        files.write_objects(generate.objects(spark, *map(int, rest[:3])), f"{rest[5]}/objects")
        run(["generate-Q", rest[3], rest[4], f"{rest[5]}/objects", f"{rest[5]}/queries"])
    elif command == "generate-O-stats":
        print(json.dumps(generate.random_stats(json.loads(rest[0]), json.loads(rest[1]), int(rest[2]))))
    elif command == "convert":
        files.tsv_to_parquet(spark, *rest[:3])
    elif command in ("measure", "learn", "predict", "accuracy", "synthesize"):
        _model(spark, command, *rest)
    elif command == "score":
        rows = files.read_scores(spark, rest[0])
        rows = rows.where(skyline.matching(F.col("schema"), rest[1])) if len(rest) > 1 else rows
        skyline.relative(skyline.dedup(rows)).orderBy("objects", "queries", F.desc("qps")).show(100, False)
    else:
        raise SystemExit(f"unknown command {command}\n{__doc__}")


if __name__ == "__main__":
    run(sys.argv[1:])
