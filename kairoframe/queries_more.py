"""Queries of sources and sinks, changes of stored layouts, generators and configurations: what is
written is read back, and the SQL tells it from the tables alone."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import generate, query, search, skyline, slices, stats
from .operators.postings import collect_objects, explode_objects
from .plans import schema
from .plans.engine import Collection
from .plans.layout import StoredLayout
from .queries import ASK, CORE, ORACLES, SCORES, _core_sql, _features, add, base, on, scores
from .sources import files
from .sources.stored import shared_root


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/kairoframe/files/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def told(o: DataFrame) -> DataFrame:
    return o.select("rec_id", "t_start", "t_end", F.size("elements").cast("long").alias("n_elems"), F.aggregate("elements", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


# ---- files: line numbers are ids

LINES = """, ob AS (SELECT rec_id, t_start, t_end, count(*) AS n_elems, sum(elem_id)::BIGINT AS sum_ids FROM p GROUP BY ALL),
nb AS (SELECT row_number() OVER (ORDER BY rec_id) - 1 AS rec_id, t_start, t_end, n_elems, sum_ids FROM ob),
qb AS (SELECT qid AS id, q_start, q_end, count(*) AS n_elems, sum(elem_id)::BIGINT AS sum_ids FROM q GROUP BY ALL)"""


def _lined(p: DataFrame) -> tuple[SparkSession, str]:
    spark = p.sparkSession
    path = fresh(spark, "objects")
    files.write_objects(collect_objects(p), path)
    return spark, path


@add("file_objects", base("basket", LINES) + "SELECT * FROM nb")
@on("basket")
def file_objects(p: DataFrame, q: DataFrame) -> DataFrame:
    return told(files.read_objects(*_lined(p)))


@add("file_intervals", base("session", LINES) + "SELECT rec_id, t_start, t_end FROM nb")
@on("session")
def file_intervals(p: DataFrame, q: DataFrame) -> DataFrame:
    return files.read_intervals(*_lined(p))


@add("file_ids", base("session") + "SELECT rec_id FROM obj WHERE rec_id % 3 = 1")
@on("session")
def file_ids(p: DataFrame, q: DataFrame) -> DataFrame:
    spark = p.sparkSession
    path = fresh(spark, "ids")
    p.where("rec_id % 3 = 1").select(F.col("rec_id").cast("string")).distinct().write.text(path)
    return files.read_ids(spark, path)


def _asked(q: DataFrame) -> DataFrame:
    return q.select("workload", "qid", "q_start", "q_end", F.size("elems").cast("long").alias("n_elems"), F.aggregate("elems", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


@add("file_queries", base("basket", LINES) + "SELECT 'all' AS workload, row_number() OVER (ORDER BY id) - 1 AS qid, q_start, q_end, n_elems, sum_ids FROM qb")
@on("basket")
def file_queries(p: DataFrame, q: DataFrame) -> DataFrame:
    path = fresh(p.sparkSession, "queries") + "/all.qry"
    files.write_queries(query.as_queries(q), path)
    return _asked(files.read_queries(p.sparkSession, path))


@add("file_workloads", base("session", LINES) + "SELECT 'w' || id % 3 AS workload, row_number() OVER (PARTITION BY id % 3 ORDER BY id) - 1 AS qid, q_start, q_end, n_elems, sum_ids FROM qb")
@on("session")
def file_workloads(p: DataFrame, q: DataFrame) -> DataFrame:
    """Several files as one set of workloads."""
    folder, every = fresh(p.sparkSession, "workloads"), query.as_queries(q)
    for i in range(3):
        files.write_queries(every.where(F.col("qid") % 3 == i), f"{folder}/w{i}.qry")
    return _asked(files.read_queries(p.sparkSession, "|".join(f"{folder}/w{i}.qry" for i in range(3))))


@add("file_workload_on_demand", base("basket") + "SELECT qid, count(*) AS n_elems, sum(elem_id)::BIGINT AS sum_ids FROM q GROUP BY qid")
@on("basket")
def file_workload_on_demand(p: DataFrame, q: DataFrame) -> DataFrame:
    """The second call reads what the first one made."""
    path, made = fresh(p.sparkSession, "demand"), []
    for _ in range(2):
        got = files.cached(p.sparkSession, path, lambda: made.append(1) or q)
    if len(made) != 1:
        raise RuntimeError("the workload was made again")
    return got.groupBy("qid").agg(F.count("*").alias("n_elems"), F.sum("elem_id").alias("sum_ids"))


_SCORE = ["objects", "queries", "xor_result", "size_mb", "construction_s", "qps", "category", "schema"]


@add("file_scores", SCORES + f"SELECT {', '.join(_SCORE)} FROM s")
def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score files, one appended to the other, read as one."""
    path, rows = fresh(spark, "scores"), scores(spark, sf_dir).select(*_SCORE)
    for i in range(2):
        files.write_tsv(rows.where(F.col("xor_result") % 2 == i), path)
    return files.read_scores(spark, path)


@add("score_merged", SCORES + "SELECT objects, queries, schema, max(qps) AS qps FROM s WHERE xor_result % 5 < 3 GROUP BY ALL")
def score_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files that share rows, merged; of equal runs the fastest."""
    folder, rows = fresh(spark, "merged"), scores(spark, sf_dir).select(*_SCORE)
    files.write_tsv(rows.where("xor_result % 5 < 2"), f"{folder}/a")
    files.write_tsv(rows.where("xor_result % 5 in (1, 2)"), f"{folder}/b")
    both = files.read_scores(spark, f"{folder}/a").unionByName(files.read_scores(spark, f"{folder}/b"))
    return skyline.dedup(both, ["objects", "queries", "schema"]).drop("category")


@add("score_not_done", SCORES + ", d AS (SELECT DISTINCT objects, queries, schema FROM s WHERE xor_result % 4 = 0) SELECT DISTINCT s.objects, s.queries, s.schema FROM s ANTI JOIN d USING (objects, queries, schema)")
def score_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return skyline.not_done(rows.select("objects", "queries", "schema").distinct(), rows.where("xor_result % 4 = 0"))


@add(
    "file_search_results",
    SCORES + """SELECT 'v' || xor_result % 3 AS variant, objects AS oq_file, '0-1' AS temporal_band, category AS template_id, schema AS synth_id, qps AS predicted_throughput, size_mb AS predicted_size,
    construction_s / 4 AS "i_enc-0", (xor_result % 8) / 8.0::DOUBLE AS "i_enc-1" FROM s""",
)
def file_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "search")
    rows = scores(spark, sf_dir).select(
        F.concat(F.lit("v"), F.col("xor_result") % 3).alias("variant"), F.col("objects").alias("oq_file"), F.lit("0-1").alias("temporal_band"), F.col("category").alias("template_id"),
        F.col("schema").alias("synth_id"), F.col("qps").alias("predicted_throughput"), F.col("size_mb").alias("predicted_size"),
        (F.col("construction_s") / 4).alias("i_enc-0"), (F.col("xor_result") % 8 / 8.0).alias("i_enc-1"),
    )
    files.write_tsv(rows, path)
    return files.read_search(spark, path, 2)


@add("file_stats_json", base("basket") + "SELECT count(DISTINCT rec_id) AS card, max(t_end) - min(t_start) AS domain, max(elem_id) AS dict, count(*) AS entries FROM p")
@on("basket")
def file_stats_json(p: DataFrame, q: DataFrame) -> DataFrame:
    """Statistics of collections, stored and found again by name."""
    path, own = fresh(p.sparkSession, "stats"), stats.summary(p)
    files.write_json(own.withColumn("name", F.lit("basket")).unionByName(own.withColumn("name", F.lit("other")).withColumn("card", F.col("card") + 1)), path)
    return files.read_stats_json(p.sparkSession, path, "basket").select("card", "domain", "dict", "entries")


@add("file_stats_tsv", base("session") + ", r AS (SELECT qid, count(*) AS results FROM res GROUP BY qid) SELECT qid, results FROM r")
@on("session")
def file_stats_tsv(p: DataFrame, q: DataFrame) -> DataFrame:
    path = fresh(p.sparkSession, "performance")
    files.write_tsv(stats.performance_stats(query.core(p, q), q, p).where("results > 0").select("qid", "results"), path)
    return files.read_tsv(p.sparkSession, path, "qid long, results long")


@add("file_training_rows", SCORES + "SELECT xor_result, count(*) AS n, sum(qps) AS qps FROM s GROUP BY xor_result")
def file_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a text file, shuffled into train, val and test: together they are all rows."""
    folder = fresh(spark, "training")
    files.write_tsv(scores(spark, sf_dir).select("xor_result", "qps"), f"{folder}/text")
    files.tsv_to_parquet(spark, f"{folder}/text", f"{folder}/parquet", "xor_result long, qps double")
    rows = spark.read.parquet(*(f"{folder}/parquet/{part}" for part in ("train", "val", "test")))
    return rows.groupBy("xor_result").agg(F.count("*").alias("n"), F.sum("qps").alias("qps"))


@add("objects_head_tail", base("basket", LINES) + ", c AS (SELECT floor(count(*) * 0.3)::BIGINT AS cut FROM nb) SELECT rec_id < cut AS head, count(*) AS objects, sum(n_elems)::BIGINT AS entries, min(rec_id) AS first FROM nb, c GROUP BY 1")
@on("basket")
def objects_head_tail(p: DataFrame, q: DataFrame) -> DataFrame:
    parts = files.head_tail(files.read_objects(*_lined(p)), 30)
    both = [part.withColumn("head", F.lit(i == 0)) for i, part in enumerate(parts)]
    return both[0].unionByName(both[1]).groupBy("head").agg(F.count("*").alias("objects"), F.sum(F.size("elements")).alias("entries"), F.min("rec_id").alias("first"))


@add("objects_sampled", base("session") + f"SELECT rec_id FROM obj WHERE {generate.draw_sql('rec_id', 42)} * 100.0::DOUBLE < 7 * {generate.MODULUS}")
@on("session")
def objects_sampled(p: DataFrame, q: DataFrame) -> DataFrame:
    return files.sample_ids(p.select("rec_id").distinct(), 7)


@add("queries_shuffled", base("session") + f"SELECT DISTINCT qid FROM q ORDER BY {generate.draw_sql('qid', 42)}, qid LIMIT 25")
@on("session")
def queries_shuffled(p: DataFrame, q: DataFrame) -> DataFrame:
    return files.shuffle_reduce(q.select("qid").distinct(), 25)


# ---- collections and stored layouts that change

_MORE = "SELECT rec_id + (SELECT max(rec_id) + 1 FROM p) AS rec_id, elem_id, t_start + 3 AS t_start, t_end + 3 AS t_end FROM p WHERE rec_id % 50 = 0"
_CHANGED = _core_sql(f"SELECT * FROM (SELECT rec_id, elem_id, t_start, t_end FROM p UNION ALL {_MORE}) WHERE rec_id % 10 <> 3 AND rec_id % 11 <> 4")


def _parts(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Objects, more of them, and the ids to delete and to mark as dead."""
    o = collect_objects(p)
    more = o.where("rec_id % 50 = 0").withColumn("t_start", F.col("t_start") + 3).withColumn("t_end", F.col("t_end") + 3)
    return o, more, F.col("rec_id") % 10 == 3, F.col("rec_id") % 11 == 4


@add("collection_changed", base("basket") + _CHANGED)
@on("basket")
def collection_changed(p: DataFrame, q: DataFrame) -> DataFrame:
    """The interface of a collection: update, delete, soft delete, then a query under a configuration."""
    o, more, gone, dead = _parts(p)
    grown = Collection(o).update(more)
    return grown.delete(grown.objects.where(gone)).soft_delete(grown.objects.where(dead)).query(query.as_queries(q), '{"method":"tif;slicing;a;static;16"}')


def _stored(method: str):
    def run(p: DataFrame, q: DataFrame) -> DataFrame:
        o, more, gone, dead = _parts(p)
        layout = StoredLayout(p.sparkSession, fresh(p.sparkSession, "layout"), method).create(p)
        grown = Collection(o).update(more).objects
        layout.update(explode_objects(grown.join(o.select("rec_id"), "rec_id", "left_anti")))
        layout.delete(grown.where(gone).select("rec_id"))
        layout.soft_delete(grown.where(dead).select("rec_id"))
        return layout.query(q)

    return run


for _name, _method in {
    "basic": "tif;basic", "grid": "tif;slicing;a;static;16", "grid_dynamic": "tif;slicing;a;dyn;1.2;0.6", "hint": "tif;hint;mrg;static;8", "hint_dynamic": "tif;hint;mrg;dyn;0.5;2.5",
    "irhint": "irhint;perf;8", "sharding": "tif;sharding;static;2",
}.items():
    add(f"stored_{_name}_changed", base("basket") + _CHANGED)(on("basket")(_stored(_method)))


@add("stored_compacted", base("session") + "SELECT count(*) AS entries, count(DISTINCT rec_id) AS objects FROM p WHERE rec_id % 11 <> 4")
@on("session")
def stored_compacted(p: DataFrame, q: DataFrame) -> DataFrame:
    """Tombstones turned into a delete."""
    layout = StoredLayout(p.sparkSession, fresh(p.sparkSession, "compacted"), "tif;basic").create(p)
    layout.soft_delete(p.where("rec_id % 11 = 4").select("rec_id"))
    layout.compact()
    return layout.data.rows().agg(F.count("*").alias("entries"), F.countDistinct("rec_id").alias("objects"))


# ---- generated workloads


def _from_objects(skew: tuple[float, float], ranges: str, n: int, every: int, extent: int) -> str:
    """SQL of queries that are made from objects."""
    place = generate.draw_sql("rec_id * 31 + elem_id")
    start = generate.draw_sql("rec_id", 9)
    lo, hi = skew
    return f""", fr AS (SELECT elem_id, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM obj) AS share FROM p GROUP BY elem_id),
    ok AS (SELECT elem_id FROM fr WHERE {ranges}),
    so AS (SELECT p.*, row_number() OVER (PARTITION BY rec_id ORDER BY {place}, elem_id) AS i FROM p JOIN ok USING (elem_id) WHERE rec_id % {every} = 0),
    lim AS (SELECT *, greatest(g0 + floor((g1 - g0) * {lo}::DOUBLE)::BIGINT, t_start - {extent}) AS lo, g0 + floor((g1 - g0) * {hi}::DOUBLE)::BIGINT - {extent} AS cap FROM so, dom WHERE i <= {n}),
    win AS (SELECT *, greatest(lo, least(cap, t_end)) AS hi FROM lim),
    made AS (SELECT rec_id AS qid, lo + {start} % (hi - lo + 1) AS q_start, elem_id, count(*) OVER (PARTITION BY rec_id) AS n FROM win)
    SELECT qid, q_start, q_start + {extent} AS q_end, elem_id, n FROM made"""


@add("gen_from_objects", base("basket") + _from_objects((0.0, 1.0), "true", 3, 20, 10))
@on("basket")
def gen_from_objects(p: DataFrame, q: DataFrame) -> DataFrame:
    return generate.queries_from_objects(p, ASK["basket"][0], 10)


@add("gen_from_buckets", base("session") + _from_objects((0.0, 1.0), "share > 1 AND share <= 100", 2, 7, 500))
@on("session")
def gen_from_buckets(p: DataFrame, q: DataFrame) -> DataFrame:
    """Elements of given frequency buckets only."""
    return generate.queries_from_objects(p, ASK["session"][0], 500, 2, [(1, 10), (10, 100)])


@add("gen_skewed", base("basket") + _from_objects((0.4, 0.7), "true", 2, 20, 25))
@on("basket")
def gen_skewed(p: DataFrame, q: DataFrame) -> DataFrame:
    """Queries inside a window of the domain."""
    return generate.queries_from_objects(p, ASK["basket"][0], 25, 2, None, (0.4, 0.7))


def _drawn(names: list[str], every: int) -> str:
    """SQL of named workloads whose elements may have any frequency."""
    parts = []
    for i, name in enumerate(names):
        w, salt = generate.WORKLOADS[name], 20 * i
        at = lambda k: generate.draw_sql("rec_id", k + salt)  # noqa: B023, E731
        lo, hi = ([x[j] / 100 for x in w["ext"]] for j in (0, 1))
        parts.append(f"""SELECT '{name}' AS workload, rec_id, elem_id, t_start, t_end, g0, g1, {w['cnt']}[1 + {at(1)} % {len(w['cnt'])}] AS k,
          floor({lo}[1 + {at(2)} % {len(lo)}]::DOUBLE * (g1 - g0))::BIGINT AS xlo, floor({hi}[1 + {at(2)} % {len(hi)}]::DOUBLE * (g1 - g0))::BIGINT AS xhi, {at(3)} AS d3, {at(4)} AS d4,
          g0 + floor((g1 - g0) * {w['skew'][0] / 100}::DOUBLE)::BIGINT AS w0, g0 + floor((g1 - g0) * {w['skew'][1] / 100}::DOUBLE)::BIGINT AS w1,
          row_number() OVER (PARTITION BY rec_id ORDER BY {generate.draw_sql('rec_id * 31 + elem_id', salt)}, elem_id) AS i, count(*) OVER (PARTITION BY rec_id) AS size
          FROM p, dom WHERE rec_id % {every} = 0 AND (rec_id // {every}) % {len(names)} = {i}""")
    return f""", dr AS ({' UNION ALL '.join(parts)}),
    ex AS (SELECT *, greatest(1, xlo + d3 % (xhi - xlo + 1)) AS ext FROM dr WHERE k <= size AND i <= k),
    se AS (SELECT *, greatest(g0, t_start - ext, w0 - ext) AS s0, least(g1 - ext, t_end, w1) AS s1 FROM ex WHERE t_end >= w0 AND t_start <= w1)
    SELECT workload, rec_id AS qid, s0 + d4 % (s1 - s0 + 1) AS q_start, s0 + d4 % (s1 - s0 + 1) + ext AS q_end, elem_id, k::BIGINT AS n FROM se WHERE s0 <= s1"""


_NAMED = ["BASE", "LONG", "SHORT", "FEW", "MANY", "BROAD", "RND2", "H3"]


@add("gen_workloads_any_frequency", base("basket") + _drawn(_NAMED, 5))
@on("basket")
def gen_workloads_any_frequency(p: DataFrame, q: DataFrame) -> DataFrame:
    """Named workloads, as one compound, query by query."""
    return generate.named_workload(p, "+".join(_NAMED), 5).select("workload", "qid", "q_start", "q_end", "elem_id", "n")


def _feature_sql() -> str:
    own = lambda name, fixture: ORACLES[name].replace(base(fixture), base("basket"))
    extents = own("extent_bins", "session").replace("round(avg(n_elems), 6)", "avg(n_elems)").replace("round(greatest(0.1, avg", "greatest(0.1, avg").replace("- 1)), 5)", "- 1))")
    whole = re.sub(r"round\((.*?), 9\) AS", r"\1 AS", ORACLES["qstats"])  # rounded once, at the end
    log = lambda x: f"CASE WHEN {x} > 0 THEN log10({x}) ELSE 0 END"
    space = schema.design_space(["pure", "dict2"])
    codes = ", ".join(f"('{n}', {lo})" for _, n, lo, _ in space)
    ranks = ", ".join(f"rank_{i}" for i in range(9))
    return f"""WITH su AS ({ORACLES['ostats_summary']}), xb AS ({extents}), eb AS ({own('elem_bins', 'archive')}), qs AS ({whole}), enc(config, code) AS (VALUES {codes}),
    fixed AS (SELECT 0 AS place, card_log AS v FROM su UNION ALL SELECT 1, domain_log FROM su
      UNION ALL SELECT 2 + 3 * bin, {log('max_len')} FROM xb UNION ALL SELECT 3 + 3 * bin, {log('avg_elems')} FROM xb UNION ALL SELECT 4 + 3 * bin, {log('dev_elems')} FROM xb
      UNION ALL SELECT 26 + i, coalesce(v, 0) FROM range(12) t(i) LEFT JOIN (SELECT row_number() OVER (ORDER BY bin) - 1 AS i, {log('post_ratio * 100')} AS v FROM eb) USING (i)),
    asked AS (SELECT qid, unnest([start_rel, coalesce(extent_log, -9), {ranks}]) AS v, unnest(range(38, 49)) AS place FROM qs),
    codes AS (SELECT config, unnest(code) AS v, unnest(range(49, 57)) AS place FROM enc)
    SELECT qid, config, place::BIGINT AS place, round(v, 6) + 0.0 AS value FROM (
      SELECT qid, config, place, v::DOUBLE AS v FROM asked, enc UNION ALL SELECT qid, config, place, v::DOUBLE FROM qs, codes UNION ALL SELECT qid, config, place, v::DOUBLE FROM qs, enc, fixed)"""


@add("lcm_feature_values", _feature_sql())
@on("basket")
def lcm_feature_values(p: DataFrame, q: DataFrame) -> DataFrame:
    """All places of the features of all queries and configurations."""
    rows = _features(p.sparkSession, p, q)
    return rows.select("qid", "config", F.posexplode("features").alias("place", "v")).select("qid", "config", F.col("place").cast("long").alias("place"), (F.round("v", 6) + 0.0).alias("value"))


@add("gen_shuffled", base("session") + f", h AS (SELECT qid, row_number() OVER (ORDER BY {generate.draw_sql('qid', 42)}, qid) - 1 AS fresh FROM (SELECT DISTINCT qid FROM q)) SELECT fresh AS qid, q_start, q_end, elem_id, n FROM q JOIN h USING (qid)")
@on("session")
def gen_shuffled(p: DataFrame, q: DataFrame) -> DataFrame:
    return generate.shuffled(q).select("qid", "q_start", "q_end", "elem_id", "n")


@add(
    "gen_compound_counts",
    "WITH n AS (SELECT count(*) % 97 + 10 AS total FROM orders), w AS (SELECT o_orderkey % 4 AS part, count(*)::DOUBLE AS weight FROM orders GROUP BY 1), "
    "e AS (SELECT part, total, total * weight / sum(weight) OVER () AS x FROM w, n), f AS (SELECT *, floor(x)::BIGINT AS low, row_number() OVER (ORDER BY floor(x) - x, part) AS i, sum(floor(x)) OVER () AS given FROM e) "
    "SELECT part, low + (i <= total - given)::INT AS n FROM f",
)
def gen_compound_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole parts of a compound workload, in proportion to what tables hold."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    weights = [r[1] for r in orders.groupBy(F.col("o_orderkey") % 4).count().orderBy("(o_orderkey % 4)").collect()]
    total = orders.count() % 97 + 10
    return spark.createDataFrame(list(enumerate(generate.allocate(total, weights))), "part long, n long")


# ---- configurations that come from tables

_ORDER_CONFIGS = "SELECT DISTINCT o_orderkey % 4 AS kind, 1.0 + (o_orderkey % 8) / 8.0::DOUBLE AS alpha, (o_custkey % 4 + 1) / 8.0::DOUBLE AS beta, 3 + o_custkey % 9 AS levels FROM orders"


def _configs(spark: SparkSession, sf_dir: str) -> list[tuple[int, float, float, int, str]]:
    """Distinct configurations, a few hundred at most."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select((k % 4).alias("kind"), (1.0 + k % 8 / 8.0).alias("alpha"), ((c % 4 + 1) / 8.0).alias("beta"), (3 + c % 9).alias("levels")).distinct().collect()
    out = []
    for kind, alpha, beta, levels in rows:
        element_first = {"range": "0.75-1", "method": f"tif;slicing;a;dyn;{alpha:g};{beta:g}"}
        spec = [
            {"method": f"tif;hint;mrg;dyn;{alpha:g};{beta:g}"}, {"method": f"irhint;perf;{levels}"}, {"method": element_first["method"]},
            {"refine": "elemfreq", "fanout": [element_first, {"range": "0-0.75", "method": f"irhint;perf;{levels}"}]},
        ][kind]
        out.append((kind, alpha, beta, levels, json.dumps(spec)))
    return out


_ENCODED = """SELECT kind, alpha, beta, levels, (kind IN (2, 3))::INT::DOUBLE AS slicing, (kind = 0)::INT::DOUBLE AS hint, CASE WHEN kind = 1 THEN -1 ELSE alpha END AS e_alpha,
  CASE WHEN kind = 1 THEN -1 ELSE beta END AS e_beta, [0.0, 1.0, 0.0, 0.75][kind + 1]::DOUBLE AS e_boundary, CASE WHEN kind IN (0, 2) THEN -1 ELSE levels END::DOUBLE AS e_levels"""


@add("config_encoded", f"WITH c AS ({_ORDER_CONFIGS}) {_ENCODED} FROM c")
def config_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for kind, alpha, beta, levels, text in _configs(spark, sf_dir):
        code = schema.encode(schema.parse(text)[0])
        rows.append((kind, alpha, beta, levels, code[1], code[3], code[4], code[5], code[6], code[7]))
    return spark.createDataFrame(rows, "kind long, alpha double, beta double, levels long, slicing double, hint double, e_alpha double, e_beta double, e_boundary double, e_levels double")


_TEXT = """CASE kind WHEN 0 THEN '{"method":"tif;hint;mrg;dyn;' || a || ';' || b || '"}' WHEN 1 THEN '{"method":"irhint;perf;' || levels || '"}' WHEN 2 THEN '{"method":"tif;slicing;a;dyn;' || a || ';' || b || '"}'
  ELSE '{"refine":"elemfreq","fanout":[{"range":"0.75-1","method":"tif;slicing;a;dyn;' || a || ';' || b || '"},{"range":"0-0.75","method":"irhint;perf;' || levels || '"}]}' END"""
_PLAIN = "SELECT *, regexp_replace(alpha::VARCHAR, '\\.0$', '') AS a, regexp_replace(beta::VARCHAR, '\\.0$', '') AS b FROM c"


@add("config_decoded", f"WITH c AS ({_ORDER_CONFIGS}), d AS ({_PLAIN}) SELECT kind, alpha, beta, levels, {_TEXT} AS config FROM d")
def config_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, decoded and written on one line: the configuration again."""
    rows = [(kind, a, b, m, schema.serialize(schema.decode(schema.encode(schema.parse(text)[0])))) for kind, a, b, m, text in _configs(spark, sf_dir)]
    return spark.createDataFrame(rows, "kind long, alpha double, beta double, levels long, config string")


@add("config_serialized", f"WITH c AS ({_ORDER_CONFIGS}), d AS ({_PLAIN}), t AS (SELECT kind, {_TEXT} AS one FROM d) SELECT one AS config, '[' || one || ',' || one || ']' AS banded FROM t GROUP BY ALL")
def config_serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pretty text with comments and trailing commas to one line, alone and as a list of bands."""
    rows = set()
    for *_, text in _configs(spark, sf_dir):
        pretty = "# a comment\n" + json.dumps(json.loads(text), indent=2).replace("\n}", ",\n}")
        one = schema.parse(pretty)
        again = schema.parse(schema.serialize(one[0], pretty=True))
        rows.add((schema.serialize(one), schema.serialize([again[0], one[0]])))
    return spark.createDataFrame(sorted(rows), "config string, banded string")


@add("config_closure", "SELECT seg, kind, 'tif;' || kind || ';dyn;' || lo || ';0.5' AS method FROM (SELECT DISTINCT c_mktsegment AS seg, 1 + c_nationkey % 3 AS lo FROM customer), (VALUES ('slicing;a'), ('hint;mrg')) k(kind)")
def config_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each of a template's choices."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", (1 + F.col("c_nationkey") % 3).alias("lo")).distinct().collect()
    out = []
    for seg, lo in rows:
        for spec in schema.closure({"method": f"tif;[slicing;a,hint;mrg];dyn;{lo};0.5"}):
            out.append((seg, ";".join(spec["method"].split(";")[1:3]), spec["method"]))
    return spark.createDataFrame(out, "seg string, kind string, method string")


@add("config_sanity", "WITH r AS (SELECT DISTINCT (l_quantity % 5) / 4 AS a, (l_linenumber % 5) / 4.0::DOUBLE AS b FROM lineitem) SELECT a::DOUBLE AS a, b, a = b AND a > 0 AND a < 1 AS sane FROM r")
def config_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges of elements are sound where the upper starts where the lower ends, inside 0 and 1."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") % 5 / 4).cast("double"), (F.col("l_linenumber") % 5 / 4.0).cast("double")).distinct().collect()
    out = []
    for a, b in rows:
        spec = {"refine": "elemfreq", "fanout": [{"range": f"{a:g}-1", "method": "tif;basic"}, {"range": f"0-{b:g}", "method": "irhint;perf;4"}]}
        out.append((a, b, schema.sane(schema.Schema.of(spec))))
    return spark.createDataFrame(out, "a double, b double, sane boolean")


@add(
    "config_instances",
    "SELECT DISTINCT n_nationkey AS seed, true AS inside, true AS joined FROM nation",
)
def config_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random configurations of a template, a seed for each nation: their numbers lie in the
    template's ranges, and ``p`` is the bound of the range before."""
    template = schema.TEMPLATES["dict2"]["refine-elemfreq_tif+slicing_irhint"]
    out = []
    for (seed,) in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect():
        made = schema.instantiate(template, seed)
        lo, hi = schema.corners(template)
        code, low, high = schema.encode(made), schema.encode(lo), schema.encode(hi)
        out.append((seed, all(a - 1e-6 <= x <= z + 1e-6 for a, x, z in zip(low, code, high, strict=True)), made.fanout[0].range.split("-")[0] == made.fanout[1].range.split("-")[1]))
    return spark.createDataFrame(out, "seed long, inside boolean, joined boolean")


_CHILD = """'{"range":"0.7-1","method":"tif;slicing;a;dyn;' || qps || ';-0.5"},{"range":"0-0.7","method":"irhint;perf;' || xor_result || '"}'"""
_JSON = f"""CASE xor_result % 5 WHEN 0 THEN '{{"method":"tif;basic"}}' WHEN 1 THEN '{{"method":"tif;hint;mrg;dyn;' || size_mb || ';2.5"}}'
  ELSE '{{' || (['"refine":"elemfreq"', '"split":"temporal"', '"slice":"temporal"'])[xor_result % 5 - 1] || ',"fanout":[' || {_CHILD} || ']}}' END"""
_NAME = """CASE xor_result % 5 WHEN 0 THEN 'pure-unp: tif;basic' WHEN 1 THEN 'pure-unp: tif;hint;mrg;dyn' WHEN 2 THEN 'dref-p-2: { tif;slicing;a;dyn | irhint;perf }'
  WHEN 3 THEN 'tspl-p-2: { tif;slicing;a;dyn | irhint;perf }' ELSE 'tsli-p-2: { tif;slicing;a;dyn | irhint;perf }' END"""


@add("score_template_names", SCORES + f"SELECT {_NAME} AS template, count(*) AS n, max(qps) AS qps FROM s GROUP BY 1")
def score_template_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumn("config", F.expr(_JSON.replace("[xor_result % 5 - 1]", "[xor_result % 5 - 2]").replace("(['", "array('").replace("'])[", "')[")))
    return rows.groupBy(skyline.template_name(F.col("config")).alias("template")).agg(F.count("*").alias("n"), F.max("qps").alias("qps"))


_BANDS = [(0, 400), (401, 1200), (1201, 5000)]


def _cut(table: str, start: str, end: str, rest: str) -> str:
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS band, {rest}, greatest({start}, {lo}) - {lo} AS {start}, least({end}, {hi}) - {lo} AS {end} FROM {table} WHERE {start} <= {hi} AND {end} >= {lo}" for i, (lo, hi) in enumerate(_BANDS))


@add("band_objects", base("basket") + _cut("obj", "t_start", "t_end", "rec_id, n_elems"))
@on("basket")
def band_objects(p: DataFrame, q: DataFrame) -> DataFrame:
    """Objects cut to bands, in each band's own time."""
    return slices.in_bands(stats.object_sizes(p).select("rec_id", "n_elems", "t_start", "t_end"), _BANDS, "t_start", "t_end")


@add("band_queries", base("basket") + _cut("q", "q_start", "q_end", "qid, elem_id, n"))
@on("basket")
def band_queries(p: DataFrame, q: DataFrame) -> DataFrame:
    return slices.in_bands(q.select("qid", "elem_id", "n", "q_start", "q_end"), _BANDS, "q_start", "q_end")


# ---- search and presentation

_BY_COST = SCORES + ", g AS (SELECT schema, log10(avg(power(10.0::DOUBLE, log10(1 / qps)))) AS cost, log10(avg(power(10.0::DOUBLE, log10(size_mb)))) AS size FROM s GROUP BY schema)"


@add("search_objective", _BY_COST + " SELECT schema, round(cost, 9) AS cost, round(size, 9) AS size FROM g")
def search_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).select("schema", F.log10(1 / F.col("qps")).alias("throughput_log"), F.log10("size_mb").alias("size_log"))
    return search.objective(rows, "schema").select("schema", F.round("cost", 9).alias("cost"), F.round("size", 9).alias("size"))


@add(
    "search_presented",
    SCORES + ", c AS (SELECT DISTINCT schema, max(qps) OVER (PARTITION BY schema) AS qps FROM s), l AS (SELECT schema, 1e6 / qps AS cost, lag(1e6 / qps) OVER (ORDER BY 1e6 / qps) AS before FROM c)"
    " SELECT schema, cost FROM l WHERE before IS NULL OR cost > before * (1 + 0.0001::DOUBLE) ORDER BY cost LIMIT 5",
)
def search_presented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few cheapest that are not next to the one before."""
    c = scores(spark, sf_dir).groupBy("schema").agg((1e6 / F.max("qps")).alias("cost"))
    return skyline.presented(c, "cost", 5, 0.0001)


@add("throughput", SCORES + ", m AS (SELECT xor_result, median(1 / qps) AS s FROM s GROUP BY 1) SELECT round(count(*) / sum(s), 6) AS qps, round(sum(s) / count(*), 12) AS sec_per_query FROM m")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.throughput(scores(spark, sf_dir).select(F.col("xor_result").alias("qid"), (1 / F.col("qps")).alias("seconds")))
    return t.select(F.round("qps", 6).alias("qps"), F.round("sec_per_query", 12).alias("sec_per_query"))


add("ttir_rarest_session", base("session") + CORE)(on("session")(query.rarest_first))
