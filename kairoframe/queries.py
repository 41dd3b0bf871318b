"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import costmodel, ensembles, generate, layouts, mutations, query, search, skyline, slices, stats
from .operators.postings import collect_objects, dictionary, domain, explode_objects, postings, subset
from .plans import engine, schema
from .plans.layout import StoredLayout
from .sources.fixtures import FIXTURES, SQL
from .sources.stored import once, place

Query = Callable[[SparkSession, str], DataFrame]
#: Of each fixture every how many objects ask, and how far around their start.
ASK = {"archive": (20, 500), "basket": (20, 5), "session": (7, 2000)}
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def base(fixture: str, more: str = "") -> str:
    """SQL: postings p, query elements q and results res of a fixture."""
    every, width = ASK[fixture]
    return f"""WITH {SQL[fixture]},
dict AS (SELECT elem, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, elem) - 1 AS elem_id FROM tok GROUP BY elem),
p AS (SELECT rec_id, elem_id, t_start, t_end FROM tok JOIN dict USING (elem)),
mine AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY elem_id) AS i, count(*) OVER (PARTITION BY rec_id) AS size FROM p WHERE rec_id % {every} = 0),
q AS (SELECT rec_id AS qid, t_start - {width} AS q_start, t_start + {width} AS q_end, elem_id, count(*) OVER (PARTITION BY rec_id) AS n FROM mine
      WHERE i = 1 + (rec_id * 7) % size OR i = 1 + (rec_id * 7 + 13) % size OR i = 1 + (rec_id * 7 + 26) % size),
res AS (SELECT q.qid, p.rec_id FROM q JOIN p ON p.elem_id = q.elem_id AND p.t_start <= q.q_end AND q.q_start <= p.t_end GROUP BY q.qid, p.rec_id, q.n HAVING count(*) = q.n),
dom AS (SELECT min(t_start) AS g0, max(t_end) AS g1 FROM p),
obj AS (SELECT rec_id, t_start, t_end, count(*) AS n_elems, t_end - t_start AS length FROM p GROUP BY ALL){more}
"""


CORE = "SELECT qid, rec_id FROM res"


def add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def words_of(fixture: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's dictionary, written once."""
    return once(spark, sf_dir, f"{fixture} dictionary", lambda: dictionary(FIXTURES[fixture](spark, sf_dir)), sort=["elem"])


def rows_of(fixture: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's postings, written once, in order of elements; a frequent one may span files."""

    def make() -> DataFrame:
        return postings(FIXTURES[fixture](spark, sf_dir), words_of(fixture, spark, sf_dir)).repartitionByRange("elem_id", "rec_id")

    return once(spark, sf_dir, f"{fixture} postings", make, sort=["elem_id", "t_start"])


def asked(fixture: str, p: DataFrame) -> DataFrame:
    return query.workload(p, *ASK[fixture])


def asked_of(fixture: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's workload, written once."""
    return once(spark, sf_dir, f"{fixture} workload {ASK[fixture]}", lambda: asked(fixture, rows_of(fixture, spark, sf_dir)), sort=["elem_id"])


def laid(fixture: str, method: str) -> Query:
    """The workload over a layout of the method, written once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        layout = StoredLayout(spark, place(spark, sf_dir, f"{fixture} {method}"), method)
        if not layout.data.exists():
            layout.create(rows_of(fixture, spark, sf_dir))
        return layout.query(asked_of(fixture, spark, sf_dir))

    return run


def on(fixture: str):
    """Queries of (postings, elems)."""

    def wrap(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(rows_of(fixture, spark, sf_dir), asked_of(fixture, spark, sf_dir))

        return run

    return wrap


# ---- the core query, its parts and its paths

for _name in FIXTURES:
    add(f"ttir_core_{_name}", base(_name) + CORE)(on(_name)(query.core))


def naive(p: DataFrame, q: DataFrame) -> DataFrame:
    """Whole objects and whole queries by the predicate: a check of the others, and not a way to answer."""
    return query.naive_in_windows(p, collect_objects(p), query.as_queries(q))


for _name in ("session", "archive"):
    add(f"ttir_naive_{_name}", base(_name) + CORE)(on(_name)(naive))


@add("ttir_checksum", base("basket") + "SELECT qid, count(*) AS results, bit_xor(rec_id) AS xor_ids FROM res GROUP BY qid")
@on("basket")
def checksum(p: DataFrame, q: DataFrame) -> DataFrame:
    return query.checksum(query.core(p, q))


@add("interval_only", base("session") + "SELECT h.qid, obj.rec_id FROM (SELECT DISTINCT qid, q_start, q_end FROM q) h JOIN obj ON t_start <= q_end AND q_start <= t_end")
@on("session")
def interval_only(p: DataFrame, q: DataFrame) -> DataFrame:
    return query.interval_only(p.select("rec_id", "t_start", "t_end").distinct(), q.select("qid", "q_start", "q_end").distinct())


@add("containment_only", base("basket") + "SELECT q.qid, p.rec_id FROM q JOIN p USING (elem_id) GROUP BY q.qid, p.rec_id, q.n HAVING count(*) = q.n")
@on("basket")
def containment_only(p: DataFrame, q: DataFrame) -> DataFrame:
    return query.containment_only(p, q)


add(
    "overlap_checks",
    base("basket") + """SELECT qid, sum((t_start <= q_end AND q_start <= t_end)::INT)::BIGINT AS both, sum((t_start <= q_end)::INT)::BIGINT AS start_only,
        sum((q_start <= t_end)::INT)::BIGINT AS end_only, count(*) AS no_check FROM q JOIN p USING (elem_id) GROUP BY qid""",
)(on("basket")(query.overlap_checks))
add("rarest_first", base("archive") + CORE)(on("archive")(query.rarest_first))


@add("subset_elements", base("basket") + "SELECT rec_id, count(*) AS n_elems, sum(elem_id)::BIGINT AS sum_ids FROM p WHERE elem_id BETWEEN 10 AND 500 GROUP BY rec_id")
@on("basket")
def subset_elements(p: DataFrame, q: DataFrame) -> DataFrame:
    kept = subset(collect_objects(p), 10, 500)
    return kept.select("rec_id", F.size("elements").cast("long").alias("n_elems"), F.aggregate("elements", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


@add("domain_stats", base("basket") + "SELECT g0, g1 FROM dom")
@on("basket")
def domain_stats(p: DataFrame, q: DataFrame) -> DataFrame:
    return domain(p)


@add("dictionary_ranks", base("archive") + "SELECT elem, elem_id, freq FROM dict")
def dictionary_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of("archive", spark, sf_dir).select("elem", "elem_id", "freq")


# ---- layouts

GRID = """, g AS (SELECT p.*, g0, greatest(1, ceil((g1 - g0) / 16.0))::BIGINT AS ext FROM p, dom),
gr AS (SELECT rec_id, elem_id, t_start, t_end, greatest(0, least(15, (t_start - g0) // ext)) AS s0, greatest(0, least(15, (t_end - g0) // ext)) AS s1 FROM g),
lay AS (SELECT rec_id, elem_id, t_start, t_end, s0, unnest(range(s0, s1 + 1)) AS pid FROM gr)"""


@add("layout_grid_rows", base("basket", GRID) + "SELECT pid, count(*) AS entries, sum((pid = s0)::INT)::BIGINT AS originals, bit_xor(rec_id) AS xor_ids FROM lay GROUP BY pid")
@on("basket")
def layout_grid_rows(p: DataFrame, q: DataFrame) -> DataFrame:
    lay = layouts.grid(p, layouts.grid_bounds(p, 16))
    return lay.groupBy("pid").agg(F.count("*").alias("entries"), F.sum((F.col("pid") == F.col("s0")).cast("long")).alias("originals"), F.bit_xor("rec_id").alias("xor_ids"))


def _grid(p: DataFrame, q: DataFrame) -> DataFrame:
    bounds = layouts.grid_bounds(p, 16)
    return layouts.grid_query(layouts.grid(p, bounds), q, bounds)


def _hint(p: DataFrame, q: DataFrame) -> DataFrame:
    bounds = layouts.hint_bounds(p, 8)
    return layouts.hint_query(layouts.hint(p, bounds), q, bounds)


def _sharding(p: DataFrame, q: DataFrame) -> DataFrame:
    rows = layouts.shards(p)
    return layouts.shard_query(rows, q, layouts.shard_zones(rows))


for _name in FIXTURES:
    add(f"ttir_grid_{_name}", base(_name) + CORE)(laid(_name, "tif;slicing;a;static;16"))
    add(f"ttir_hint_{_name}", base(_name) + CORE)(laid(_name, "tif;hint;mrg;static;8"))
add("ttir_irhint", base("basket") + CORE)(laid("basket", "irhint;perf;8"))
add("ttir_sharding", base("basket") + CORE)(laid("basket", "tif;sharding;static;2"))
add("ttir_sharding_dynamic", base("session") + CORE)(laid("session", "tif;sharding;dyn;1.0;0.7"))
add("ttir_sharding_by_length", base("basket") + CORE)(on("basket")(_sharding))

DYNAMIC = """, own AS (SELECT elem_id, count(*) AS freq, min(t_start) AS g0, max(t_end) AS g1,
  greatest(1, round(power(10.0::DOUBLE, log10(count(*) / power(10.0::DOUBLE, 1.2)) * 0.6)))::BIGINT AS slices FROM p GROUP BY elem_id),
ow AS (SELECT *, greatest(1, ceil((g1 - g0)::DOUBLE / slices))::BIGINT AS ext FROM own)"""


@add("layout_grid_dynamic", base("basket", DYNAMIC) + "SELECT elem_id, freq, slices, ext FROM ow")
@on("basket")
def layout_grid_dynamic(p: DataFrame, q: DataFrame) -> DataFrame:
    _, own = layouts.grid_dynamic(p, 1.2, 0.6)
    return own.join(p.groupBy("elem_id").agg(F.count("*").alias("freq")), "elem_id").select("elem_id", "freq", "slices", "ext")


add("ttir_grid_dynamic", base("basket") + CORE)(laid("basket", "tif;slicing;a;dyn;1.2;0.6"))

HINT = """, sh AS (SELECT g0, g1, greatest(0, length(bin(g1 - g0)) - 8) AS shift FROM dom),
ab AS (SELECT rec_id, (t_start - g0) >> shift AS a, (t_end - g0) >> shift AS b FROM p, sh),
lv AS (SELECT *, unnest(range(0, 9)) AS lvl FROM ab),
lh AS (SELECT *, (a + (1 << lvl) - 1) // (1 << lvl) AS lo, (b + 1) // (1 << lvl) - 1 AS hi FROM lv),
hr AS (SELECT rec_id, lvl, a, b, lo AS part FROM lh WHERE lo <= hi AND lo % 2 = 1 UNION ALL SELECT rec_id, lvl, a, b, hi FROM lh WHERE lo <= hi AND hi % 2 = 0)"""


def _hint_rows(p: DataFrame, q: DataFrame) -> DataFrame:
    lay = layouts.hint(p, layouts.hint_bounds(p, 8))
    count = lambda c: F.sum(F.col(c).cast("long"))
    return lay.groupBy(F.col("lvl").cast("long").alias("lvl"), "part").agg(F.count("*").alias("entries"), count("org").alias("originals"), count("inside").alias("inside"))


add(
    "layout_hint_rows",
    base("basket", HINT) + """SELECT lvl::BIGINT AS lvl, part::BIGINT AS part, count(*) AS entries, sum((part = a >> lvl)::INT)::BIGINT AS originals, sum((part = b >> lvl)::INT)::BIGINT AS inside
    FROM hr GROUP BY lvl, part""",
)(on("basket")(_hint_rows))


@add("layout_irhint_rows", base("session", HINT) + "SELECT lvl::BIGINT AS lvl, count(*) AS entries, count(DISTINCT part) AS parts FROM hr GROUP BY lvl")
@on("session")
def layout_irhint_rows(p: DataFrame, q: DataFrame) -> DataFrame:
    lay = layouts.irhint(p, layouts.hint_bounds(p, 8))
    return lay.groupBy(F.col("lvl").cast("long").alias("lvl")).agg(F.count("*").alias("entries"), F.countDistinct("part").alias("parts"))


@add("layout_dynamic_levels", base("basket") + "SELECT elem_id, greatest(1, round(log10(count(*) / power(10.0::DOUBLE, 1.3)) * 2.0))::INT AS levels FROM p GROUP BY elem_id")
@on("basket")
def layout_dynamic_levels(p: DataFrame, q: DataFrame) -> DataFrame:
    return p.groupBy("elem_id").agg(F.count("*").alias("freq")).select("elem_id", layouts.dynamic_levels(F.col("freq"), 1.3, 2.0).alias("levels"))


add(
    "layout_shard_zones",
    base("basket") + """SELECT elem_id, length(bin(t_end - t_start))::BIGINT AS shard, min(t_start) AS zone_start, max(t_end) AS zone_end, max(t_end - t_start) AS longest, count(*) AS entries
    FROM p GROUP BY elem_id, length(bin(t_end - t_start))""",
)(on("basket")(lambda p, q: layouts.shard_zones(layouts.shards(p))))


@add("shard_relaxation", base("basket") + "SELECT elem_id, least(100.0::DOUBLE, 100 * exp(-0.7 * greatest(0.0, log10(count(*)) - 1.0))) AS percent FROM p GROUP BY elem_id")
@on("basket")
def shard_relaxation(p: DataFrame, q: DataFrame) -> DataFrame:
    return p.groupBy("elem_id").agg(F.count("*").alias("freq")).select("elem_id", layouts.relaxation(F.col("freq"), 1.0, 0.7).alias("percent"))


GREEDY = """, own AS (SELECT elem_id, least(100.0::DOUBLE, 100 * exp(-0.7 * greatest(0.0, log10(count(*)) - 1.0))) AS percent, max(t_end) - min(t_start) AS domain FROM p GROUP BY elem_id),
sl AS (SELECT elem_id, floor(percent / 100 * domain)::BIGINT AS slack FROM own),
nth AS (SELECT elem_id, rec_id, t_end, row_number() OVER (PARTITION BY elem_id ORDER BY t_start, t_end, rec_id) AS i FROM p),
fold AS (SELECT elem_id, rec_id, i, slack, [t_end] AS ends, 1::BIGINT AS spot FROM nth JOIN sl USING (elem_id) WHERE i = 1
  UNION ALL SELECT elem_id, rec_id, i, slack, CASE WHEN spot > len(ends) THEN list_append(ends, t_end) ELSE list_concat(list_append(ends[:spot - 1], greatest(ends[spot], t_end)), ends[spot + 1:]) END, spot
  FROM (SELECT n.elem_id, n.rec_id, n.i, f.slack, f.ends, n.t_end, coalesce(nullif(list_position(list_transform(f.ends, lambda x: n.t_end >= x - f.slack), true), 0), len(f.ends) + 1) AS spot
        FROM fold f JOIN nth n ON n.elem_id = f.elem_id AND n.i = f.i + 1))"""


@add("greedy_shards", base("basket", GREEDY).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT elem_id, rec_id, (spot - 1)::BIGINT AS shard FROM fold")
@on("basket")
def greedy_shards(p: DataFrame, q: DataFrame) -> DataFrame:
    return layouts.shard_rows(p, layouts.shard_slack("dyn", "1.0", "0.7")(p)).select("elem_id", "rec_id", "shard")


@add(
    "layout_sizes",
    base("basket", GRID + HINT)
    + """SELECT 'postings' AS layout, count(*) AS entries, count(*) * 12 AS bytes FROM p UNION ALL SELECT 'grid', count(*), count(*) * 12 FROM lay
    UNION ALL SELECT 'hint', count(*), count(*) * 12 FROM hr UNION ALL SELECT 'containment', count(*), count(*) * 4 FROM p""",
)
@on("basket")
def layout_sizes(p: DataFrame, q: DataFrame) -> DataFrame:
    grid, hint = layouts.grid(p, layouts.grid_bounds(p, 16)), layouts.hint(p, layouts.hint_bounds(p, 8))
    return layouts.sizes({"postings": (p, 12), "grid": (grid, 12), "hint": (hint, 12), "containment": (p, 4)})


# ---- ensembles

CONFIGS = {
    "ensemble_elemfreq": ("basket", '{"refine":"elemfreq","fanout":[{"range":"0.8-1","method":"tif;basic"},{"range":"0.5-0.8","method":"tif;basic"},{"range":"0-0.5","method":"irhint;perf;8"}]}'),
    "ensemble_split": ("session", '{"split":"temporal","fanout":[{"range":"0-0.3","method":"tif;basic"},{"range":"0.3-0.6","method":"tif;basic"},{"range":"0.6-1","method":"tif;basic"}]}'),
    "ensemble_slice": ("basket", '{"slice":"temporal","fanout":[{"range":"0-0.25","method":"tif;basic"},{"range":"0.25-0.5","method":"tif;basic"},{"range":"0.5-1","method":"tif;basic"}]}'),
    "ensemble_hybrid": ("basket", '{"hybrid":"moveout-refine","fanout":[{"method":"tif;hint;mrg;static;6"},{"method":"tif;basic"}]}'),
    "ensemble_banded": ("session", '[{"band_range":"0-0.3","method":"tif;slicing;a;static;8"},{"band_range":"0.3-0.7","method":"tif;basic"},{"band_range":"0.7-1","method":"irhint;perf;5"}]'),
    "ensemble_split_paths": ("session", '{"split":"temporal","fanout":[{"range":"0-0.3","method":"irhint;perf;6"},{"range":"0.3-0.6","method":"tif;slicing;a;static;8"},{"range":"0.6-1","method":"tif;hint;mrg;static;5"}]}'),
    "ensemble_slice_paths": ("basket", '{"slice":"temporal","fanout":[{"range":"0.1-0.4","method":"irhint;perf;5"},{"range":"0.5-0.9","method":"tif;sharding;static;2"}]}'),
    "ensemble_nested": ("basket", '{"slice":"temporal","fanout":[{"range":"0-0.5","refine":"elemfreq","fanout":[{"range":"0.7-1","method":"tif;slicing;a;dyn;1.2;0.6"},{"range":"0-0.7","method":"irhint;perf;6"}]},{"range":"0.5-1","hybrid":"moveout-refine","fanout":[{"method":"tif;hint;mrg;static;6"},{"method":"tif;sharding;dyn;1.0;0.7"}]}]}'),
    "ensemble_sharding": ("session", '{"method":"tif;sharding;static;2"}'),
    "ensemble_hint_dyn": ("basket", '{"method":"tif;hint;mrg;dyn;0.5;2.5"}'),
    "ensemble_slicing_dyn": ("session", '{"method":"tif;slicing;a;dyn;1.2;0.6"}'),
}


def _configured(name: str) -> None:
    fixture, config = CONFIGS[name]
    add(name, base(fixture) + CORE)(on(fixture)(lambda p, q: engine.answer(p, q, config)))


for _name in CONFIGS:
    _configured(_name)


@add("consistency", base("session") + "SELECT count(*) AS results, bit_xor(rec_id) AS xor_ids, 1::BIGINT AS answers FROM res")
@on("session")
def consistency(p: DataFrame, q: DataFrame) -> DataFrame:
    """Of all paths the number of results and the XOR of their ids. Each path answers a few windows
    of time at once, so that the pairs that it groups by are bounded on disk."""
    paths = {"core": query.core, "grid": _grid, "hint": _hint, "sharding": _sharding}
    answers = query.told_in_windows(p, q, paths)
    results, xor_ids = zip(*answers.values(), strict=True)
    xor = max((x for x in xor_ids if x is not None), default=None)
    return p.sparkSession.createDataFrame([(max(results), xor, len(set(answers.values())))], "results long, xor_ids long, answers long")


# ---- mutations, then the query


def _core_sql(p: str) -> str:
    return f"SELECT q.qid, x.rec_id FROM q JOIN ({p}) x ON x.elem_id = q.elem_id AND x.t_start <= q.q_end AND q.q_start <= x.t_end GROUP BY q.qid, x.rec_id, q.n HAVING count(*) = q.n"


_FEWER = _core_sql("SELECT * FROM p WHERE rec_id % 10 <> 3")


@add("mut_update", base("basket") + _core_sql("SELECT * FROM p UNION ALL SELECT rec_id + (SELECT max(rec_id) + 1 FROM p), elem_id, t_start + 3, t_end + 3 FROM p WHERE rec_id % 50 = 0"))
@on("basket")
def mut_update(p: DataFrame, q: DataFrame) -> DataFrame:
    o = collect_objects(p)
    more = o.where("rec_id % 50 = 0").withColumn("t_start", F.col("t_start") + 3).withColumn("t_end", F.col("t_end") + 3)
    return query.core(explode_objects(mutations.update(o, more)), q)


@add("mut_delete", base("basket") + _FEWER)
@on("basket")
def mut_delete(p: DataFrame, q: DataFrame) -> DataFrame:
    o = collect_objects(p)
    return query.core(explode_objects(mutations.delete(o, o.where("rec_id % 10 = 3").select("rec_id"))), q)


@add("mut_softdelete", base("basket") + _FEWER)
@on("basket")
def mut_softdelete(p: DataFrame, q: DataFrame) -> DataFrame:
    return query.core(mutations.alive(p, p.where("rec_id % 10 = 3").select("rec_id")), q)


@add("extract_records", base("session") + "SELECT rec_id, t_start, t_end, count(*) AS n_elems, sum(elem_id)::BIGINT AS sum_ids FROM p GROUP BY ALL")
@on("session")
def extract_records(p: DataFrame, q: DataFrame) -> DataFrame:
    o = collect_objects(layouts.hint(p, layouts.hint_bounds(p, 8)))
    return o.select("rec_id", "t_start", "t_end", F.size("elements").cast("long").alias("n_elems"), F.aggregate("elements", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


# ---- statistics

add("elem_freq", base("archive") + "SELECT elem_id, count(*) AS freq FROM p GROUP BY elem_id")(on("archive")(lambda p, q: stats.element_frequency(p)))
add(
    "ostats_summary",
    base("basket") + """, o AS (SELECT count(*) AS card, min(t_start) AS g0, max(t_end) AS g1, sum(n_elems)::BIGINT AS entries FROM obj), d AS (SELECT max(elem_id) AS dict, count(DISTINCT elem_id) AS dict_distinct FROM p)
    SELECT card, g1 - g0 AS domain, dict, dict_distinct, entries, card * 12 + entries * 4 AS bytes, log10(card) AS card_log, log10(g1 - g0) AS domain_log, log10(dict) AS dict_log FROM o, d""",
)(on("basket")(lambda p, q: stats.summary(p)))
_EDGE = "floor(power(10.0::DOUBLE, round({i} / 12.0::DOUBLE * log10(n), 12)))::BIGINT"
add(
    "elem_bins",
    base("archive") + f""", f AS (SELECT elem_id + 1 AS rank, count(*) AS freq FROM p GROUP BY elem_id), n AS (SELECT count(*) AS n, (SELECT count(DISTINCT rec_id) FROM p) AS card FROM f),
    r AS (SELECT n, card, i AS bin, CASE WHEN i = 0 THEN 1 ELSE {_EDGE.format(i='i')} + 1 END AS lo, {_EDGE.format(i='(i + 1)')} AS hi FROM n, range(12) t(i)),
    b AS (SELECT bin, lo, hi, n, card, max(freq) AS max_freq FROM r JOIN f ON rank BETWEEN lo AND hi GROUP BY ALL)
    SELECT bin, lo, hi, max_freq, (hi - lo + 1) / n AS dict_ratio, max_freq / card AS post_ratio, max_freq / lag(max_freq) OVER (ORDER BY bin) AS rel_drop FROM b""",
)(on("archive")(lambda p, q: stats.element_bins(p)))
add(
    "extent_bins",
    base("session") + """, t AS (SELECT ntile(8) OVER (ORDER BY length, n_elems, rec_id) - 1 AS bin, length, n_elems FROM obj)
    SELECT bin, count(*) AS objects, min(length) AS min_len, max(length) AS max_len, avg(n_elems) AS avg_elems,
    greatest(0.1, avg(n_elems) * sqrt(exp(greatest(0.0, var_pop(ln(n_elems)))) - 1)) AS dev_elems FROM t GROUP BY bin""",
)(on("session")(lambda p, q: stats.extent_bins(p).select("bin", "objects", "min_len", "max_len", F.round("avg_elems", 6).alias("avg_elems"), F.round("dev_elems", 5).alias("dev_elems"))))
ORACLES["extent_bins"] = ORACLES["extent_bins"].replace("avg(n_elems) AS avg_elems", "round(avg(n_elems), 6) AS avg_elems").replace("greatest(0.1, avg", "round(greatest(0.1, avg").replace("- 1)) AS dev_elems", "- 1)), 5) AS dev_elems")
_RANKS = ", ".join(f"round(coalesce(log10(l[{i + 1}] + 1) / log10(dict), -1), 9) AS rank_{i}" for i in range(9))


@add(
    "qstats",
    base("basket") + f""", d AS (SELECT g0, g1, (SELECT max(elem_id) FROM p) AS dict FROM dom), l AS (SELECT qid, q_start, q_end, list_sort(list(elem_id), 'DESC') AS l FROM q GROUP BY ALL)
    SELECT qid, round((q_start - g0) / (g1 - g0), 9) AS start_rel, round((q_end - g0) / (g1 - g0), 9) AS end_rel, round(log10((q_end - q_start) / (g1 - g0)), 9) AS extent_log, len(l) AS elem_count, {_RANKS} FROM l, d""",
)
@on("basket")
def qstats(p: DataFrame, q: DataFrame) -> DataFrame:
    s = stats.query_stats(q, p)
    return s.select("qid", "elem_count", *(F.round(c, 9).alias(c) for c in s.columns if c not in ("qid", "elem_count")))


add(
    "pstats_selectivity",
    base("basket") + """, c AS (SELECT count(*) AS card FROM obj), r AS (SELECT qid, count(*) AS results FROM res GROUP BY qid), h AS (SELECT DISTINCT qid FROM q)
    SELECT qid, coalesce(results, 0) AS results, coalesce(results, 0) * 100.0::DOUBLE / card AS selectivity, CASE WHEN results > 0 THEN round(log10(results * 100.0::DOUBLE / card), 9) END AS selectivity_log FROM h LEFT JOIN r USING (qid), c""",
)(on("basket")(lambda p, q: stats.performance_stats(query.core(p, q), q, p).withColumn("selectivity_log", F.round("selectivity_log", 9))))


@add("result_medians", base("session") + ", r AS (SELECT rec_id, count(*) AS results FROM res GROUP BY rec_id) SELECT n_elems, median(coalesce(results, 0))::DOUBLE AS median FROM obj LEFT JOIN r USING (rec_id) GROUP BY n_elems")
@on("session")
def result_medians(p: DataFrame, q: DataFrame) -> DataFrame:
    r = query.core(p, q).groupBy("rec_id").agg(F.count("*").alias("results"))
    o = stats.object_sizes(p).select("rec_id", "n_elems").join(r, "rec_id", "left").fillna(0, ["results"])
    return stats.median(o, "n_elems", "results")


# ---- slices

EDGES = """, w AS (SELECT g0::DOUBLE AS g0, (g1::DOUBLE - g0::DOUBLE) / 20 AS w FROM dom), e AS (SELECT i AS slice, g0 + w * i AS s0, g0 + w * (i + 1) AS s1 FROM w, range(20) t(i)),
os AS (SELECT slice, count(rec_id) AS objects, avg(n_elems) AS avg_elems FROM e LEFT JOIN obj ON t_start < s1 AND t_end > s0 GROUP BY slice),
hd AS (SELECT qid, q_start, q_end, max(n) AS k, max(elem_id) AS rarest FROM q GROUP BY ALL),
qs AS (SELECT slice, count(qid) AS queries, avg(q_end - q_start) AS avg_length, avg(k) AS avg_elems, avg(rarest) AS avg_rank FROM e LEFT JOIN hd ON q_start < s1 AND q_end > s0 GROUP BY slice)"""


def _object_slices(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = slices.slice_edges(p)
    return slices.object_slices(stats.object_sizes(p).select("t_start", "t_end", "n_elems"), edges), edges


@add("slice_stats_o", base("session", EDGES) + "SELECT slice, objects, round(avg_elems, 9) AS avg_elems FROM os")
@on("session")
def slice_stats_o(p: DataFrame, q: DataFrame) -> DataFrame:
    return _object_slices(p)[0].withColumn("avg_elems", F.round("avg_elems", 9))


def _query_slices(p: DataFrame, q: DataFrame) -> DataFrame:
    heads = q.groupBy("qid", "q_start", "q_end").agg(F.max("n").alias("n"), F.max("elem_id").alias("rarest"))
    return slices.query_slices(heads, slices.slice_edges(p))


@add("slice_stats_q", base("basket", EDGES) + "SELECT slice, queries, round(avg_length, 9) AS avg_length, round(avg_elems, 9) AS avg_elems, round(avg_rank, 6) AS avg_rank FROM qs")
@on("basket")
def slice_stats_q(p: DataFrame, q: DataFrame) -> DataFrame:
    s = _query_slices(p, q)
    return s.select("slice", "queries", F.round("avg_length", 9).alias("avg_length"), F.round("avg_elems", 9).alias("avg_elems"), F.round("avg_rank", 6).alias("avg_rank"))


FILL = """, gap AS (SELECT slice, CASE WHEN slice % 5 IN (1, 2) OR slice = 0 THEN NULL ELSE objects::DOUBLE END AS v FROM os),
nb AS (SELECT slice, v, max(CASE WHEN v IS NOT NULL THEN slice END) OVER (ORDER BY slice ROWS UNBOUNDED PRECEDING) AS x0,
       min(CASE WHEN v IS NOT NULL THEN slice END) OVER (ORDER BY slice ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1 FROM gap),
fi AS (SELECT nb.slice, coalesce(nb.v, a.v + (b.v - a.v) * (nb.slice - x0) / (x1 - x0), a.v, b.v) AS v FROM nb LEFT JOIN gap a ON a.slice = x0 LEFT JOIN gap b ON b.slice = x1)"""


@add("slice_interpolated", base("session", EDGES + FILL) + "SELECT slice, round(v, 6) AS v FROM fi")
@on("session")
def slice_interpolated(p: DataFrame, q: DataFrame) -> DataFrame:
    gaps = _object_slices(p)[0].select("slice", F.when((F.col("slice") % 5).isin(1, 2) | (F.col("slice") == 0), None).otherwise(F.col("objects").cast("double")).alias("v"))
    return slices.interpolate(gaps, "v").select("slice", F.round("v", 6).alias("v"))


@add(
    "slice_features",
    base("session", EDGES) + """, f AS (SELECT slice, log10(objects + 1) AS a, coalesce(os.avg_elems, 0) AS b, log10(coalesce(avg_length, 0) + 1) AS c, coalesce(qs.avg_elems, 0) AS d, log10(coalesce(avg_rank, 0) + 1) AS e FROM os JOIN qs USING (slice))
    SELECT slice, """ + ", ".join(f"round(CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END, 6) AS f_{c}" for c in "abcde") + " FROM f",
)
@on("session")
def slice_features(p: DataFrame, q: DataFrame) -> DataFrame:
    o = _object_slices(p)[0].select("slice", F.log10(F.col("objects") + 1.0).alias("f_a"), F.coalesce("avg_elems", F.lit(0.0)).alias("f_b"))
    one = lambda c: F.log10(F.coalesce(c, F.lit(0.0)) + 1.0)
    s = _query_slices(p, q).select("slice", one("avg_length").alias("f_c"), F.coalesce("avg_elems", F.lit(0.0)).alias("f_d"), one("avg_rank").alias("f_e"))
    cols = [f"f_{c}" for c in "abcde"]
    return slices.normalized(o.join(s, "slice"), cols).select("slice", *(F.round(c, 6).alias(c) for c in cols))


@add("cluster_bands")
def cluster_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rows_of("session", spark, sf_dir)
    found = slices.cluster_bands(slice_features(spark, sf_dir), slices.slice_edges(p), [f"f_{c}" for c in "abcde"])
    return spark.createDataFrame([(i, float(a), float(z), int(c)) for i, (a, z, c) in enumerate(found)], "band long, band_start double, band_end double, cluster long")


_BANDS = [(0, 400), (401, 1200), (1201, 5000)]
_BAND_SQL = " UNION ALL ".join(f"SELECT {i} AS band, least(t_end, {hi}) - greatest(t_start, {lo}) AS length, n_elems FROM obj WHERE t_start <= {hi} AND t_end >= {lo}" for i, (lo, hi) in enumerate(_BANDS))


@add("band_stats", base("basket") + f"SELECT band::BIGINT AS band, count(*) AS objects, round(avg(length), 9) AS avg_length, round(avg(n_elems), 9) AS avg_elems FROM ({_BAND_SQL}) GROUP BY band")
@on("basket")
def band_stats(p: DataFrame, q: DataFrame) -> DataFrame:
    s = slices.band_stats(stats.object_sizes(p), _BANDS)
    return s.select("band", "objects", F.round("avg_length", 9).alias("avg_length"), F.round("avg_elems", 9).alias("avg_elems"))


# ---- generators


@add("gen_queries_valid", base("basket") + "SELECT DISTINCT qid, true AS sound FROM q")
@on("basket")
def gen_queries_valid(p: DataFrame, q: DataFrame) -> DataFrame:
    return generate.non_empty(generate.queries_from_objects(p, ASK["basket"][0], 10), p)


_FREQS = [(0, 0.1), (0.1, 1), (1, 10), (10, 100)]
_BUCKETS = " UNION ALL ".join(f"SELECT {i}::BIGINT AS bucket, elem_id, freq FROM f WHERE share > {lo} AND share <= {hi}" for i, (lo, hi) in enumerate(_FREQS))
add(
    "gen_freq_buckets",
    base("archive") + f", f AS (SELECT elem_id, count(*) AS freq, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM obj) AS share FROM p GROUP BY elem_id) {_BUCKETS}",
)(on("archive")(lambda p, q: generate.frequency_buckets(p, _FREQS)))
_IN_RANGE = "SELECT qid FROM (SELECT DISTINCT qid FROM q) h LEFT JOIN (SELECT qid, count(*) AS r FROM res GROUP BY qid) USING (qid), (SELECT count(*) AS card FROM obj) WHERE coalesce(r, 0) BETWEEN floor(0.0003 * card) AND ceil(0.01 * card)"


@add("gen_select_filter", base("session") + _IN_RANGE)
@on("session")
def gen_select_filter(p: DataFrame, q: DataFrame) -> DataFrame:
    card = p.select("rec_id").distinct().count()
    return generate.select_by_results(q, query.core(p, q), card, 0.0003, 0.01).select("qid").distinct()


@add(
    "gen_zero_result",
    base("session") + """, hd AS (SELECT DISTINCT qid, q_start, q_end FROM q), mv AS (SELECT qid, lead(q_start) OVER (ORDER BY qid) AS s, lead(q_end) OVER (ORDER BY qid) AS e FROM hd),
    mx AS (SELECT q.qid, s AS q_start, e AS q_end, elem_id, n FROM q JOIN mv USING (qid) WHERE s IS NOT NULL),
    hit AS (SELECT DISTINCT qid FROM (SELECT mx.qid, p.rec_id FROM mx JOIN p ON p.elem_id = mx.elem_id AND p.t_start <= q_end AND q_start <= p.t_end GROUP BY mx.qid, p.rec_id, mx.n HAVING count(*) = mx.n))
    SELECT qid, q_start, q_end, elem_id FROM mx WHERE qid NOT IN (SELECT qid FROM hit)""",
)
@on("session")
def gen_zero_result(p: DataFrame, q: DataFrame) -> DataFrame:
    return generate.without_results(q, lambda e: query.core(p, e)).select("qid", "q_start", "q_end", "elem_id")


@add("alloc_largest_remainder", "SELECT * FROM (VALUES (0::BIGINT, 5::BIGINT), (1, 3), (2, 2)) t(part, n)")
def alloc_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(generate.allocate(10, [0.5, 0.26, 0.24]))), "part long, n long")


_D = generate.draw_sql


@add(
    "gen_objects",
    f"""WITH r AS (SELECT i AS rec_id, least(100000, floor(power(5001.0::DOUBLE, {_D('i', 1)} / 2147483648.0::DOUBLE)) - 1)::BIGINT AS length,
      {_D('i', 2)} / 2147483648.0::DOUBLE AS u, 1 + {_D('i', 3)} % 7 AS k FROM range(2000) t(i)),
    s AS (SELECT rec_id, k, length, CASE WHEN rec_id = 0 THEN 0 ELSE floor(u * (100001 - length))::BIGINT END AS t_start FROM r),
    x AS (SELECT rec_id, t_start, t_start + length AS t_end, unnest(range(1, k + 1)) AS j FROM s),
    e AS (SELECT DISTINCT rec_id, t_start, t_end, least(999, floor(power(1000.0::DOUBLE, {_D('rec_id * 64 + j', 4)} / 2147483648.0::DOUBLE)) - 1)::BIGINT AS elem FROM x
          UNION SELECT 0, 0, (SELECT length FROM s WHERE rec_id = 0), 999)
    SELECT rec_id, t_start, t_end, count(*) AS n_elems, sum(elem)::BIGINT AS sum_ids FROM e GROUP BY ALL""",
)
def gen_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = generate.objects(spark, 2000, 100_000, 1000, 4, 0, 5000)
    return o.select("rec_id", "t_start", "t_end", F.size("elements").cast("long").alias("n_elems"), F.aggregate("elements", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


@add("gen_named_workloads")
@on("basket")
def gen_named_workloads(p: DataFrame, q: DataFrame) -> DataFrame:
    return generate.named_workload(p, "BASE+LONG+FEW+BROAD+RND2", 20)


@add("gen_results_in_range")
@on("session")
def gen_results_in_range(p: DataFrame, q: DataFrame) -> DataFrame:
    """Patterns that ask for few, many or no results, and how many they have."""
    some = generate.named_workload(p, "FEWRESULTS+MANYRESULTS+NORESULTS", 3, lambda e: query.core(p, e))
    counts = query.core(p, some).groupBy("qid").agg(F.count("*").alias("results"))
    return some.select("workload", "qid").distinct().join(counts, "qid", "left").fillna(0, ["results"])


# ---- skylines and scores, over a score table derived from orders and parts

SCORES = """WITH s AS (SELECT 'O' || (o_custkey % 3) AS objects, 'Q' || (o_orderkey % 5) AS queries, o_orderkey % 997 AS xor_result, 1 + (o_orderkey * 37 % 1009)::DOUBLE AS size_mb,
  (o_orderkey * 13 % 101)::DOUBLE AS construction_s, 1 + (o_orderkey * 7919 % 10007)::DOUBLE AS qps,
  (['tif', 'irhint', 'refine'])[1 + o_orderkey % 3] AS category, (['tif;slicing;', 'irhint;perf;', 'tif;hint;mrg;'])[1 + o_orderkey % 3] || (o_orderkey % 7) AS schema FROM orders)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % 3).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("O"), F.col("o_custkey") % 3).alias("objects"), F.concat(F.lit("Q"), k % 5).alias("queries"), (k % 997).alias("xor_result"),
        (1 + k * 37 % 1009).cast("double").alias("size_mb"), (k * 13 % 101).cast("double").alias("construction_s"), (1 + k * 7919 % 10007).cast("double").alias("qps"),
        pick("tif", "irhint", "refine").alias("category"), F.concat(pick("tif;slicing;", "irhint;perf;", "tif;hint;mrg;"), k % 7).alias("schema"),
    )


_SKY = "SELECT {c} FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE {g} b.cost <= a.cost AND b.size_mb <= a.size_mb AND (b.cost < a.cost OR b.size_mb < a.size_mb))"
_COST = SCORES.replace("AS schema FROM orders)", "AS schema, 1 / (1 + (o_orderkey * 7919 % 10007)::DOUBLE) AS cost FROM orders)")


@add("skyline_min", _COST + _SKY.format(c="cost, size_mb, schema", g=""))
def skyline_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.skyline(scores(spark, sf_dir).withColumn("cost", 1 / F.col("qps")), "cost", "size_mb").select("cost", "size_mb", "schema")


@add("skyline_by_template", _COST + _SKY.format(c="objects, queries, category, cost, size_mb", g="a.objects = b.objects AND a.queries = b.queries AND a.category = b.category AND"))
def skyline_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["objects", "queries", "category"]
    return skyline.skyline(scores(spark, sf_dir).withColumn("cost", 1 / F.col("qps")), "cost", "size_mb", by).select(*by, "cost", "size_mb")


@add(
    "tolerance_prune",
    _COST.replace("WITH s AS", "WITH RECURSIVE s AS") + f""", sky AS (SELECT DISTINCT cost, size_mb FROM ({_SKY.format(c='cost, size_mb', g='')})), n AS (SELECT *, row_number() OVER (ORDER BY cost, size_mb) AS i FROM sky),
    f AS (SELECT i, cost AS kc, size_mb AS ks, true AS kept FROM n WHERE i = 1 UNION ALL
      SELECT n.i, CASE WHEN better THEN cost ELSE kc END, CASE WHEN better THEN size_mb ELSE ks END, better FROM (SELECT n.*, kc, ks, (cost < kc * 0.95 OR size_mb < ks * 0.95) AS better FROM f JOIN n ON n.i = f.i + 1) n)
    SELECT kc AS cost, ks AS size_mb FROM f WHERE kept""",
)
def tolerance_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    sky = skyline.skyline(scores(spark, sf_dir).withColumn("cost", 1 / F.col("qps")), "cost", "size_mb")
    return skyline.prune_frame(sky, "cost", "size_mb", 0.05)


@add("score_dedup", SCORES + "SELECT objects, queries, schema, xor_result, size_mb, construction_s, max(qps) AS qps FROM s GROUP BY ALL")
def score_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.dedup(scores(spark, sf_dir)).drop("category")


@add("score_filter", SCORES + "SELECT schema, qps FROM s WHERE (contains(schema, 'tif') OR contains(schema, 'perf')) AND (contains(schema, ';3') OR contains(schema, ';4'))")
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where(skyline.matching(F.col("schema"), "tif,perf|;3,;4")).select("schema", "qps")


@add(
    "score_relative",
    SCORES + """, b AS (SELECT objects, queries, max({'q': qps, 's': -size_mb}) AS b FROM s GROUP BY ALL)
    SELECT objects, queries, schema, qps, qps * 100 / b.b.q AS qps_percent, size_mb * -100 / b.b.s AS size_percent FROM s JOIN b USING (objects, queries)""",
)
def score_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.relative(scores(spark, sf_dir)).select("objects", "queries", "schema", "qps", "qps_percent", "size_percent")


@add("score_pivot", SCORES + "SELECT objects, queries, max(qps) FILTER (category = 'tif') AS tif, max(qps) FILTER (category = 'irhint') AS irhint, max(qps) FILTER (category = 'refine') AS refine FROM s GROUP BY ALL")
def score_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skyline.pivot_best(scores(spark, sf_dir), "category", ["tif", "irhint", "refine"])


@add("score_template", SCORES + r"SELECT regexp_replace(schema, '(;?-?[0-9.]+)+$', '') AS template, count(*) AS n, max(qps) AS qps FROM s GROUP BY 1")
def score_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy(skyline.template(F.col("schema")).alias("template")).agg(F.count("*").alias("n"), F.max("qps").alias("qps"))


_BAND = SCORES + ", c AS (SELECT xor_result % 23 AS band, min({'cost': 1 / qps, 'config': schema}) AS b FROM s WHERE xor_result % 23 % 4 <> 1 GROUP BY 1), n AS (SELECT i AS band FROM range(23) t(i))"


@add("bands_best_filled", _BAND + """, j AS (SELECT n.band, c.b, max(CASE WHEN c.b IS NOT NULL THEN n.band END) OVER (ORDER BY n.band ROWS UNBOUNDED PRECEDING) AS l,
    min(CASE WHEN c.b IS NOT NULL THEN n.band END) OVER (ORDER BY n.band ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM n LEFT JOIN c USING (band))
    SELECT j.band, c.b.config AS config, c.b.cost AS cost FROM j JOIN c ON c.band = coalesce(l, r)""")
def bands_best_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.col("xor_result") % 23
    rows = scores(spark, sf_dir).where(band % 4 != 1).select(band.alias("band"), F.col("schema").alias("config"), (1 / F.col("qps")).alias("cost"))
    return skyline.fill_bands(skyline.best_per_band(rows), spark.range(23).select(F.col("id").alias("band"))).select("band", "config", "cost")


@add("combined_throughput", SCORES + "SELECT round(sum(xor_result)::DOUBLE / sum(xor_result / qps), 6) AS qps FROM s")
def combined_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).select(F.col("xor_result").alias("queries"), (1 / F.col("qps")).alias("sec_per_query"))
    return skyline.combined_qps(rows).select(F.round("qps", 6).alias("qps"))


# ---- configurations, search and the cost model

_LO, _HI = [0, 1, 0, 0, 1.8, 0.3, 0.6, 4], [0, 1, 0, 0, 2.8, 0.9, 1, 14]
_GRID = """WITH g AS (SELECT 1.8::DOUBLE + (i % 6) * (1.0::DOUBLE / 5) AS alpha, 0.3::DOUBLE + (i // 6 % 6) * (0.6::DOUBLE / 5) AS beta, 0.6::DOUBLE + (i // 36 % 6) * (0.4::DOUBLE / 5) AS boundary,
  4 + (i // 216) * (10.0::DOUBLE / 5) AS levels FROM range(1296) t(i))"""


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(F.get("encoding", 4 + i), 6).alias(c) for i, c in enumerate(("alpha", "beta", "boundary", "levels"))))


_BOWL = "power(alpha - 2.31, 2) + power(beta - 0.52, 2) + power(boundary - 0.83, 2) + power((levels - 9) / 10, 2)"


def _bowl(rows: DataFrame) -> DataFrame:
    d = lambda i, c, s=1.0: F.pow((F.get("encoding", i) - c) / s, F.lit(2.0))
    return rows.withColumn("cost", d(4, 2.31) + d(5, 0.52) + d(6, 0.83) + d(7, 9.0, 10.0))


@add("grid_candidates", _GRID + "SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(boundary, 6) AS boundary, round(levels, 6) AS levels FROM g")
def grid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(search.grid(spark, _LO, _HI, 6))


@add("grid_topk", _GRID + f"SELECT round(cost, 9) AS cost FROM (SELECT {_BOWL} AS cost FROM g ORDER BY cost LIMIT 20)")
def grid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best(_bowl(search.grid(spark, _LO, _HI, 6)), 20).select(F.round("cost", 9).alias("cost"))


def _search_sql() -> str:
    """The rounds of a search of four open places, in the order of its own arithmetic."""
    names = ("alpha", "beta", "boundary", "levels")
    lo, hi = _LO[4:], _HI[4:]
    points, keep = search.ROUNDS[0]
    first = ", ".join(f"{a!r}::DOUBLE + (i // {points**j} % {points}) * {(z - a) / (points - 1)!r}::DOUBLE AS {n}" for j, (n, a, z) in enumerate(zip(names, lo, hi, strict=True)))
    cols = ", ".join(names)
    out = f"WITH r0 AS (SELECT {first} FROM range({points**4}) t(i)), k0 AS (SELECT {cols}, {_BOWL} AS cost FROM r0 ORDER BY cost, {cols} LIMIT {keep})"
    radius = [(z - a) / (points - 1) / 2 for a, z in zip(lo, hi, strict=True)]
    for i, (points, keep) in enumerate(search.ROUNDS[1:], 1):
        steps = [f"(VALUES {', '.join(f'({float(-r + 2 * r * k / (points - 1))!r}::DOUBLE)' for k in range(points))}) d_{n}(s_{n})" for n, r in zip(names, radius, strict=True)]
        moved = ", ".join(f"greatest({a!r}::DOUBLE, least({z!r}::DOUBLE, {n} + s_{n})) AS {n}" for n, a, z in zip(names, map(float, lo), map(float, hi), strict=True))
        out += f", r{i} AS (SELECT DISTINCT {moved} FROM k{i - 1}, {', '.join(steps)}), k{i} AS (SELECT * FROM (SELECT {cols}, {_BOWL} AS cost FROM r{i} UNION ALL SELECT * FROM k{i - 1}) ORDER BY cost, {cols} LIMIT {keep})"
        radius = [r / (points - 1) for r in radius]
    return out + " SELECT " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + f", round(cost, 9) AS cost FROM k{len(search.ROUNDS) - 1}"


@add("grid_search", _search_sql())
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rounds of the search."""
    found = search.search(spark, _LO, _HI, _bowl)
    return found.select(*(F.round(F.get("encoding", 4 + i), 6).alias(n) for i, n in enumerate(("alpha", "beta", "boundary", "levels"))), F.round("cost", 9).alias("cost"))


@add(
    "dsl_encode",
    """SELECT * FROM (VALUES ('slicing', 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 2.1::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE, -1.0::DOUBLE), ('time', 0, 0, 0, 0, -1, -1, 1, 9),
    ('two', 0, 0, 0, 1, 1.5, 2.5, 0.75, 7), ('basic', 1, 0, 0, 0, -1, -1, 0, -1)) t(name, basic, slicing, sharding, hint, alpha, beta, boundary, levels)""",
)
def dsl_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = {
        "slicing": '{"method":"tif;slicing;a;dyn;2.1;0.5"}',
        "time": '{"method":"irhint;perf;9"}',
        "two": '{"refine":"elemfreq","fanout":[{"range":"0.75-1","method":"tif;hint;mrg;dyn;1.5;2.5"},{"range":"0-0.75","method":"irhint;perf;7"}]}',
        "basic": '{"method":"tif;basic"}',
    }
    kinds = ", ".join(f"{c} double" for c in schema.ENCODING)
    return spark.createDataFrame([(k, *schema.encode(schema.parse(v)[0])) for k, v in configs.items()], f"name string, {kinds}")


@add("dsl_design_space")
def dsl_design_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g, n, lo, hi, schema.variable(lo, hi)) for g, n, lo, hi in schema.design_space()]
    return spark.createDataFrame(rows, "grp string, template string, lo array<double>, hi array<double>, open_places array<long>")


def _features(spark: SparkSession, p: DataFrame, q: DataFrame) -> DataFrame:
    return _with_space(spark, stats.summary(p), stats.extent_bins(p), stats.element_bins(p), stats.query_stats(q, p))


def _with_space(spark: SparkSession, *parts: DataFrame) -> DataFrame:
    space = schema.design_space(["pure", "dict2"])
    configs = spark.createDataFrame([(n, lo) for _, n, lo, _ in space], "config string, encoding array<double>")
    return costmodel.features(*parts, configs)


def _features_of(fixture: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's features; the statistics that they come from are written once."""
    p, q = rows_of(fixture, spark, sf_dir), asked_of(fixture, spark, sf_dir)
    made = {"summary": lambda: stats.summary(p), "extents": lambda: stats.extent_bins(p), "elements": lambda: stats.element_bins(p), f"queries {ASK[fixture]}": lambda: stats.query_stats(q, p)}
    return _with_space(spark, *(once(spark, sf_dir, f"{fixture} statistics {name}", make) for name, make in made.items()))


@add("lcm_features")
def lcm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features_of("basket", spark, sf_dir).select("qid", "config", F.size("features").alias("size"), "features")


@add("lcm_predict")
def lcm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on rows whose seconds follow the configuration and the query, then asked for all."""
    rows = _features_of("basket", spark, sf_dir)
    place = 2 + 24 + 12
    known = rows.withColumn("throughput_log", F.get("features", place + 11 + 4) / 4 + F.get("features", place + 2)).withColumn("size_log", F.get("features", 0))
    net, _ = costmodel.train_frame(known, seed=1)
    found = costmodel.predict(known.withColumnRenamed("throughput_log", "t").withColumnRenamed("size_log", "s"), net, ("qid", "config", "t"))
    return costmodel.aggregate(found).join(costmodel.accuracy(found, ["config"], "t", "throughput_log"), "config")


_ACC = SCORES + ", a AS (SELECT category, log10(qps) AS t, log10(qps) + (xor_result % 7 - 3) / 50.0::DOUBLE AS u FROM s)"


@add("lcm_accuracy", _ACC + "SELECT category, round(avg(abs(t - u)), 9) AS mae_log, round(avg(abs(power(10, u) - power(10, t)) / power(10, t)), 9) AS mre, count(*) AS rows FROM a GROUP BY category")
def lcm_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).select("category", F.log10("qps").alias("t"), (F.log10("qps") + (F.col("xor_result") % 7 - 3) / 50.0).alias("u"))
    a = costmodel.accuracy(s, ["category"], "t", "u")
    return a.select("category", F.round("mae_log", 9).alias("mae_log"), F.round("mre", 9).alias("mre"), "rows")


@add("query_order_ranks", base("session") + "SELECT qid, rec_id, row_number() OVER (PARTITION BY qid ORDER BY t_start, rec_id) AS place FROM res JOIN obj USING (rec_id) QUALIFY place <= 3")
@on("session")
def query_order_ranks(p: DataFrame, q: DataFrame) -> DataFrame:
    """The three earliest results of each query."""
    o = p.select("rec_id", "t_start").distinct()
    place = F.row_number().over(Window.partitionBy("qid").orderBy("t_start", "rec_id"))
    return query.core(p, q).join(o, "rec_id").withColumn("place", place).where("place <= 3").select("qid", "rec_id", F.col("place").cast("long").alias("place"))


from . import queries_more  # noqa: E402, F401  (registers the others)
