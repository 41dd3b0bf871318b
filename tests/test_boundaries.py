"""Hand-written cases: touching ends, page and band bounds, mutations, unknown elements."""

import itertools
import random

import pytest

from kairoframe.operators import ensembles, layouts, mutations, query
from kairoframe.operators.postings import collect_objects, dictionary, explode_objects, ranked, subset
from kairoframe.plans.engine import Collection, answer, register, REGISTRY


def objects(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, t_start long, t_end long, elements array<bigint>")


def queries(spark, rows):
    return spark.createDataFrame(rows, "qid long, q_start long, q_end long, elems array<bigint>")


CONFIGS = [
    '{"method":"tif;basic"}',
    '{"method":"tif;slicing;a;static;8"}',
    '{"method":"tif;slicing;b;dyn;0.3;0.9"}',
    '{"method":"tif;sharding;static;2"}',
    '{"method":"tif;hint;mrg;static;3"}',
    '{"method":"tif;hint;mrg;dyn;0.2;3"}',
    '{"method":"irhint;perf;4"}',
    '{"refine":"elemfreq","fanout":[{"range":"0.5-1","method":"tif;basic"},{"range":"0-0.5","method":"irhint;perf;4"}]}',
    '{"split":"temporal","fanout":[{"range":"0-0.5","method":"tif;basic"},{"range":"0.5-1","method":"tif;basic"}]}',
    '{"slice":"temporal","fanout":[{"range":"0-0.5","method":"tif;basic"},{"range":"0.5-1","method":"tif;basic"}]}',
    '{"hybrid":"moveout-refine","fanout":[{"method":"irhint;perf;3"},{"method":"tif;basic"}]}',
    '{"slice":"temporal","fanout":[{"range":"0.2-0.4","method":"irhint;perf;3"},{"range":"0.6-0.8","method":"tif;sharding;static;5"}]}',
    '{"split":"temporal","fanout":[{"range":"0-0.5","refine":"elemfreq","fanout":[{"range":"0.5-1","method":"tif;slicing;a;static;4"},{"range":"0-0.5","method":"tif;hint;mrg;static;3"}]},{"range":"0.5-1","method":"tif;sharding;dyn;0.5;0.5"}]}',
    '[{"band_range":"0-0.5","method":"tif;basic"},{"band_range":"0.5-1","method":"irhint;perf;2"}]',
]
CASES = {
    "touching ends": ([(1, 0, 5, [1])], (5, 9, [1]), [1]),
    "no length": ([(1, 5, 5, [1])], (5, 5, [1]), [1]),
    "starts at the domain's end": ([(1, 0, 3, [1]), (2, 10, 10, [1])], (0, 10, [1]), [1, 2]),
    "ends at a band's start": ([(1, 0, 5, [1]), (2, 0, 10, [2])], (5, 7, [1]), [1]),
    "spans pages": ([(1, 2, 8, [1]), (2, 0, 10, [2])], (0, 10, [1]), [1]),
    "fits no page": ([(1, 4, 6, [1]), (2, 0, 10, [2])], (5, 5, [1]), [1]),
    "unknown element": ([(1, 0, 5, [1])], (0, 9, [77]), []),
    "all elements": ([(1, 0, 5, [3, 1])], (0, 9, [1, 3]), [1]),
    "one is missing": ([(1, 0, 5, [3, 1])], (0, 9, [0, 1, 3]), []),
    "repeated elements": ([(1, 0, 5, [3, 3, 1])], (0, 9, [3, 3]), [1]),
    "outside the domain": ([(1, 0, 5, [1])], (7, 9, [1]), []),
    "negative times": ([(1, -9, -4, [1]), (2, -3, 0, [1])], (-5, -4, [1]), [1]),
}


@pytest.mark.parametrize("case", CASES)
def test_case(spark, case):
    rows, (start, end, elems), want = CASES[case]
    c = Collection(objects(spark, rows))
    q = queries(spark, [(0, start, end, elems)])
    for config in CONFIGS:
        assert sorted(r.rec_id for r in c.query(q, config).collect()) == want, config


def test_random_agreement(spark):
    rng = random.Random(3)
    rows = [(i, s, s + rng.choice([0, 0, 3, 40]), rng.sample(range(12), rng.randint(1, 5))) for i, s in ((i, rng.randint(-20, 100)) for i in range(60))]
    asks = [(j, s, s + rng.choice([0, 2, 30]), rng.sample(range(13), rng.randint(1, 3))) for j, s in ((j, rng.randint(-30, 110)) for j in range(40))]
    want = sorted((q[0], r[0]) for q, r in itertools.product(asks, rows) if r[1] <= q[2] and q[1] <= r[2] and set(q[3]) <= set(r[3]))
    o, q = objects(spark, rows), queries(spark, asks)
    assert sorted(map(tuple, query.naive(o, q).collect())) == want
    p, elems = explode_objects(o), query.query_elems(q)
    assert sorted(map(tuple, query.rarest_first(p, elems).collect())) == want
    for config in CONFIGS:
        assert sorted(map(tuple, answer(p, elems, config).collect())) == want, config
    alone = sorted((q[0], r[0]) for q, r in itertools.product(asks, rows) if r[1] <= q[2] and q[1] <= r[2])
    assert sorted(map(tuple, query.interval_only(o, q, 7).collect())) == alone


def test_empty_elements_are_refused(spark):
    with pytest.raises(Exception, match="no elements"):
        Collection(objects(spark, [(1, 0, 5, [1])])).query(queries(spark, [(0, 0, 9, [])])).collect()


def test_no_objects(spark):
    c = Collection(objects(spark, []))
    assert c.query(queries(spark, [(0, 0, 9, [1])])).collect() == []


def test_mutations(spark):
    c = Collection(objects(spark, [(0, 0, 5, [1]), (1, 2, 3, [1])]))
    q = queries(spark, [(0, 0, 100, [1])])
    ids = lambda x: sorted(r.rec_id for r in x.query(q).collect())
    grown = c.update(objects(spark, [(0, 50, 60, [1])]))
    assert ids(grown) == [0, 1, 2]
    one = spark.createDataFrame([(1,)], "rec_id long")
    assert ids(grown.delete(one)) == [0, 2]
    dead = grown.soft_delete(one).soft_delete(spark.createDataFrame([(2,)], "rec_id long"))
    assert ids(dead) == [0]
    assert mutations.restore(dead.tombstones, one).count() == 1


def test_rewrite_touches_only_some_partitions(spark, tmp_path):
    p = spark.createDataFrame([(1, 0, 5, 1, 0), (2, 0, 5, 1, 0), (3, 9, 9, 1, 1), (4, 20, 20, 1, 2)], "rec_id long, t_start long, t_end long, elem_id long, band int")
    path = str(tmp_path / "layout")
    p.write.partitionBy("band").parquet(path)
    touched = mutations.rewrite_touched(spark, path, spark.createDataFrame([(2,), (4,)], "rec_id long"))
    assert sorted(touched) == [0, 2]
    spark.catalog.refreshByPath(path)
    assert sorted(r.rec_id for r in spark.read.parquet(path).collect()) == [1, 3]


def test_subset_and_collect(spark):
    o = objects(spark, [(1, 0, 5, [3, 1]), (2, 0, 5, [9])])
    assert [(r.rec_id, r.elements) for r in subset(o, 0, 3).collect()] == [(1, [3, 1])]
    bounds = layouts.hint_bounds(explode_objects(o), 3)
    back = collect_objects(layouts.hint(explode_objects(o), bounds))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, o.collect()))


def test_ranks_by_ranges(spark):
    tokens = spark.createDataFrame([(i, f"w{(i * i) % 97}") for i in range(3000)], "rec_id long, elem string")
    plain = dictionary(tokens)
    freq = tokens.groupBy("elem").count().withColumnRenamed("count", "freq")
    other = ranked(freq, freq.count(), 7).select(*plain.columns)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, other.collect()))


def test_own_access_path(spark):
    @register("own;path")
    def builder(args):
        return query.core

    try:
        c = Collection(objects(spark, [(1, 0, 5, [1])]))
        assert c.query(queries(spark, [(0, 0, 9, [1])]), '{"method":"own;path;3"}').count() == 1
    finally:
        del REGISTRY["own;path"]


def test_bands_cover(spark):
    assert ensembles.bands_of(0, 10, 3) == [(0, 3), (4, 7), (8, 10)]


def test_every_child_path_is_asked(spark, monkeypatch):
    """Composed configurations use the methods of all their children."""
    from kairoframe.plans import engine

    seen = []
    for name in list(REGISTRY):
        inner = REGISTRY[name]
        monkeypatch.setitem(REGISTRY, name, lambda args, inner=inner: seen.append(";".join(args)) or inner(args))
    p = explode_objects(objects(spark, [(i, i, i + 7, [i % 5, 5 + i % 3, 9]) for i in range(40)]))
    q = query.query_elems(queries(spark, [(0, 3, 20, [1, 9]), (1, 10, 12, [5, 9, 2])]))
    want = sorted(map(tuple, query.core(p, q).collect()))
    kinds = ["tif;slicing;a;static;3", "irhint;perf;3", "tif;hint;mrg;static;2", "tif;sharding;static;2"]
    a, b, c, d = (f'"method":"{k}"' for k in kinds)
    inner = f'{{"range":"0-0.5","refine":"elemfreq","fanout":[{{"range":"0.5-1",{a}}},{{"range":"0-0.5",{b}}}]}}'
    for outer in ("split", "slice"):
        seen.clear()
        config = f'{{"{outer}":"temporal","fanout":[{inner},{{"range":"0.5-1","hybrid":"moveout-refine","fanout":[{{{c}}},{{{d}}}]}}]}}'
        assert sorted(map(tuple, engine.answer(p, q, config).collect())) == want
        assert sorted(seen) == sorted(kinds)
    for bad in ('{"refine":"elemfreq","fanout":[{"range":"0.5-1","method":"tif;basic"}]}', '{"split":"space","fanout":[]}', '{"hybrid":"moveout-refine","fanout":[{"method":"tif;basic"}]}'):
        with pytest.raises(ValueError):
            engine.answer(p, q, bad)


@pytest.mark.parametrize("method", ["tif;basic", "tif;slicing;a;static;5", "tif;slicing;a;dyn;0.3;0.9", "tif;hint;mrg;static;4", "tif;hint;mrg;dyn;0.2;3", "irhint;perf;4", "tif;sharding;static;2", "tif;sharding;dyn;0.5;0.5"])
def test_stored_layouts_change_in_place(spark, tmp_path, method):
    from kairoframe.plans.layout import StoredLayout

    rows = [(i, i * 3 % 50, i * 3 % 50 + i % 9, [i % 4, 4 + i % 3]) for i in range(60)]
    more = [(100 + i, 40 + i, 70 + i, [i % 4, 4, 50 + i]) for i in range(6)]
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "rec_id long")
    q = query.query_elems(queries(spark, [(0, 3, 20, [1, 4]), (1, 30, 90, [0, 4]), (2, -5, 200, [2]), (3, 41, 80, [53])]))
    layout = StoredLayout(spark, str(tmp_path / "layout"), method).create(explode_objects(objects(spark, rows)))
    layout.update(explode_objects(objects(spark, more)))
    layout.delete(ids([0, 5, 101]))
    layout.soft_delete(ids([7, 8]))
    layout.soft_delete(ids([8, 9]))
    want = lambda gone: sorted(map(tuple, query.core(explode_objects(objects(spark, [r for r in rows + more if r[0] not in gone])), q).collect()))
    again = StoredLayout(spark, str(tmp_path / "layout"), method)
    assert sorted(map(tuple, again.query(q).collect())) == want({0, 5, 101, 7, 8, 9})
    again.compact()
    again.data.vacuum()
    assert sorted(map(tuple, again.query(q).collect())) == want({0, 5, 101, 7, 8, 9})


def test_stored_tables_rewrite_only_what_is_touched(spark, tmp_path):
    from kairoframe.sources.stored import Stored

    t = Stored(spark, str(tmp_path / "t")).create(spark.createDataFrame([(i, i % 4) for i in range(40)], "rec_id long, part long"), "part", ["rec_id"])
    before = t.manifest()["parts"]
    assert t.delete(spark.createDataFrame([(4,), (8,), (777,)], "rec_id long")) == ["0"]
    after = t.manifest()["parts"]
    assert {v: f for v, f in after.items() if v != "0"} == {v: f for v, f in before.items() if v != "0"} and after["0"] != before["0"]
    assert t.rows().count() == 38 and "PartitionFilters: [isnotnull(part" in t.rows().where("part = 2")._jdf.queryExecution().toString()
    t.append(spark.createDataFrame([(900, 9), (901, 0)], "rec_id long, part long"))
    assert sorted(r.rec_id for r in t.rows().where("part in (0, 9)").collect()) == sorted([*(i for i in range(0, 40, 4) if i not in (4, 8)), 900, 901])
    t.delete(spark.createDataFrame([(900,)], "rec_id long"))
    assert t.rows().where("part = 9").count() == 0


def random_workload(seed):
    r = random.Random(seed)
    rows = [(i, (s := r.randint(-50, 900)), s + r.choice([0, 1, 7, 60, 800]), r.sample(range(9), r.randint(1, 5))) for i in range(150)]
    asks = [(i, (s := r.randint(-90, 990)), s + r.choice([0, 3, 40, 300]), r.sample(range(9), r.randint(1, 3))) for i in range(60)]
    return rows, asks


@pytest.mark.parametrize("small", [0, 16])
def test_naive_in_windows_compares_what_overlaps(spark, monkeypatch, small):
    monkeypatch.setattr(query, "SMALL", small)
    rows, asks = random_workload(small)
    o, q = objects(spark, rows), queries(spark, asks)
    found = query.naive_in_windows(explode_objects(o), o, q)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, query.naive(o, q).collect()))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert query.naive_in_windows(explode_objects(o.limit(0)), o.limit(0), q.limit(0)).count() == 0


def test_paths_told_in_windows(spark):
    rows, asks = random_workload(5)
    o, q = objects(spark, rows), queries(spark, asks)
    p, elems = explode_objects(o), query.query_elems(q)
    seen = []

    def path(some, asked):
        seen.append(some.join(asked, "elem_id").count())
        return query.core(some, asked)

    pairs = query.naive(o, q).collect()
    want = 0
    for r in pairs:
        want ^= r.rec_id
    for limit in (1, 500, 10**9):
        seen.clear()
        assert query.told_in_windows(p, elems, {"core": path}, limit) == {"core": (len(pairs), want)}
        assert len(seen) == 1 if limit == 10**9 else len(seen) > 2
        assert limit != 500 or max(seen) <= 500
    assert query.told_in_windows(p.limit(0), elems, {"core": path}) == {"core": (0, None)}
