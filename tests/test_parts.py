"""Files, configurations, search, the cost model, skylines, generators and the stream."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoframe.functions.predicates import element_bound
from kairoframe.operators import costmodel, generate, query, search, skyline, slices, stats
from kairoframe.operators.postings import explode_objects
from kairoframe.plans import schema
from kairoframe.sources import files
from kairoframe.streaming import append


def test_object_files(spark, tmp_path):
    path = tmp_path / "o.dat"
    path.write_text("0 5 3,1,9\n2 2 4\n7 9 1,1\n")
    o = files.read_objects(spark, str(path))
    assert sorted(map(tuple, o.collect())) == [(0, 0, 5, [9, 3, 1]), (1, 2, 2, [4]), (2, 7, 9, [1])]
    files.write_objects(o, str(tmp_path / "out"))
    again = files.read_objects(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, o.collect()))
    assert files.read_intervals(spark, str(path)).columns == ["rec_id", "t_start", "t_end"]
    head, tail = files.head_tail(o, 67)
    assert (head.count(), tail.count()) == (2, 1)


def test_inverted_intervals_are_refused(spark, tmp_path):
    path = tmp_path / "o.dat"
    path.write_text("5 0 1\n")
    with pytest.raises(Exception, match="inverted interval"):
        files.read_objects(spark, str(path)).collect()


def test_queries_and_ids(spark, tmp_path):
    (tmp_path / "a.qry").write_text("0 5 3,1\n")
    (tmp_path / "b.qry").write_text("1 2 7\n3 3 8\n")
    q = files.read_queries(spark, f"{tmp_path}/a.qry|{tmp_path}/b.qry")
    assert sorted((r.workload, r.qid) for r in q.collect()) == [("a", 0), ("b", 0), ("b", 1)]
    (tmp_path / "ids.dat").write_text("4\n9\n")
    assert sorted(r.rec_id for r in files.read_ids(spark, str(tmp_path / "ids.dat")).collect()) == [4, 9]


def test_score_files(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("objects\tqueries\txor\tsize\tcon\tqps\tcat\tschema\nO\tQ\t1\t2.0\t3.0\t4.0\tc\ts\nbad\tx\tnot a number\t1\t1\t1\tc\ts\n")
    assert [tuple(r) for r in files.read_scores(spark, str(path)).collect()] == [("O", "Q", 1, 2.0, 3.0, 4.0, "c", "s")]


def test_cached_workload_and_training_files(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "w"), make).count() == 3
    assert len(made) == 1
    files.write_tsv(spark.createDataFrame([(float(i), float(-i)) for i in range(50)], "a double, b double"), str(tmp_path / "t"))
    files.tsv_to_parquet(spark, str(tmp_path / "t"), str(tmp_path / "p"), "a double, b double")
    assert sum(spark.read.parquet(f"{tmp_path}/p/{x}").count() for x in ("train", "val", "test")) == 50


def test_schema_round_trip():
    text = '{"refine":"elemfreq","fanout":[{"range":"0.8-1","method":"tif;basic"},{"range":"0-0.8","method":"irhint;perf;9"}]}'
    (s,) = schema.parse(text)
    assert json.loads(schema.serialize(s)) == json.loads(text)
    assert schema.decode(schema.encode(s)) == s
    with pytest.raises(ValueError, match="unknown"):
        schema.parse('{"methods":"tif;basic"}')
    (one,) = schema.parse('{"refine":"elemfreq","fanout":[{"method":"tif;basic"}]}')
    assert schema.serialize(one) == '{"method":"tif;basic"}'
    assert len(schema.parse('[{"band_range":"0-0.5","method":"tif;basic"},\n# a comment\n{"band_range":"0.5-1","method":"irhint;perf;4"},]')) == 2


@pytest.mark.parametrize("method", ["tif;basic", "tif;slicing;a;dyn;2;0.5", "tif;sharding;dyn;1.9;0.7", "tif;hint;mrg;dyn;1.5;3.25", "irhint;perf;9"])
def test_single_methods_decode(method):
    (s,) = schema.parse(json.dumps({"method": method}))
    assert schema.decode(schema.encode(s)) == s


def test_design_space_and_instances():
    for group in schema.ENCODED:
        for template in schema.TEMPLATES[group].values():
            lo, hi = schema.corners(template)
            for seed in range(10):
                s = schema.instantiate(template, seed)
                assert schema.sane(s)
                assert all(a - 1e-9 <= x <= b + 1e-9 for a, x, b in zip(schema.encode(lo), schema.encode(s), schema.encode(hi), strict=True)), group
    two = schema.closure({"method": "tif;slicing;[a,b];static;4"})
    assert [t["method"] for t in two] == ["tif;slicing;a;static;4", "tif;slicing;b;static;4"]
    assert schema.merged({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}}
    assert schema.get({"a": {"b": 1}}, "a.b") == 1


def test_element_bounds():
    assert [element_bound(x, 1000) for x in (0, 0.5, 1)] == [0, math.ceil(1000**0.5), 1000]


def test_search_finds_the_bowl(spark):
    lo, hi = [0, 0.0, 1.0], [0, 4.0, 3.0]

    def cost(rows):
        return rows.selectExpr("encoding", "pow(encoding[1] - 1.3, 2) + pow(encoding[2] - 2.2, 2) AS cost")

    top = search.search(spark, lo, hi, cost, ((6, 5), (5, 5), (5, 1))).collect()
    assert abs(top[0].encoding[1] - 1.3) < 0.15 and abs(top[0].encoding[2] - 2.2) < 0.1


def test_skyline_forms_agree(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(80)] + [("a", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    want = sorted(r for r in rows if r[1] is not None and not any(o[0] == r[0] and o[1] is not None and o[1] <= r[1] and o[2] <= r[2] and o[1:] != r[1:] for o in rows))
    assert sorted(map(tuple, skyline.skyline(df, "x", "y", ["g"]).collect())) == want
    assert sorted(map(tuple, skyline.skyline_anti(df.where("x is not null"), ["x", "y"], ["g"]).collect())) == want
    points = sorted({r[1:] for r in want if r[0] == "a"})
    folded = skyline.prune_frame(skyline.skyline(df, "x", "y", ["g"]), "x", "y", 0.1, ["g"]).where("g = 'a'")
    assert sorted(tuple(r)[1:] for r in folded.collect()) == sorted(skyline.prune(points, (0, 1), 0.1))


def test_presented_and_consistent(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.01), ("c", 2.0), ("d", 3.0)], "config string, cost double")
    assert [r.config for r in skyline.presented(df, "cost", 2, 0.05).collect()] == ["a", "c"]
    r = spark.createDataFrame([("x", "w", 1, 2), ("y", "w", 1, 3)], "layout string, workload string, results long, xor_ids long")
    assert skyline.consistent(r).count() == 1


def test_presented_in_one_order(spark):
    rows = [("c", 1.0), ("a", 1.0), ("b", 1.0), ("d", 2.0), (None, None), ("e", 2.0)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "config string, cost double").repartition(3)
        assert [tuple(r) for r in skyline.presented(df, "cost", 5, 0.05).collect()] == [("a", 1.0), ("d", 2.0)]
    # Many steps that are near the one before do not use up the k.
    near = spark.createDataFrame([(i, 1.0 + i / 1000) for i in range(60)] + [(60, 9.0)], "config long, cost double")
    assert [r.config for r in skyline.presented(near, "cost", 2, 0.05).collect()] == [0, 60]


def test_segments_and_clusters():
    points = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    assert slices.segment(points, 3)[0] == [0, 0, 1, 1, 2]
    assert len(set(slices.free_clusters(points, 3)[0])) == 3
    assert slices.elbow([10.0, 1.0, 0.9, 0.8]) == 2
    assert slices.elbow([1.0]) == 1


def test_training_rows_lie_in_a_file(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 57))
    x[:, 5:40] = 2.5
    rows = [(list(map(float, a)), float(a[0] - a[41]), float(a[5])) for a in x]
    df = spark.createDataFrame(rows, "features array<double>, throughput_log double, size_log double")
    n, lo, hi = costmodel._extent(df)
    kept = costmodel._filed(df, n, lo, hi)
    assert (n, len(kept), len(kept.vary)) == (9000, 9000, 22)
    a, b = (np.concatenate(v) for v in zip(*kept.blocks(), strict=True))
    order, own = np.argsort(a[:, 0]), np.argsort(x[:, 0])
    assert np.array_equal(a[order], x[own]) and np.array_equal(b[order, 0], (x[:, 0] - x[:, 41])[own])
    some = np.array([8999, 0, 4096, 0])
    assert np.array_equal(kept.take(some)[0], a[some]) and np.array_equal(kept.take(some)[1], b[some])
    in_memory, told = costmodel.train(a, b, (a[:5000], b[:5000]), epochs=1)
    filed, losses = costmodel.fit(kept, costmodel.Arrays(a[:5000], b[:5000]), epochs=1)
    assert told == losses and np.array_equal(in_memory.weights[0], filed.weights[0])
    empty = costmodel._filed(df.where("throughput_log > 1e9"), n, lo, hi)
    assert len(empty) == 0 and np.isnan(costmodel.Network.fresh().loss(empty))


def test_training_takes_every_row(spark, monkeypatch):
    n = 1_600_000
    told = []
    monkeypatch.setattr(costmodel, "fit", lambda *a: told.extend(a[:2]) or (None, []))
    k = F.col("id").cast("double")
    costmodel.train_frame(spark.range(n).select(F.array(F.lit(2.5).cast("double"), k).alias("features"), (-k).alias("throughput_log"), (k % 7).alias("size_log")))
    seen = [np.concatenate([np.column_stack(b) for b in part.blocks()]) for part in told]
    assert 0.79 * n < len(told[0]) < 0.81 * n
    rows = np.concatenate(seen)
    rows = rows[np.argsort(rows[:, 1])]
    ids = np.arange(n, dtype=float)
    assert np.array_equal(rows, np.column_stack([np.full(n, 2.5), ids, -ids, ids % 7]))


def test_network_learns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    y = np.stack([x[:, 0] - x[:, 1], x[:, 2]], 1)
    net, losses = costmodel.train(x[:500], y[:500], (x[500:], y[500:]), (6, 32, 2), epochs=30)
    assert losses[-1] < 0.2 * losses[0]
    df = spark.createDataFrame([(i, "c", list(map(float, r))) for i, r in enumerate(x[500:])], "qid long, config string, features array<double>")
    got = {r.qid: r.throughput_log for r in costmodel.predict(df, net).collect()}
    assert np.allclose([got[i] for i in range(100)], net.predict(x[500:])[:, 0])


def test_features_have_57_places(spark):
    from kairoframe.queries import QUERIES

    assert {r["size"] for r in QUERIES["lcm_features"](spark, "/root/testdata/sf0.001").select("size").collect()} == {57}


def test_generators(spark):
    o = generate.objects(spark, 300, 1000, 50)
    rows = o.collect()
    assert all(0 <= r.t_start <= r.t_end <= 1000 and len(set(r.elements)) == len(r.elements) > 0 and max(r.elements) < 50 for r in rows)
    assert rows[0].t_start == 0 and 49 in rows[0].elements
    p = explode_objects(o)
    elems = generate.queries_from_objects(p, 10, 5)
    assert set(r.qid for r in query.core(p, elems).where("qid = rec_id").collect()) == set(range(0, 300, 10))
    mixed = generate.until_selected(lambda i: generate.queries_from_objects(p.where(f"rec_id % 3 = {i % 3}"), 1, 5), lambda e: query.core(p, e), 300, 0.0, 0.01, 20)
    assert mixed.select("qid").distinct().count() == 20
    assert generate.allocate(7, [1, 1, 1]) == [3, 2, 2]
    found = generate.random_stats({"card": 5.0}, {"card": 6.0}, 1)
    assert 4.5 <= found["card"] <= 6.6
    like = {"card": 40, "domain": 500, "dict": 30, "extents": [(0, 5, 2.0, 1.0), (6, 90, 4.0, 2.0)]}
    assert all(r.t_end <= 500 and r.elements for r in generate.objects_like(spark, like).collect())
    assert generate.shuffled(elems).select("qid").distinct().count() == 30


def test_every_named_workload(spark):
    p = explode_objects(generate.objects(spark, 400, 20_000, 60, 5))
    frequency = {r.elem_id: r.freq * 100 / 400 for r in stats.element_frequency(p).collect()}
    answered = lambda e: query.core(p, e)
    sizes = {}
    for name, pattern in generate.WORKLOADS.items():
        rows = generate.named_workload(p, name, 1, answered).collect()
        sizes[name] = len(rows)
        for qid in {r.qid for r in rows}:
            own = [r for r in rows if r.qid == qid]
            assert len(own) == own[0].n == len({r.elem_id for r in own}) and own[0].n in pattern["cnt"]
            assert all(any(a < frequency[r.elem_id] <= z for a, z in pattern["freqs"]) for r in own)
            assert own[0].q_start <= own[0].q_end
    assert sizes["BASE"] and sizes["RND"] and sizes["FEW"] and sizes["NORESULTS"] and sizes["BROAD"]
    base = generate.named_workload(p, "BASE+LONG", 1, total=30)
    assert {r.workload: r["count"] for r in base.select("workload", "qid").distinct().groupBy("workload").count().collect()} == {"BASE": 15, "LONG": 15}
    hits = answered(base.drop("workload")).where("qid = rec_id").count()
    assert hits == 30  # the object that a query comes from is a result of it


def test_throughput(spark):
    t = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0)], "qid long, seconds double")
    assert tuple(stats.throughput(t).first()) == (0.5, 2.0)


def test_append_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "rec_id long, t_start long, t_end long, elements array<bigint>"
    for i in range(2):
        spark.createDataFrame([(i, 10 * i, 10 * i + 9, [1, 2])], kind).write.mode("append").parquet(source)
        append.append_stream(spark, source, target, str(tmp_path / "cp"), [(0, 4), (5, 20)]).awaitTermination()
    rows = append.read_appended(spark, target)
    assert rows.select("rec_id", "elem_id").distinct().count() == 4
    assert rows.where("band = 0").select("rec_id").distinct().count() == 1


def test_orders_by_ranges(spark):
    """Running sums, minima, next rows and ranks by ranges equal those of one task."""
    rng = random.Random(8)
    p = explode_objects(generate.objects(spark, 700, 5000, 60, 4))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(stats.extent_bins(p), stats.extent_bins(p, one_task=1))
    points = spark.createDataFrame([(rng.random(), rng.random() + 0.1) for _ in range(900)], "x double, y double")
    assert same(skyline.skyline(points, "x", "y"), skyline.skyline(points, "x", "y", one_task=1))
    elems = generate.queries_from_objects(p, 3, 40)
    assert same(generate.shuffled(elems), generate.shuffled(elems, one_task=1))
    answer = lambda e: query.core(p, e)
    assert same(generate.without_results(elems, answer), generate.without_results(elems, answer, one_task=1))


def test_every_template_has_sane_instances_that_answer(spark):
    """Also those that have no encoding: random parameters, built and asked."""
    from kairoframe.plans.engine import answer

    p = explode_objects(generate.objects(spark, 60, 300, 20, 3))
    elems = generate.queries_from_objects(p, 10, 30)
    want = sorted(map(tuple, query.core(p, elems).collect()))
    for name in ("split-temporal_tif+basic_irhint_tif+slicing", "slice-temporal_irhint_tif+hint", "refine-elemfreq_tif+basic_tif+hint_irhint", "pure_tif+sharding"):
        config = schema.serialize(schema.instantiate(schema.TEMPLATES["obsolete"][name], 5))
        assert sorted(map(tuple, answer(p, elems, config).collect())) == want, config
    for group in schema.TEMPLATES.values():
        for template in group.values():
            assert schema.sane(schema.instantiate(template, 3))
