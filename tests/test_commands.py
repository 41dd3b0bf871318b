"""Configuration files, commands over files, and the search for a configuration."""

import json

import numpy as np
import pytest

from kairoframe import __main__ as cli
from kairoframe.sources import files
from kairoframe.operators import costmodel, generate, query
from kairoframe.operators.postings import explode_objects
from kairoframe.plans import config, synthesis


def test_configuration_files(tmp_path):
    (tmp_path / "a.json").write_text('{\n# first\n"x": {"y": 1, "z": 2},\n#include "b.json"\n"stages": {"s": {"x": {"z": 3}}, "t": {"w": 4},},\n}')
    (tmp_path / "b.json").write_text('{"included": [1, 2,],\n}')
    assert config.load(str(tmp_path / "a.json")) == {"x": {"y": 1, "z": 2}, "included": [1, 2]}
    assert config.load(str(tmp_path / "a.json"), "s,t")["x"] == {"y": 1, "z": 3}
    with pytest.raises(ValueError, match="stage"):
        config.load(str(tmp_path / "a.json"), "none")
    (tmp_path / "c.json").write_text('{\n#include "c.json"\n}')
    with pytest.raises(ValueError, match="includes itself"):
        config.load(str(tmp_path / "c.json"))


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "o.dat").write_text("0 5 3,1\n2 9 1\n7 9 3,1\n")
    (tmp_path / "q.qry").write_text("4 6 1\n8 8 3,1\n")
    (tmp_path / "ids.dat").write_text("1\n")
    path = lambda x: str(tmp_path / x)
    lines = lambda: [x.split("\t")[:3] for x in capsys.readouterr().out.splitlines()]
    for method in ("tif;basic", "irhint;perf;4"):
        cli.run(["query", json.dumps({"method": method}), path("o.dat"), path("q.qry")])
        assert lines() == [["q", "3", str(0 ^ 1 ^ 2)]]
    for command in ("delete", "softdelete"):
        cli.run([command, '{"method":"tif;basic"}', path("o.dat"), path("ids.dat"), path("q.qry")])
        assert lines() == [["q", "2", str(0 ^ 2)]]
    cli.run(["update", '{"method":"tif;basic"}', path("o.dat"), path("o.dat"), path("q.qry")])
    assert lines()[0][1] == "6"
    cli.run(["analyze", path("o.dat"), path("q.qry")])
    assert json.loads(capsys.readouterr().out.splitlines()[0])["card"] == 3
    cli.run(["generate-O", "30", "100", "9", path("made")])
    cli.run(["generate-Q", "BASE+BROAD", "1", path("made"), path("asked")])
    assert spark.read.parquet(path("asked")).count() > 0
    (tmp_path / "flow.json").write_text(json.dumps({"flows": {"f": {"repeat": 2, "steps": ["help"]}}}))
    capsys.readouterr()
    cli.run(["sequence", path("flow.json"), "f"])
    assert capsys.readouterr().out.count("Commands over files") == 2
    with pytest.raises(SystemExit):
        cli.run(["nonsense"])


def test_synthesis(spark, tmp_path):
    p = explode_objects(generate.objects(spark, 200, 5000, 40, 4))
    elems = generate.queries_from_objects(p, 20, 50)
    net = costmodel.Network.fresh()
    found = synthesis.synthesize(spark, p, elems, net, ["pure", "dict2"], ((2, 3), (2, 2)))
    rows = found.collect()
    assert rows and all(a.cost <= b.cost and a.size >= b.size for a, b in zip(rows, rows[1:], strict=False))
    for text, seconds in synthesis.suggestions(found):
        assert seconds > 0 and synthesis.verified(p, elems, text), text
    net.save(str(tmp_path / "model-1.npz"))
    again = costmodel.Network.newest(str(tmp_path))
    x = np.ones((2, 57))
    assert np.allclose(net.predict(x), again.predict(x))
    configs = spark.createDataFrame([(t, list(map(float, r.encoding))) for r, t in [(rows[0], "a")]], "config string, encoding array<double>")
    measured = spark.createDataFrame([("a", 0.01, 1000)], "config string, seconds double, bytes long")
    assert synthesis.training_rows(p, elems, configs, measured).count() == elems.select("qid").distinct().count()
    assert query.core(p, synthesis.sampled(elems, 3)).select("qid").distinct().count() == 3


def test_measured_runs_and_the_model(spark, tmp_path, capsys):
    path = lambda x: str(tmp_path / x)
    cli.run(["generate-OQ", "60", "200", "9", "BASE", "2", path("made")])
    assert spark.read.parquet(path("made/queries")).count() > 0
    (tmp_path / "q.qry").write_text("4 60 1\n8 80 2,1\n100 190 0,1\n")
    configs = ['{"method":"tif;basic"}', '{"method":"irhint;perf;4"}', '{"method":"tif;slicing;a;dyn;0.5;0.5"}', '{"refine":"elemfreq","fanout":[{"range":"0.5-1","method":"tif;basic"},{"range":"0-0.5","method":"irhint;perf;3"}]}']
    (tmp_path / "c.txt").write_text("\n".join(configs[:3]))
    cli.run(["measure", path("made/objects"), path("q.qry"), path("c.txt"), path("scores")])
    (tmp_path / "c.txt").write_text("\n".join(configs))
    cli.run(["measure", path("made/objects"), path("q.qry"), path("c.txt"), path("scores")])
    rows = files.read_scores(spark, path("scores")).collect()
    assert sorted(r.schema for r in rows) == sorted(configs) and len({r.xor_result for r in rows}) == 1
    cli.run(["learn", path("made/objects"), path("q.qry"), path("scores"), path("model.npz")])
    capsys.readouterr()
    cli.run(["predict", path("made/objects"), path("q.qry"), path("c.txt"), path("model.npz")])
    cli.run(["accuracy", path("made/objects"), path("q.qry"), path("scores"), path("model.npz")])
    out = capsys.readouterr().out
    assert all(out.count(c) == 2 for c in configs) and "mae_log" in out
    cli.run(["generate-O-stats", '{"card": 10, "dict": 5}', '{"card": 20, "dict": 5}', "3"])
    made = json.loads(capsys.readouterr().out)
    assert 9 <= made["card"] <= 22 and 4.5 <= made["dict"] <= 5.5
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2.0\n2\t3.0\n")
    cli.run(["convert", path("t.tsv"), path("parquet"), "a long, b double"])
    assert sum(spark.read.parquet(path(f"parquet/{x}")).count() for x in ("train", "val", "test")) == 2


def test_a_configuration_for_each_band(spark):
    p = explode_objects(generate.objects(spark, 200, 5000, 40, 4))
    elems = generate.queries_from_objects(p, 20, 50)
    config = synthesis.synthesize_bands(spark, p, elems, costmodel.Network.fresh(), [(0, 1500), (1501, 2500), (2501, 5000)], ["pure"], ((2, 2),))
    assert [s["band_range"] for s in json.loads(config)] == ["0-0.3", "0.3-0.5", "0.5-1"]
    assert synthesis.verified(p, elems, config)
