"""The registered queries against their SQL, and the pipeline against its stages' rules."""

import collections

import pytest

from compare import check, connect
from kairoframe.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, tables, name):
    check(QUERIES[name](spark, SF), tables, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, name):
    got = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.select("doc_id").distinct().count() == n


def test_pipeline(spark):
    from cases import docs
    from test_dedup import brute_components, norm, shingles

    import corpus_pipeline as pipe

    start = docs(spark)
    now, seen = start, {}
    for name, stage in pipe.STAGES[:-1]:
        before = now
        now = stage(spark, before, SF)
        assert now.columns == start.columns and now.dtypes == start.dtypes
        now = spark.createDataFrame(now.collect(), start.schema)
        seen[name] = [r.asDict() for r in now.collect()]
    texts = lambda name: collections.Counter(r["text"] for r in seen[name])
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in seen["language_id"])
    assert {norm(t) for t in texts("exact_dedup")} == {norm(t) for t in texts("language_id")}
    ids = {r["doc_id"]: shingles(r["text"]) for r in seen["exact_dedup"] if r["doc_id"] is not None}
    assert len(seen["near_dedup"]) <= len({*brute_components(ids).values()}) + 3
    assert "hunter" not in str(texts("secret_scan")) and "abcdef1234" not in str(texts("secret_scan"))
    assert len(seen["secret_scan"]) == len(seen["near_dedup"])
    out = pipe.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in out.collect()} == {r["doc_id"] for r in seen["secret_scan"]}


def test_pipeline_drops_rows_and_not_ids(spark):
    import corpus_pipeline as pipe

    a, u = "".join(f"a{i} " for i in range(60)), "".join(f"u{i} " for i in range(60))
    rows = [(3, a), (7, a + "end"), (7, u), (8, u + "x y"), (5, "twice"), (5, "twice"), (None, "lost"), (None, "lost"), (6, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    exact = pipe.exact_dedup(spark, docs, SF)
    want = [(3, a), (7, a + "end"), (7, u), (8, u + "x y"), (5, "twice"), (None, "lost"), (2, "")]
    assert sorted(map(tuple, exact.collect()), key=repr) == sorted(want, key=repr)
    near = pipe.near_duplicates(spark, spark.createDataFrame(exact.collect(), docs.schema), SF)
    assert sorted(map(tuple, near.collect()), key=repr) == sorted(((i, t) for i, t in want if t not in (a + "end", u + "x y")), key=repr)


def test_pipeline_runs(spark):
    import corpus_pipeline as pipe

    got = pipe.run(spark, SF)
    assert got.where("length < 1 or length > 1024").count() == 0 and got.count() > 0
