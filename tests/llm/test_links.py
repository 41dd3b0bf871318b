"""Targets of links relative to their page."""

import duckdb
from pyspark.sql import functions as F

from kairoframe.llm.url_filter import ORACLE, link_targets, url_filter


def test_relative_targets(spark):
    page = "http://a.com/x/y/p.html?q=1"
    cases = {
        "page2.html": "http://a.com/x/y/page2.html", "../z": "http://a.com/x/z", "../../../z": "http://a.com/z", "./": "http://a.com/x/y/", "..": "http://a.com/x/",
        "?id=3": "http://a.com/x/y/p.html?id=3", "b?u=../c": "http://a.com/x/y/b?u=../c", "/r": "http://a.com/r", "mailto:me": None, "#top": None, "": None,
    }
    rows = [(page, f'<link rel="canonical" href="{to}">') for to in cases] + [("http://a.com", '<link rel="canonical" href="b">')]
    got = [r[0] for r in spark.createDataFrame(rows, "url string, html string").coalesce(1).select(link_targets(F.col("url"), F.col("html"))).collect()]
    assert got == [[to] if to else [] for to in cases.values()] + [["http://a.com/b"]]


def test_alias_by_a_relative_target_is_blocked(spark):
    pages = [(1, "http://x.net/es/a/p", ""), (2, "http://x.net/q/r", '<link rel="canonical" href="../es/a/p">')]
    got = {r.page_id: (r.verdict, r.inherited) for r in url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: ("block", False), 2: ("block", True)}


def test_sql_on_linked_pages(spark):
    """The query's SQL against the operator on pages with aliases of every kind."""
    targets = ["page2.html", "../z", "../../../es/z", "./", "..", "?id=3", "b?u=../c", "/es/r", "mailto:me", "#top", "", "//m.net/fr/q", "http://n.net/es/k", "HTTP://Q.org/x#f"]
    rows = []
    for i, to in enumerate(targets):
        tag = f'<link rel="canonical" href="{to}">' if i % 2 else f'<meta http-equiv="refresh" content="0; url={to}">'
        rows.append((i, f"http://s{i}.org/x/y/p.html?q=1", f"<p>{tag}</p>"))
        rows.append((100 + i, f"http://t{i}.net/es/y/p.html", tag))
    rows += [(200, "http://q.org/x", ""), (201, "http://s1.org/x/z", '<link rel=canonical href="http://back.net/es/1">'), (202, "http://back.net/es/1", None), (203, None, "<link>"), (204, "no url", None)]
    rows += [(300, "http://www.example.com/en/", '<link rel="canonical" href="/en/b">'), (301, "http://example.com/en/c", '<link rel="canonical" href="http://www.example.com/en/b">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(ORACLE).df()
    got = url_filter(pages).drop("alias_class").toPandas()[list(want.columns)]
    norm = lambda df: sorted(tuple(None if x != x else x for x in r) for r in df.itertuples(index=False, name=None))
    assert norm(got) == norm(want) and got["inherited"].sum() > 3
