"""Every query of the engine against its oracle on the smallest tables, and the entry point."""

import math
import os

import duckdb
import pytest

from testquarry.functions.parsers import html_measures
from testquarry.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got == want


def test_html_metrics_by_brute_force(spark, duck):
    want = {i: html_measures(h) for i, h in duck.execute("SELECT page_id, html FROM pages").fetchall()}
    got = {r.page_id: {k: r[k] for k in ("tags", "links", "scripts", "max_depth")} for r in core.queries()["html_metrics"](spark, SF).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_classifier_queries_meet_every_rule(spark, duck):
    found = duck.execute(core.oracle_sql()["classify_text"]).df()
    assert found["interaction"].nunique() >= 13 and found["oracle"].nunique() >= 10
    assert duck.execute(core.oracle_sql()["classify_setup"]).df()["setup"].nunique() >= 11


def test_greedy_packing_is_not_a_deal_to_and_fro(spark):
    from testquarry.operators.selection import pack_bins

    rows = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1), ("d", 1), ("e", None)], "repo string, bytes long")
    got = {r.repo: r.bin for r in pack_bins(rows, "repo", "bytes", 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 1, "e": 1}
    assert pack_bins(rows.limit(0), "repo", "bytes", 2).count() == 0
