import pytest
from pyspark.sql import functions as F

from testquarry.operators import sequences as Q

SCHEMA = "t string, line int, name string, idx int"


def metrics(spark, rows):
    df = spark.createDataFrame([("t", *r) for r in rows], SCHEMA)
    return Q.repeat_metrics(df, ["t"], [Q.line_key(F.col("line")), "idx"], "name").first()


def test_identical_events_are_one_run(spark):
    m = metrics(spark, [(1, "page.click", 0), (2, "page.click", 1), (3, "page.click", 2)])
    assert (m.max_run, m.repeat_fraction, m.top_signature) == (3, 1.0, "page.click")


def test_same_line_keeps_ingest_order(spark):
    m = metrics(spark, [(10, "z.click", 0), (10, "a.click", 1), (10, "z.click", 2)])
    assert (m.max_run, m.repeat_fraction, m.top_signature) == (1, 0.0, None)


def test_missing_lines_come_last(spark):
    df = spark.createDataFrame([("t", 5, "a", 0), ("t", None, "b", 1), ("t", 10, "b", 2)], SCHEMA)
    m = Q.repeat_metrics(df, ["t"], [Q.line_key(F.col("line")), "idx"], "name").first()
    assert (m.event_count, m.max_run) == (3, 2)


def test_first_longest_run_is_on_top(spark):
    m = metrics(spark, [(i, n, i) for i, n in enumerate("aabbcaa", 1)])
    assert (m.top_signature, m.max_run, m.repeated_count) == ("a", 2, 6)


def test_no_events_no_rows(spark):
    assert metrics(spark, []) is None


def test_runs_are_recomputed_per_scope(spark):
    rows = [("t", 1, "click", "a"), ("t", 2, "locator_query", "q"), ("t", 3, "click", "a"), ("t", 4, "unknown_action", "u"), ("t", 5, "click", "a")]
    df = spark.createDataFrame(rows, "t string, line int, category string, sig string")
    m = Q.sequence_metrics(df, ["t"], ["line"], "sig").first()
    assert (m.all_max_run, m.user_max_run, m.classified_max_run) == (1, 2, 3)


def test_revisits(spark):
    df = spark.createDataFrame([("t", "x"), ("t", "y"), ("t", "x"), ("t", None)], "t string, u string")
    assert Q.revisits(df, ["t"], "u").first()[1:] == (3, 1)


@pytest.mark.parametrize("kinds, want", [(["", ""], "v1"), (["{}", ""], "mixed"), (["{}", "{}"], "v2")])
def test_signature_version(spark, kinds, want):
    df = spark.createDataFrame([("t", k) for k in kinds], "t string, s string")
    assert Q.signature_version(df, ["t"], "s").first().signature_version == want


def test_up_to_first_keeps_the_stop_itself(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate("vvcvc")], "u int, i int, e string")
    assert [r.i for r in Q.up_to_first(df, ["u"], ["i"], F.col("e") == "c").orderBy("i").collect()] == [0, 1, 2]


UNIT = "t string, line int, name string, is_navigation boolean, is_setup boolean, hook_instance_key string, first_ui_line int, intent string"


@pytest.mark.parametrize("rows, want", [
    ([(3, "goto", True, False, "", 5, "navigation_bootstrap"), (4, "goto", True, False, "", 5, "navigation_bootstrap")], [True, False]),
    ([(1, "seed", False, True, "", 9, "data"), (3, "goto", True, False, "", 9, "navigation_bootstrap")], [False, False]),
    ([(1, "seed", False, True, "h", 9, "data"), (3, "goto", True, False, "h", 9, "navigation_bootstrap")], [False, True]),
    ([(3, "goto", True, False, "", 5, "auth"), (4, "goto", True, False, "", 5, "navigation_bootstrap")], [False, True]),
    ([(7, "goto", True, False, "", 5, "navigation_bootstrap")], [False]),
])
def test_navigation_bootstrap(spark, rows, want):
    df = spark.createDataFrame([("t", *r) for r in rows], UNIT)
    assert [r.accepted for r in Q.navigation_bootstrap(df, ["t"]).orderBy("line").collect()] == want


def test_tertiles_use_nearest_ranks(spark):
    df = spark.createDataFrame([(v,) for v in range(10)], "v int")
    assert [r.bin for r in Q.tertile_bins(df, "v").orderBy("v").collect()] == ["small"] * 4 + ["medium"] * 3 + ["large"] * 3


def test_top_sources(spark):
    df = spark.createDataFrame([("t", "b", 2), ("t", "a", 2), ("t", "c", 4)], "t string, s string, n int")
    top = Q.top_sources(df, ["t"], "s", "n", ["b", "a"]).first().top
    assert [(x.label, x.share) for x in top] == [("c", 0.5), ("b", 0.25)]
