from pyspark.sql import functions as F

from testquarry.operators import aggregates as A
from testquarry.operators import dedupe as D
from testquarry.operators import joins as J
from testquarry.operators import selection as P
from testquarry.operators import sets as U
from testquarry.sources.schemas import FEATURES


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def features(spark, items):
    """Feature rows from partial dictionaries, in order."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(FEATURES + ", seq int")
    return spark.createDataFrame([tuple({"repo": "r", "test_id": "t", "seq": i, **x}.get(f.name) for f in schema) for i, x in enumerate(items)], schema)


def test_feature_key_ignores_text_past_400(spark):
    df = features(spark, [{"name": "a", "raw_code": "x" * 400 + "1"}, {"name": "a", "raw_code": "x" * 400 + "2"}, {"name": "b", "raw_code": "x"}, {"test_id": " ", "name": "c"}])
    assert rows(D.dedupe_features(df), "name", "seq") == [("a", 0), ("b", 2)]


def test_keep_best_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("k", 2, 1), ("k", 3, 2), ("k", 3, 0)], "k string, rank int, seq int")
    assert rows(D.keep_best(df, ["k"], [F.col("rank")], ["seq"]), "rank", "seq") == [(3, 0)]


def test_edges_differ_by_unknown_resolution(spark):
    e = "repo string, test_id string, hook_instance_key string, `from` string, `to` string, target_file string, depth int, resolved boolean"
    df = spark.createDataFrame([("r", "t", "", "a", "b", "f", 1, x) for x in (True, True, None, False)], e)
    assert D.dedupe_edges(df).count() == 3


def test_left_join_keeps_blanks_and_last_duplicate(spark):
    left = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "repo string, test_id string")
    right = spark.createDataFrame([("r", "a", "ok", 1, 0), ("r", "a", "parse_error", 2, 1), ("r", "b", " OK ", 3, 2), ("r", "x", "ok", 4, 3)], "repo string, test_id string, status string, n int, seq int")
    out = J.left_join_flagged(left, right, ["repo", "test_id"], status="status", order="seq")
    assert rows(out, "test_id", "sm_joined", "sm_metrics_ok") == [("a", True, False), ("b", True, True), ("c", False, False)]
    assert J.join_coverage(left, right, ["repo", "test_id"]).first() == (2, 2, 1, 1)


def test_hooks_attach_within_their_file(spark):
    tests = spark.createDataFrame([("r", "f1", "t1", ["h"]), ("r", "f2", "t2", ["h", "h"])], "repo string, file_path string, test_id string, hook_instance_keys array<string>")
    hooks = features(spark, [{"test_id": "", "file_path": "f1", "hook_instance_key": "h", "name": "in f1"}, {"test_id": "", "file_path": "f2", "hook_instance_key": "h", "name": "in f2"}])
    assert rows(J.attach_hooks(tests, hooks), "test_id", "name") == [("t1", "in f1"), ("t2", "in f2")]
    assert J.attach_hooks(tests, hooks, compat=True).count() == 4


def test_hooks_in_scope_by_suite_path(spark):
    tests = spark.createDataFrame([("r", "f", "t", ["a", "b"])], "repo string, file_path string, test_id string, describe_path array<string>")
    hooks = spark.createDataFrame([("r", "f", k, p) for k, p in (("h0", []), ("h1", ["a"]), ("h2", ["b"]), ("h3", ["a", "b", "c"]))], "repo string, file_path string, hook_instance_key string, describe_path array<string>")
    assert [r[0] for r in rows(J.hooks_in_scope(tests, hooks), "hook_instance_key")] == ["h0", "h1"]


def test_latest_binding_takes_the_last_declaration_before(spark):
    uses = spark.createDataFrame([("f", 1), ("f", 5), ("f", 9)], "f string, line int")
    binds = spark.createDataFrame([("f", 2, "a"), ("f", 5, "b")], "f string, at int, v string")
    got = {r.line: r.v for r in J.latest_binding(uses, binds, ["f"], "line", "at", "v").collect()}
    assert got == {1: None, 5: "b", 9: "b"}


def test_fallback_only_to_a_unique_name(spark):
    left = spark.createDataFrame([(1, "x", "f"), (9, "x", "f"), (9, "y", "f")], "line int, name string, t string")
    right = spark.createDataFrame([(1, "x", "f", "i1"), (2, "y", "f", "i2"), (3, "x", "f", "i3")], "line int, name string, t string, intent string")
    got = J.match_with_fallback(left, right, ["line", "name", "t"], "name", "intent", ["t"])
    assert {(r.line, r.name): r.intent for r in got.collect()} == {(1, "x"): "i1", (9, "x"): None, (9, "y"): "i2"}


def test_calls_expand_two_hops_without_cycles(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "caller string, callee string")
    defs = spark.createDataFrame([(x, x) for x in "abcd"], "node string, file string")
    got = J.expand_calls(calls, defs).where("root = 'a'")
    assert rows(got, "node", "depth") == [("b", 1), ("c", 2)]
    assert J.expand_calls(calls, defs, max_files=1).where("root = 'a'").count() == 1


def test_either_key_joins_once(spark):
    a = spark.createDataFrame([(1, "n1", "k1"), (2, "n9", "k2")], "id int, name string, cache string")
    b = spark.createDataFrame([("n1", "k1", "x", 0), ("n2", "k2", "y", 1)], "rn string, rc string, v string, o int")
    assert rows(J.join_either_key(a, ["name", "cache"], b, ["rn", "rc"], "id", ["o"]), "id", "v") == [(1, "x"), (2, "y")]


def weighted(spark):
    spine = spark.createDataFrame([("r1", "t1"), ("r1", "t2"), ("r2", "t3")], "repo string, test_id string")
    events = spark.createDataFrame([("r1", "t1", "css"), ("r1", "t1", "css"), ("r1", "t1", ""), ("r2", "t3", "role")], "repo string, test_id string, s string")
    return spine, events


def test_three_weightings(spark):
    spine, events = weighted(spark)
    assert rows(A.event_weighted(events, "s"), "label", "share") == [("css", 0.5), ("role", 0.25)]
    assert rows(A.test_weighted(events, spine, ["repo", "test_id"], "s"), "label", "tests") == [("css", 1), ("role", 1)]
    assert rows(A.repo_weighted(events, spine, "repo", ["test_id"], "s"), "label", "mean_share", "repos_with_label", "repo_count") == [("css", 0.25, 1, 2), ("role", 0.5, 1, 2)]


def test_percentiles_round_half_to_even(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    assert A.nearest_rank_percentiles(df, [], "v", (50,)).first().p50 == 3  # rank 1.5 goes to 2
    assert A.upper_median(df, [], "v").first().median == 3
    assert A.true_median(df, [], "v").first().median == 2.5


def test_chains_by_root_maximum(spark):
    df = spark.createDataFrame([("t", "c1", 2, "true"), ("t", "c1", 3, "no"), ("t", "c2", 1, "1"), ("t", "", 0, None)], "t string, assertion_chain_root_id string, assertion_chain_length int, is_soft_assertion string")
    m = A.assertion_chains(df.withColumn("assertion_chain_root_id", F.nullif("assertion_chain_root_id", F.lit(""))), ["t"]).first()
    assert (m.assertions, m.missing, m.chained_matchers, m.soft, m.chains, m.chained_roots, m.max_chain_length, m.mean_chain_length) == (4, 1, 2, 2, 2, 1, 3, 2.0)


def test_placement(spark):
    cases = {"none": "uu", "assertions_only": "aa", "end_only": "ua", "start_only": "au", "interleaved": "uau"}
    data = [(k, i, c) for k, s in cases.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(data, "t string, i int, c string")
    got = A.assertion_placement(df, ["t"], "i", F.col("c") == "u", F.col("c") == "a")
    assert all(r.t == r.placement for r in got.collect())


def test_gates_compare_unrounded(spark):
    df = spark.createDataFrame([(i < 59999,) for i in range(100000)], "ok boolean")
    g = A.gates(df, F.lit(True), F.col("ok"), F.lit(False), F.lit(False)).first()
    assert g.link_rate == 0.6 and not g.link_pass and g.resolve_rate == 0.0


def test_maps_and_modes(spark):
    df = spark.createDataFrame([("k", "b", 0), ("k", "a", 1), ("k", "b", 2), ("k", "", 3)], "k string, l string, s int")
    assert A.histogram_map(df, ["k"], "l").first().counts == {"a": 1, "b": 2}
    assert A.primary_label(df, ["k"], "l", "s").first().l == "b"
    assert A.single_or_mixed(df, ["k"], "l").first().l == "mixed"


def test_densities_are_null_without_denominator(spark):
    df = spark.createDataFrame([(2, 0, 0, 0, 2, 0, 0, None, 4)], "assertions int, body_assertions int, direct_assertions int, hook_assertions int, helper_assertions int, ui_actions int, body_ui_actions int, ncloc int, statements int")
    d = A.densities(df).first()
    assert d.assertion_density_all_actions is None and d.assertion_density_per_ncloc is None and d.assertion_density_per_statement == 0.5
    assert d.only_helper_assertions and not d.no_assertions


def test_stability_needs_every_run(spark):
    df = spark.createDataFrame([("a", True, 2.0), ("a", True, 0.0), ("b", True, 1.0), ("b", None, 3.0)], "k string, ok boolean, d double")
    got = {r.k: (r.stable, r.median_duration) for r in A.stability(df, ["k"], "ok", "d").collect()}
    assert got == {"a": (True, 2.0), "b": (False, 2.0)}


def test_samples_are_deterministic_and_capped(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 5)
    a, b = (sorted(r.id for r in P.stratified_sample(df.repartition(n), ["s"], ["id"], 3).collect()) for n in (1, 7))
    assert a == b and len(a) == 15
    assert P.stratified_sample(df, ["s"], ["id"], 3, cap=7).count() == 7


def test_quota_backfills(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "g string, i int")
    q = spark.createDataFrame([("a", 1), ("b", 3)], "g string, quota int")
    assert rows(P.quota_selection(df, "g", q, ["i"], 4), "g", "i") == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_union_of_samples_keeps_first_origin(spark):
    a, b = spark.range(3), spark.range(2, 6)
    got = P.union_samples({"focused": a, "baseline": b}, ["id"], 5)
    assert rows(got, "id", "origin") == [(0, "focused"), (1, "focused"), (2, "focused"), (3, "baseline"), (4, "baseline")]


def test_unified_features_attach_hooks_only_where_missing(spark):
    direct = features(spark, [{"name": "d", "source_kind": "test_body", "raw_code": "x"}, {"name": "h", "source_kind": "before", "hook_instance_key": "k", "file_path": "f", "is_shared_hook_feature": True, "test_id": ""}])
    none = features(spark, [])
    tests = spark.createDataFrame([("r", "t", "f", ["k"])], "repo string, test_id string, file_path string, hook_instance_keys array<string>")
    hooks = direct.where("is_shared_hook_feature")
    assert rows(U.unify_features(direct, none, tests, hooks), "name") == [("d",), ("h",)]
    done = features(spark, [{"name": "e", "attached_from_hook": True}])
    assert rows(U.unify_features(direct, done, tests, hooks), "name") == [("d",), ("e",)]
