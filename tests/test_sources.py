import json

from pyspark.sql import functions as F

from testquarry.plans import aggregation
from testquarry.sources import readers, writers
from testquarry.streaming import features as stream


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_json_lines(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", ['{"a": 1}', "", "nonsense", '{"a": 2}'])
    assert readers.read_jsonl(spark, p, "a int", strict=False).count() == 2
    good, report = readers.read_jsonl_reported(spark, p, "a int")
    assert good.count() == 2 and report.first() == (3, 1)
    assert [r.a for r in readers.read_jsonl_where(spark, p, "a int", ['"a": 2']).collect()] == [2]


def test_order_of_lines_is_kept(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", [json.dumps({"a": i}) for i in range(50)])
    assert [r.a for r in readers.read_ordered(spark, p, "a int").repartition(5).orderBy("seq").collect()] == list(range(50))


def test_csv_with_mark_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿repo,x\nr,\"a \"\"b\"\"\nc\"\n".encode())
    df = readers.read_any(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["repo", "x"] and df.first().x == 'a "b"\nc'


def test_sidecars_and_fallback(spark, tmp_path):
    write(tmp_path / "r1.features.jsonl", ['{"repo": "r1", "n": 1}'])
    side = readers.read_sidecars(spark, str(tmp_path), ".features.jsonl", "repo string, n int").drop("sidecar")
    root = spark.createDataFrame([("r1", 9), ("r2", 2)], "repo string, n int")
    assert sorted(map(tuple, readers.with_fallback(side, root).collect())) == [("r1", 1), ("r2", 2)]
    assert readers.first_source(spark, [str(tmp_path / "no*"), str(tmp_path / "r1*")]).endswith("r1*")


def test_static_metrics_last_row_and_report(spark):
    df = spark.createDataFrame([("r", "t", 1, 0), ("r", " t", 2, 1), ("", "x", 3, 2)], "repo string, test_id string, n int, seq int")
    rows, report = readers.load_static_metrics(df, "seq")
    assert [r.n for r in rows.collect()] == [2] and report.first() == (3, 1, 1)


def test_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/a.spec.ts").write_text("x")
    (tmp_path / "a.spec.ts").write_text("it('x')")
    (tmp_path / "b.ts").write_text("y")
    files = readers.read_tree(spark, str(tmp_path))
    assert files.count() == 2 and files.where(readers.is_test_file(F.col("path"))).count() == 1
    hashed = [readers.tree_hash(files.withColumn("k", F.lit(1)).repartition(n), "k").first().tree_hash for n in (1, 3)]
    assert hashed[0] == hashed[1]


def test_last_result(spark):
    lines = ['{"cost": 1.0}', '{"turns": 4}', '{"other": 1}', "bad"]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(lines)], "k string, i int, value string")
    r = readers.last_result(df, ["k"], "i").first()
    assert (r.cost, r.turns, r.invalid) == (None, 4, 1)


def test_csv_sink_has_a_header_without_rows(spark, tmp_path):
    df = spark.createDataFrame([], "a string, m map<string,int>")
    writers.write_csv(df, str(tmp_path / "out"), ["a", "m", "missing"])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.strip() == "a,m,missing"


def test_bundle_and_decisions(spark, tmp_path):
    df = spark.createDataFrame([("m", "1", "h1"), ("m", "1", "h2")], "model string, prompt_version string, input_hash string")
    assert writers.write_bundle({"x": df}, str(tmp_path / "b"), "t") == {"title": "t", "tables": {"x": 2}}
    cached = spark.createDataFrame([("m", "1", "h1", "l")], "model string, prompt_version string, input_hash string, label string")
    hits, misses = writers.look_up_decisions(df, cached)
    assert hits.first().label == "l" and [r.input_hash for r in misses.collect()] == ["h2"]
    got = writers.decide(misses, lambda rows: [{"input_hash": r["input_hash"], "label": "new"} for r in rows], "input_hash string, label string")
    assert got.first().label == "new"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "a.json", [json.dumps({"k": k, "ts": f"2024-01-01T00:0{i}:00"}) for i, k in enumerate("aab")])
    events = stream.read_stream(spark, str(src), "k string, ts timestamp")
    seen = []
    q = stream.run_batches(stream.dedupe_stream(events, ["k"], "ts"), lambda df, _: seen.extend(r.k for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(seen) == ["a", "b"]
    assert stream.windowed_counts(events, "ts", ["k"]).isStreaming and stream.session_counts(events, "ts", ["k"]).isStreaming


def test_aggregation_end_to_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "test_cases.jsonl", [json.dumps({"repo": "r", "test_id": t, "describe_path": [], "hook_instance_keys": []}) for t in ("t", "quiet")])
    act = {"repo": "r", "test_id": "t", "feature_type": "ui_action", "source_kind": "test_body", "name": "page.click", "raw_code": "page.click('a')"}
    rows = [dict(act, line=str(i)) for i in (1, 2, 3)] + [dict(act, line="3")]
    rows += [dict(act, feature_type="assertion", name="expect", raw_code="expect(a).toBeVisible()", line="4", assertion_chain_root_id="c", assertion_chain_length=1), dict(act, test_id="orphan", line="1")]
    write(src / "features_direct.jsonl", map(json.dumps, rows))
    write(src / "test_case_static_metrics.jsonl", [json.dumps({"repo": "r", "test_id": "t", "metrics_status": "ok", "test_body_ncloc": 4, "test_body_statement_count": 2})])
    out = aggregation.run(spark, str(src), str(tmp_path / "out"))
    m = {r.test_id: r for r in out["interaction_by_test"].collect()}
    assert (m["t"].ui_actions, m["t"].all_max_run, m["t"].all_repeat_fraction) == (3, 3, 1.0)
    assert m["quiet"].ui_actions is None and m["quiet"].all_repeat_fraction is None
    a = {r.test_id: r for r in out["assertion_by_test"].collect()}
    assert (a["t"].placement, a["t"].assertion_density_per_ncloc, a["quiet"].assertions, a["quiet"].sm_joined) == ("end_only", 0.25, 0, False)
    assert out["assertion_events"].first().oracle == "visibility_oracle"
    assert "repo_weighted" in out and json.loads("".join(p.read_text() for p in (tmp_path / "out/summary").glob("part-*")))["tests"] == 2
