"""From feature rows to event tables, by-test summaries and corpus summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classifiers as C
from ..functions import scalars as S
from ..functions import semantics as M
from ..functions.parsers import navigation_target
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import sequences as Q
from ..operators.dedupe import dedupe_edges
from ..operators.sets import unify_features
from ..sources import readers, schemas, writers

KEYS = ["repo", "test_id"]


def typed_features(features: DataFrame) -> DataFrame:
    """Trimmed ids, numeric lines (0 where missing) and the derived labels that all tables share."""
    ids = {c: S.strip(F.col(c)) for c in KEYS}
    rows = features.withColumns(ids | {"line": S.safe_int(F.col("line")), "helper_depth": F.coalesce("helper_depth", F.lit(0))})
    attached, depth, kind = F.col("attached_from_hook"), F.col("helper_depth"), F.col("source_kind")
    return rows.withColumns({
        "category": C.interaction_category(F.col("name"), F.col("raw_code"), F.col("ui_action_category"), F.col("terminal_action_ast")),
        "bucket": F.when(F.col("feature_type") == "assertion", C.assertion_bucket(kind, attached, depth)).otherwise(C.action_bucket(kind, attached, depth)),
        "in_body": C.is_test_body(kind, attached, depth),
    })


def event_tables(features: DataFrame) -> dict[str, DataFrame]:
    """Environment, input, locator, synchronisation, workflow, interaction and assertion events."""
    name, raw, t = F.col("name"), F.col("raw_code"), F.col("feature_type")
    base = [*KEYS, "seq", "line", "name", "source_kind", "bucket", "in_body", S.clip(raw, "event").alias("raw_code")]
    actions = features.where(t == "ui_action")
    strategy = C.preferred(F.col("locator_strategy_ast"), C.locator_strategy(name, raw, F.col("category")))
    target, oracle = navigation_target(raw), C.oracle_category(name, raw)
    setup, origin = C.setup_category(name, raw, F.col("source_kind"), t), C.input_source(F.col("input_source_ast"), name, raw)
    signature = S.json_signature(F.col("action_signature_json"), ["category", "action", "locator", "target", "value"], S.action_signature(F.col("category"), name))
    flow = ["control_flow_enclosure", "control_flow_branch_kind", "control_flow_loop_depth"]
    return {
        "environment_events": features.where(t.isin("setup", "teardown", "network_mock", "control") | C.is_hook(F.col("source_kind"))).select(*base, setup.alias("category"), M.setup_phase(F.col("source_kind"), name, raw).alias("phase"), M.setup_scope(F.col("source_kind"), F.col("attached_from_hook"), F.col("helper_depth")).alias("scope"), M.setup_intent(name, raw, category=setup).alias("primary_intent")),
        "input_events": features.where(t == "input").select(*base, origin.alias("input_source"), M.input_plausibility(F.col("value_summary"), name, F.when(F.col("value_summary").isNull(), "unknown").otherwise("visible"), origin, F.lit("")).alias("plausibility"), F.coalesce("linked_action_line", "line").alias("action_line")),
        "locator_events": actions.select(*base, strategy["value"].alias("strategy"), strategy["basis"].alias("basis"), C.locator_signal(strategy["value"]).alias("signal")).where("strategy is not null"),
        "sync_events": features.where(t == "wait_synchronization").select(*base, C.sync_pattern(name, raw, F.col("wait_subtype_ast")).alias("pattern")),
        "workflow_events": features.select(*base, C.workflow_abstraction(t, F.col("source_kind"), F.col("helper_depth"), F.col("resolved"), raw).alias("abstraction")).where("abstraction <> 'unclear'"),
        "interaction_events": actions.select(*base, "category", signature.alias("signature"), target["target"].alias("target"), target["basis"].alias("target_basis"), *flow),
        "assertion_events": features.where(t == "assertion").select(*base, oracle.alias("oracle"), M.verification_intent(F.col("assertion_matcher"), oracle, raw).getField("intent").alias("verification_intent"), "assertion_chain_root_id", "assertion_chain_length", "assertion_matcher", "is_soft_assertion", "is_grouped_assertion"),
    }


def by_test(spine: DataFrame, events: dict[str, DataFrame], static: DataFrame | None = None) -> dict[str, DataFrame]:
    """Summaries with a row for every test of the spine, those without events included."""
    tests, acts, asserts = spine.select(*KEYS), events["interaction_events"], events["assertion_events"]
    order = [Q.line_key(F.col("line")), "seq"]
    fixed = ~F.col("target_basis").isin("dynamic_template_literal", "http_method_literal")
    nav = acts.where("category = 'navigation'")
    interaction = (
        tests.join(acts.groupBy(*KEYS).agg(F.count("*").alias("ui_actions"), F.count_if("in_body").alias("body_ui_actions"), F.min("line").alias("first_line"), F.max("line").alias("last_line")), KEYS, "left")
        .join(Q.sequence_metrics(acts, KEYS, order, "signature"), KEYS, "left")
        .join(Q.revisits(nav, KEYS, "signature").withColumnsRenamed({"visits": "navigations", "revisits": "repeated_navigations"}), KEYS, "left")
        .join(Q.revisits(nav, KEYS, "target", fixed).select(*KEYS, F.col("revisits").alias("target_revisits")), KEYS, "left")
        .join(A.control_flow(acts, KEYS, True).drop("actions"), KEYS, "left")
    )
    b = F.col("bucket")
    counts = asserts.groupBy(*KEYS).agg(
        F.count("*").alias("assertions"), F.count_if("in_body").alias("body_assertions"), F.count_if(b == "direct").alias("direct_assertions"),
        F.count_if(b == "hook").alias("hook_assertions"), F.count_if(b == "helper").alias("helper_assertions"),
    )
    whole = tests.join(counts, KEYS, "left").join(interaction.select(*KEYS, "ui_actions", "body_ui_actions"), KEYS, "left").fillna(0)
    if static is not None:
        joined = J.left_join_flagged(whole, static, KEYS, "sm_", "metrics_status").withColumnsRenamed({"sm_test_body_ncloc": "ncloc", "sm_test_body_statement_count": "statements"})
    else:
        joined = whole.withColumns({"ncloc": F.lit(None).cast("int"), "statements": F.lit(None).cast("int")})
    both = acts.select(*KEYS, "line", F.lit("ui").alias("k")).unionByName(asserts.select(*KEYS, "line", F.lit("assertion").alias("k")))
    where = A.assertion_placement(both, KEYS, "line", F.col("k") == "ui", F.col("k") == "assertion")
    out = {
        "interaction_by_test": interaction,
        "assertion_by_test": A.densities(joined).join(where, KEYS, "left").join(A.assertion_chains(asserts, KEYS, matcher="assertion_matcher").drop("assertions"), KEYS, "left"),
    }
    for name, table, label in (("environment", "environment_events", "category"), ("input", "input_events", "input_source"), ("locator", "locator_events", "strategy"), ("sync", "sync_events", "pattern"), ("workflow", "workflow_events", "abstraction"), ("oracle", "assertion_events", "oracle"), ("intent", "assertion_events", "verification_intent"), ("setup_intent", "environment_events", "primary_intent"), ("plausibility", "input_events", "plausibility")):
        out[f"{name}_by_test"] = tests.join(A.histogram_map(events[table], KEYS, label), KEYS, "left")
    return out


def weighted_summaries(spine: DataFrame, events: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Shares of locator, synchronisation and workflow labels by event, test and repository."""
    out: dict[str, DataFrame | None] = {"event_weighted": None, "test_weighted": None, "repo_weighted": None}
    for table, label in (("locator_events", "strategy"), ("sync_events", "pattern"), ("workflow_events", "abstraction")):
        parts = {
            "event_weighted": A.event_weighted(events[table], label), "test_weighted": A.test_weighted(events[table], spine, KEYS, label),
            "repo_weighted": A.repo_weighted(events[table], spine, "repo", ["test_id"], label),
        }
        for k, df in parts.items():
            df = df.withColumn("dimension", F.lit(table.removesuffix("_events")))
            out[k] = df if out[k] is None else out[k].unionByName(df)
    return out


def corpus_summary(spine: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: tests, repositories, and the rows of every event table."""
    out = spine.agg(F.count("*").alias("tests"), F.count_distinct("repo").alias("repos"))
    for name, df in tables.items():
        out = out.withColumn(f"{name}_rows", F.lit(df.count()))
    return out


def run(spark: SparkSession, in_dir: str, out_dir: str, compat: bool = False) -> dict[str, DataFrame]:
    """Read the extraction's JSON lines, build all tables and write them below out_dir."""
    tests = readers.read_jsonl(spark, f"{in_dir}/test_cases.jsonl", schemas.TEST_CASES).withColumn("_n", F.monotonically_increasing_id())
    spine = readers.load_tests(tests, "_n").drop("_n")
    direct = readers.read_ordered(spark, f"{in_dir}/features_direct.jsonl", schemas.FEATURES, 0)
    has_expanded = readers.exists(spark, f"{in_dir}/features_expanded.jsonl")
    expanded = readers.read_ordered(spark, f"{in_dir}/features_expanded.jsonl", schemas.FEATURES, 1) if has_expanded else direct.limit(0)
    hooks = direct.where("coalesce(is_shared_hook_feature, false)")
    features = unify_features(direct, expanded, spine, hooks, compat)
    writers.write_by_repo(J.attach_to_spine(typed_features(features), spine, KEYS), f"{out_dir}/features")
    events = event_tables(spark.read.parquet(f"{out_dir}/features"))
    static = None
    if readers.exists(spark, f"{in_dir}/test_case_static_metrics.jsonl"):
        rows = readers.read_jsonl(spark, f"{in_dir}/test_case_static_metrics.jsonl", schemas.STATIC_METRICS).withColumn("_n", F.monotonically_increasing_id())
        static = readers.load_static_metrics(rows, "_n")[0].drop("_n")
    tables = events | by_test(spine, events, static) | weighted_summaries(spine, events)
    if readers.exists(spark, f"{in_dir}/helper_edges.jsonl"):
        tables["helper_edges"] = dedupe_edges(readers.read_jsonl(spark, f"{in_dir}/helper_edges.jsonl", schemas.HELPER_EDGES))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
    written = {name: spark.read.parquet(f"{out_dir}/{name}") for name in tables}
    writers.write_text(spark, writers.summary_json(corpus_summary(spine, {k: written[k] for k in events})), f"{out_dir}/summary")
    return written
