import pytest
from pyspark.sql import functions as F

from testquarry.functions import semantics as M


def one(spark, column, **data):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in data.items())
    return spark.createDataFrame([tuple(data.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("matcher, oracle, text, want", [
    ("toBeVisible", "generic_assertion", "", ("element_presence", "ast_assertion_matcher")),
    ("toHaveCount", "generic_assertion", "", ("collection_size", "ast_assertion_matcher")),
    ("contain", "text_content_oracle", "cy.url()", ("navigation_outcome", "lexical_fallback")),
    ("contain", "text_content_oracle", "x", ("content_correctness", "ast_assertion_matcher")),
    ("eq", "generic_assertion", "response.status", ("network_contract", "lexical_fallback")),
    ("", "element_state_oracle", "x", ("interactive_state", "lexical_oracle_category_fallback")),
    (None, None, None, ("unspecified", "lexical_oracle_category_fallback")),
])
def test_verification_intent(spark, matcher, oracle, text, want):
    assert tuple(one(spark, M.verification_intent(F.col("m"), F.col("o"), F.col("t")), m=matcher, o=oracle, t=text)) == want


@pytest.mark.parametrize("value, field, visibility, source, channel, want", [
    ("'{enter}'", "", "visible", "literal_input", "", "technical_or_control_input"), ("x", "", "opaque", "variable_input", "", "not_observable"),
    ("'hello'", "", "visible", "literal_input", "", "placeholder_or_dummy_input"), ("'invalid mail'", "email", "visible", "literal_input", "", "validation_or_edge_case_input"),
    ("'Ada Lovelace'", "name", "visible", "literal_input", "", "domain_plausible_input"), ("'7'", "", "visible", "literal_input", "", "unclear"),
])
def test_input_plausibility(spark, value, field, visibility, source, channel, want):
    c = M.input_plausibility(*(F.col(x) for x in "vfu"), F.col("s"), F.col("c"))
    assert one(spark, c, v=value, f=field, u=visibility, s=source, c=channel) == want


@pytest.mark.parametrize("raw, children, want", [
    ("page.goto('/')", [], "navigation_bootstrap"), ("page.goto('/login')", [], "auth_session_state"), ("prepare()", ["network_mock_or_spy"], "network_mock_or_spy"),
    ("prepare()", ["network_mock_or_spy", "auth_session_state"], "generic_setup_teardown_utility"), ("cy.wait(5)", [], "generic_setup_teardown_utility"), ("db.seed()", [], "test_data_or_backend_state"), ("x()", [], "unclear"),
])
def test_setup_intent(spark, raw, children, want):
    assert one(spark, M.setup_intent(F.lit(""), F.col("r"), F.col("c")), r=raw, c=children) == want


def test_phase_scope_and_review(spark):
    assert one(spark, M.setup_phase(F.col("s"), F.lit(""), F.lit("")), s="beforeEach") == "setup" and one(spark, M.setup_phase(F.col("s"), F.lit(""), F.lit("")), s="afterAll") == "teardown"
    assert one(spark, M.setup_scope(F.col("s"), F.lit(False), F.lit(0)), s="beforeAll") == "suite_or_fixture"
    reasons = M.review_reasons(F.col("i"), F.col("c"), F.col("r"), F.col("k"))
    assert one(spark, reasons, i="unclear", c="low", r=False, k=["a", "b"]) == ["helper_body_unavailable", "mixed_intents", "low_confidence"]
