"""Finer labels of assertions, inputs and set-up code: codebook tables, first level.

These follow the documented codebooks: structured fields first, then text in context, then
the coarse category. Exceptions below that level belong into a decision table
(`sources.writers.look_up_decisions`), whose labels `classifiers.semantic_label` prefers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classifiers import AFTER_HOOKS, BEFORE_HOOKS, call_text, is_navigation
from .rules import Rule, first_match
from .scalars import blank, unblank

# fixed values: labels of the codebooks and the words that decide them

INTENT_OF_ORACLE = {
    "visibility_oracle": "element_presence", "text_content_oracle": "content_correctness", "url_navigation_oracle": "navigation_outcome",
    "element_state_oracle": "interactive_state", "count_or_length_oracle": "collection_size", "visual_snapshot_oracle": "visual_regression",
    "network_response_oracle": "network_contract", "accessibility_oracle": "accessibility_compliance", "api_state_oracle": "api_or_data_contract",
    "generic_assertion": "unspecified",
}

INTENT_OF_MATCHER = {
    "element_presence": ("tobevisible", "tobehidden", "toexist", "exist", "exists", "tobeinthedocument", "tobeattached"),
    "content_correctness": ("tohavetext", "tocontaintext", "tocontain", "contain", "contains", "include", "match", "tomatch", "tohavetitle"),
    "navigation_outcome": ("tohaveurl",),
    "collection_size": ("tohavelength", "tohavecount"),
    "interactive_state": ("tobeenabled", "tobedisabled", "tobechecked", "tobefocused", "tohavebeencalledtimes", "calledtimes"),
    "value_or_attribute_correctness": ("tohavevalue", "tohavevalues", "tohaveattribute", "tohaveid", "tohaveproperty"),
    "style_or_visual_state": ("tohavecss", "tohaveclass", "tohavestyle"),
    "visual_regression": ("tohavescreenshot", "tomatchsnapshot", "tomatchimagesnapshot"),
    "api_or_data_contract": ("tohavebeencalled", "tohavebeencalledwith", "tomatchobject"),
}

INTENT_IN_TEXT = [
    Rule("accessibility_compliance", has=("a11y", "accessib", "axe.")),
    Rule("network_contract", like=(r"\b(response|request|intercept|xhr|statuscode)\b",)),
    Rule("navigation_outcome", like=(r"\b(url|pathname|location\.(href|hash)|hash)\b",)),
    Rule("style_or_visual_state", like=(r"\b(css|color|opacity|classname|style)\b",)),
    Rule("content_correctness", like=(r"\b(innertext|textcontent|title|message)\b",)),
    Rule("collection_size", like=(r"\.(length|count)\b",)),
]

PLACEHOLDER = ("test", "hello", "hello world", "example", "sample", "foo", "bar", "baz", "asdf", "lorem", "dummy", "abc", "xxx")

INTENT_OF_SETUP = {
    "network_mock": "network_mock_or_spy", "browser_context_control": "browser_context_or_client_state", "time_control": "time_device_permission_emulation",
    "framework_fixture": "test_data_or_backend_state", "auth_session_setup": "auth_session_state", "api_seed_setup": "test_data_or_backend_state",
    "database_seed_setup": "test_data_or_backend_state", "browser_context_setup": "browser_context_or_client_state", "teardown_cleanup": "cleanup_restore_state",
    "hook_setup": "generic_setup_teardown_utility", "helper_setup": "generic_setup_teardown_utility", "unknown_setup": "unclear",
}

SETUP_INTENT = [
    Rule("auth_session_state", like=(r"\b(log ?in|login|sign ?in|auth\w*|session|token|password)\b",)),
    Rule("network_mock_or_spy", has=("intercept", "page.route", "mock", "stub", "spy")),
    Rule("time_device_permission_emulation", has=("cy.clock", ".clock(", "viewport", "geolocation", "permission", "timezone", "emulate")),
    Rule("server_or_external_environment", like=(r"\b(server|docker|webserver|startapp|listen)\b",)),
    Rule("cleanup_restore_state", has=("cleanup", "teardown", "clear", "reset", "restore", "remove", "delete")),
    Rule("browser_context_or_client_state", has=("cookie", "localstorage", "sessionstorage", "newcontext", "newpage")),
    Rule("test_data_or_backend_state", has=("seed", "fixture", "database", "db.", "cy.request", "create", "insert", "factory", "axios", "fetch(")),
]


def verification_intent(matcher: Column, oracle: Column, text: Column) -> Column:
    """struct(intent, basis): by the matcher, then the text around it, then the oracle category."""
    m = F.regexp_replace(F.lower(blank(matcher)), "^(not|deep|have|be|to)\\.|[^a-z]", "")
    by_matcher = F.lit(None).cast("string")
    for intent, names in INTENT_OF_MATCHER.items():
        by_matcher = F.when(m.isin(*names), intent).otherwise(by_matcher)
    low = F.lower(blank(text))
    by_text = first_match(INTENT_IN_TEXT, low)
    # a matcher that compares anything says less than what it is applied to
    vague = m.isin("contain", "contains", "include", "match", "tomatch", "tocontain")
    by_oracle = F.lit("unspecified")
    for o, intent in INTENT_OF_ORACLE.items():
        by_oracle = F.when(oracle == o, intent).otherwise(by_oracle)
    intent = F.coalesce(F.when(vague, by_text), by_matcher, by_text, by_oracle)
    basis = F.when(vague & by_text.isNotNull(), "lexical_fallback").when(by_matcher.isNotNull(), "ast_assertion_matcher").when(by_text.isNotNull(), "lexical_fallback").otherwise("lexical_oracle_category_fallback")
    return F.struct(intent.alias("intent"), basis.alias("basis"))


def input_plausibility(value: Column, field: Column, visibility: Column, source: Column, channel: Column) -> Column:
    """What a value looks like: first match over keys, hidden values, placeholders and edge cases."""
    v = F.lower(F.trim(F.regexp_replace(blank(value), r"^['\"`]|['\"`]$", "")))
    f, c = F.lower(blank(field)), F.lower(blank(channel))
    return (
        F.when(c.isin("keyboard_press", "key_press") | v.rlike(r"^\{?(enter|escape|tab|backspace|arrow\w+|control|shift|meta|alt)\b"), "technical_or_control_input")
        .when(blank(visibility).isin("opaque", "unknown") | blank(source).isin("environment_input"), "not_observable")
        .when(v.rlike(r"invalid|wrong|too long|<script|' or |\.repeat\(") | (v == "") & (f != ""), "validation_or_edge_case_input")
        .when(v.isin(*PLACEHOLDER) | v.rlike(r"^(test|foo|dummy|sample)[ _-]?\w{0,8}$|lorem ipsum|@(example|test)\."), "placeholder_or_dummy_input")
        .when(v.rlike(r"^(https?://|/|true$|false$|#|\.)") | f.rlike(r"selector|config|timeout|port"), "technical_or_control_input")
        .when((f != "") | v.rlike(r"^[\p{L}][\p{L} .'-]{2,}$|^[^@ ]+@[^@ ]+\.[a-z]+$"), "domain_plausible_input").otherwise("unclear")
    )


def plausibility_label(plausibility: Column, source: Column) -> Column:
    """The label of reports: uploads apart, what can't be told together."""
    return F.when(source == "file_upload_input", "file_or_media_input").when(plausibility.isin("unclear", "not_observable"), "not_assessable").otherwise(plausibility)


def setup_phase(source: Column, name: Column, raw: Column) -> Column:
    s, text = F.lower(blank(source)), call_text(name, raw)
    before, after = s.isin(*BEFORE_HOOKS) | text.rlike(r"\bbefore(each|all)?\b"), s.isin(*AFTER_HOOKS) | text.rlike(r"\bafter(each|all)?\b")
    return F.when(before & after, "setup_and_teardown").when(before, "setup").when(after | text.rlike("teardown|cleanup"), "teardown").when(s.isin("test_body", "playwright_fixture"), "setup").otherwise("unclear")


def setup_scope(source: Column, attached: Column, depth: Column) -> Column:
    s = F.lower(blank(source))
    return (
        F.when(s.isin("beforeall", "afterall", "before", "after"), "suite_or_fixture").when(s.isin("beforeeach", "aftereach") | F.coalesce(attached, F.lit(False)), "per_test_hook")
        .when(s.isin("playwright_fixture", "playwright_auto_fixture"), "suite_or_fixture").when((F.coalesce(depth, F.lit(0)) > 0) | s.isin("cypress_command", "imported_helper", "helper_function"), "helper_or_framework_extension")
        .when(s == "test_body", "inline_test_body").otherwise("unclear")
    )


def setup_intent(name: Column, raw: Column, children: Column | None = None, candidate: Column | None = None, category: Column | None = None) -> Column:
    """The primary intent of a set-up unit.

    An authentication text comes before a navigation, a navigation before what a wrapper's
    calls intend (`children`, an array: one intent counts, several are a utility), and
    that before the words of the call itself; the set-up category is the last hint.
    """
    text = call_text(name, raw)
    auth = text.rlike(SETUP_INTENT[0].like[0])
    nav = is_navigation(name, raw) if candidate is None else candidate
    inner = F.array_distinct(F.filter(children, lambda x: x != "unclear")) if children is not None else F.array().cast("array<string>")
    hint = F.lit(None).cast("string")
    for label, intent in INTENT_OF_SETUP.items() if category is not None else ():
        hint = F.when(category == label, intent).otherwise(hint)
    wait = text.rlike(r"^\s*\S*(wait|sleep|pause)\w*\b")
    return (
        F.when(auth & nav, "auth_session_state").when(nav, "navigation_bootstrap").when(F.size(inner) == 1, F.get(inner, 0)).when(F.size(inner) > 1, "generic_setup_teardown_utility")
        .when(wait, "generic_setup_teardown_utility").otherwise(F.coalesce(first_match(SETUP_INTENT, text), F.when(hint != "unclear", hint), F.when(text.rlike(r"setup|init|prepare|helper"), "generic_setup_teardown_utility"), F.lit("unclear")))
    )


def intent_confidence(structured: Column, intent: Column) -> Column:
    return F.when(unblank(structured).isNotNull(), "high").when(intent.isin("unclear", "generic_setup_teardown_utility"), "low").otherwise("medium")


def review_reasons(intent: Column, confidence: Column, resolved: Column, children: Column) -> Column:
    """Why a unit should be looked at; empty where nothing speaks for it."""
    return F.array_compact(F.array(
        F.when(intent == "generic_setup_teardown_utility", F.lit("generic_helper_name")), F.when(~F.coalesce(resolved, F.lit(True)), F.lit("helper_body_unavailable")),
        F.when(F.size(F.array_distinct(F.coalesce(children, F.array().cast("array<string>")))) > 1, F.lit("mixed_intents")), F.when(confidence == "low", F.lit("low_confidence")),
    ))
