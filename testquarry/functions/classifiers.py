"""Classifiers of UI-test events, each a table of ordered rules over lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Rule, first_match
from .scalars import blank, mismatch_tags, unblank

# fixed values: labels and the words that decide them, in order of precedence

SETUP = [
    Rule("network_mock", has=("intercept", "page.route"), equal={"type": ("network_mock",)}),
    Rule("browser_context_control", has=("viewport", "setcookie", "clearcookie"), equal={"type": ("browser_context_control",)}),
    Rule("time_control", has=("cy.clock", ".clock("), equal={"type": ("time_control",)}),
    Rule("framework_fixture", has=("fixture",), also=r"cy\.|fixture\("),
    Rule("teardown_cleanup", like=(r"\bafter(each|all)?\b",), equal={"source": ("after", "aftereach", "afterall")}),
    Rule("hook_setup", like=(r"\bbefore(each|all)?\b",), equal={"source": ("before", "beforeeach", "beforeall")}),
    Rule("api_seed_setup", has=("cy.request", "fetch(", "axios")),
    Rule("database_seed_setup", has=("database", "db.", "sequelize")),
    Rule("auth_session_setup", has=("login", "session", "auth")),
    Rule("browser_context_setup", has=("newcontext",), like=(r"\bbrowser\.url",)),
    Rule("teardown_cleanup", has=("teardown", "cleanup")),
    Rule("helper_setup", has=("helper",)),
    Rule("hook_setup", equal={"type": ("setup",)}),
    Rule("teardown_cleanup", equal={"type": ("teardown",)}),
]

NAVIGATION = r"\.goto\s*\(|\bcy\.visit\s*\(|\bnavigateto\s*\(|\bbrowser\.url\s*\("
NOT_NAVIGATION = r"\b(tohaveurl|waitforurl)\b"

INTERACTION = [
    Rule("navigation", like=(NAVIGATION,), but=NOT_NAVIGATION),
    Rule("locator_query", has=("getby", "locator", "cy.get", "selector(", "findby")),
    Rule("click", has=("click",)),
    Rule("text_input", has=("fill", "type", "setvalue", "typetext")),
    Rule("keyboard_input", has=("press", "keyboard")),
    Rule("selection", has=("select",)),
    Rule("hover", has=("hover",)),
    Rule("drag_drop", has=("drag",)),
    Rule("file_upload", has=("upload", "setinputfiles")),
    Rule("scroll", has=("scroll",)),
    Rule("wait_synchronization", has=("wait",)),
    Rule("visual_action", has=("screenshot",)),
]

ORACLE = [
    Rule("visibility_oracle", has=("tobevisible", "tobehidden", "tobenotvisible", "nottobevisible"), like=(r"\.exists\s*\.\s*(not\s*\.\s*)?(ok|notok|not\.ok)\b",)),
    Rule("element_state_oracle", has=("tohavevalue", "tobenull", "tobeundefined", "tobenan")),
    Rule("url_navigation_oracle", like=(r"\.href\b",), also=r"\b(to\.eq|to\.equal|\.eq\s*\(|should\s*\(\s*['\"]eq|expect\s*\([^)]*\.href)"),
    Rule("visibility_oracle", like=(r"\b(visible|hidden)\b",)),
    Rule("text_content_oracle", has=("tohavetext", "contain", "gettext")),
    Rule("url_navigation_oracle", has=("haveurl",), like=(r"\burl\b",)),
    Rule("element_state_oracle", has=("tohaveattribute", "disabled", "enabled")),
    Rule("count_or_length_oracle", has=("length", "count")),
    Rule("visual_snapshot_oracle", has=("snapshot", "screenshot")),
    Rule("accessibility_oracle", has=("accessibility", "a11y")),
    Rule("network_response_oracle", has=("response", "intercept")),
    Rule("api_state_oracle", has=("request",)),
]

INPUT = [
    Rule("fixture_file_input", has=("cy.fixture",), like=(r"\bfixture\s*\(\s*['\"]",)),
    Rule("environment_input", has=("process.env", "cypress.env")),
    Rule("network_mock_payload_input", has=("cy.intercept", "route(")),
    Rule("file_upload_input", has=("setinputfiles", "upload", "setfilestoupload")),
    Rule("parameterized_input", has=("each(", "parameterized")),
]
KNOWN_INPUT = (
    "literal_input", "variable_input", "generated_input", "fixture_file_input", "external_file_input",
    "environment_input", "file_upload_input", "parameterized_input", "variable_from_external_file", "unknown_input",
)

LOCATOR = [
    Rule("role", has=("getbyrole",)),
    Rule("testid", has=("getbytestid", "datacy")),
    Rule("text", has=("getbytext", "contains")),
    Rule("label", has=("getbylabel",)),
    Rule("placeholder", has=("getbyplaceholder",)),
    Rule("xpath", has=("xpath",)),
    Rule("playwright_locator", has=("locator(",)),
    Rule("testcafe_selector", has=("selector(",)),
    Rule("css", like=(r"\bcy\.get\s*\(", r"#[\w-]+")),
]
LOCATOR_CALLS = (
    "getbyrole", "getbytext", "getbylabel", "getbytestid", "getbyplaceholder", "getbyalt", "getbytitle",
    "cy.get", "cy.contains", "cy.find", "cy.xpath", "cy.datacy", "page.locator", "page.getby",
    "selector(", "findby", "findallby", "datacy", "locator(",
)

SYNC = [
    Rule("network_wait", like=(r"wait\s*\(\s*['\"`]@",)),
    Rule("fixed_delay", like=(r"\bwait(fortimeout)?\s*\(\s*\d+", r"\b(pause|sleep)\s*\(\s*\d*")),
    Rule("element_state_wait", has=("waitforselector", "waitforelement", "waitforexist", "waitfordisplayed", "waitforvisible")),
    Rule("navigation_or_load_wait", has=("waitforurl", "waitfornavigation", "waitforloadstate")),
    Rule("network_wait", has=("waitforresponse", "waitforrequest", "intercept", "networkidle")),
    Rule("event_wait", has=("waitforevent",)),
    Rule("predicate_wait", has=("waitforfunction", "waituntil", "topass")),
]

USER_ACTIONS = (
    "navigation", "click", "text_input", "keyboard_input", "selection", "hover", "drag_drop", "file_upload",
    "scroll", "wait_synchronization", "visual_action", "unknown_action",
)
UNCLASSIFIED_ACTIONS = ("wait_synchronization", "unknown_action")
BEFORE_HOOKS, AFTER_HOOKS = ("before", "beforeeach", "beforeall"), ("after", "aftereach", "afterall")
HELPER_SOURCES = (
    "imported_helper", "helper_function", "helper_oracle", "page_object_method", "playwright_fixture",
    "playwright_auto_fixture", "cypress_command",
)
BODY_SOURCES = ("test_body", "implicit_oracle", "")
ROBUST_SIGNALS = ("role", "testid", "label", "text", "placeholder")
COUPLED_SIGNALS = ("css", "xpath")


def call_text(name: Column, raw: Column) -> Column:
    """What rules read: the name and the source text, lower-cased."""
    return F.lower(F.concat_ws(" ", blank(name), blank(raw)))


def setup_category(name: Column, raw: Column, source: Column, kind: Column) -> Column:
    return first_match(SETUP, call_text(name, raw), {"source": F.lower(blank(source)), "type": F.lower(blank(kind))}, "unknown_setup")


def is_navigation(name: Column, raw: Column) -> Column:
    text = call_text(name, raw)
    return text.rlike(NAVIGATION) & ~text.rlike(NOT_NAVIGATION)


def interaction_category(name: Column, raw: Column, structured: Column | None = None, terminal: Column | None = None) -> Column:
    """The structured category if it says something, then that of the terminal action, then the rules'."""
    ruled = first_match(INTERACTION, call_text(name, raw), default="unknown_action")
    known = [F.when(~F.lower(F.trim(c)).isin("", "unknown_action"), F.lower(F.trim(c))) for c in (structured, terminal) if c is not None]
    return F.coalesce(*known, ruled)


def oracle_category(name: Column, raw: Column) -> Column:
    return first_match(ORACLE, call_text(name, raw), default="generic_assertion")


def input_source(declared: Column, name: Column, raw: Column) -> Column:
    given = F.lower(F.trim(blank(declared)))
    given = F.when(given == "unknown", "unknown_input").otherwise(given)
    text, code = call_text(name, raw), blank(raw)
    types = text.contains("fill") | text.contains("type") | text.contains("setvalue")
    ruled = F.coalesce(
        first_match(INPUT, text),
        F.when(types & code.rlike(r"""['"][^'"]+['"]"""), "literal_input"),
        F.when(text.contains("random") | text.contains("faker"), "generated_input"),
        F.when(code.rlike(r"\b[A-Za-z_$][\w$.]*\b") & ~code.rlike(r"""^\s*['"]"""), "variable_input"),
        F.when(text.contains("request") | text.contains("seed"), "api_seed_input"), F.lit("unknown_input"),
    )
    return F.when(given.isin(*KNOWN_INPUT), given).otherwise(ruled)


def locator_strategy(name: Column, raw: Column, category: Column) -> Column:
    """Null for calls that query no element."""
    text = call_text(name, raw)
    queries = category.eqNullSafe(F.lit("locator_query"))
    for call in LOCATOR_CALLS:
        queries = queries | text.contains(call)
    return F.when(queries, first_match(LOCATOR, text, default="other_locator"))


def locator_signal(strategy: Column) -> Column:
    return F.when(strategy.isin(*ROBUST_SIGNALS), "robust").when(strategy.isin(*COUPLED_SIGNALS), "coupled").when(strategy.isNotNull(), "neutral")


def preferred(structured: Column, ruled: Column, unknown: str = "unknown") -> Column:
    """struct(value, basis): the parsed value unless it says nothing and the rules' does."""
    parsed = unblank(F.trim(structured))
    use = parsed.isNotNull() & ((parsed != unknown) | ruled.isNull() | (ruled == unknown))
    return F.struct(F.when(use, parsed).otherwise(ruled).alias("value"), F.when(use, "ast").when(ruled.isNotNull(), "regex").otherwise("none").alias("basis"))


def source_disagreement(structured: Column, ruled: Column) -> Column:
    return mismatch_tags({"value_differs": (unblank(F.trim(structured)), ruled)})


def sync_pattern(name: Column, raw: Column, structured: Column | None = None) -> Column:
    ruled = first_match(SYNC, call_text(name, raw), default="unresolved_wait")
    return ruled if structured is None else preferred(structured, ruled)["value"]


def is_hook(source: Column) -> Column:
    return F.lower(blank(source)).isin(*BEFORE_HOOKS, *AFTER_HOOKS)


def action_bucket(source: Column, attached: Column, depth: Column) -> Column:
    s = F.lower(blank(source))
    return (
        F.when(F.coalesce(attached, F.lit(False)) | is_hook(source), "hook").when(s == "cypress_command", "cypress_command")
        .when((F.coalesce(depth, F.lit(0)) > 0) | s.isin("imported_helper", "helper_function"), "helper").otherwise("test_body")
    )


def assertion_bucket(source: Column, attached: Column, depth: Column) -> Column:
    s = F.lower(blank(source))
    return (
        F.when(F.coalesce(attached, F.lit(False)) | is_hook(source), "hook")
        .when((F.coalesce(depth, F.lit(0)) > 0) | s.isin(*HELPER_SOURCES), "helper").otherwise("direct")
    )


def is_test_body(source: Column, attached: Column, depth: Column) -> Column:
    s = F.lower(blank(source))
    return ~F.coalesce(attached, F.lit(False)) & (F.coalesce(depth, F.lit(0)) == 0) & s.isin(*BODY_SOURCES)


def workflow_abstraction(kind: Column, source: Column, depth: Column, resolved: Column, text: Column) -> Column:
    """How a step is abstracted: first match over resolution, call style and place."""
    k, s, t = F.lower(blank(kind)), F.lower(blank(source)), F.lower(blank(text))
    return (
        F.when(~F.coalesce(resolved, F.lit(True)), "unresolved_helper").when(k == "bdd_step", "bdd_step")
        .when((s == "page_object_method") | (k == "page_object_ctor") | t.rlike(r"\b\w+page\."), "page_object")
        .when(t.rlike(r"\battemptsto\s*\(|\bactor\b"), "screenplay")
        .when((s == "cypress_command") | (k == "custom_command_call"), "custom_command").when(k == "helper_call", "domain_helper")
        .when(k == "test_step", "test_step").when((k == "ui_action") & (F.coalesce(depth, F.lit(0)) > 0), "domain_helper")
        .when(is_hook(source), "hook_or_fixture").when(k.isin("ui_action", "assertion", "input"), "inline_test_body").otherwise("unclear")
    )


def workflow_archetype(body: Column, helper: Column, page: Column, hook: Column, command: Column, unresolved: Column) -> Column:
    """A test's dominant style from its counts of steps by owner; ties go to the earlier test."""
    total = body + helper + page + hook + command + unresolved
    first = F.greatest(body, helper, page, hook, command)
    second = F.element_at(F.array_sort(F.array(body, helper, page, hook, command)), -2)
    return (
        F.when(total == 0, "mixed_or_unclear").when((unresolved > 0) & (unresolved >= total - unresolved), "unresolved_thin_wrapper")
        .when((hook > 0) & ((hook * 2 >= total) | (hook >= body + page)), "hook_or_fixture_centric")
        .when((command > 0) & ((command * 2 >= total) | (command >= body + page)), "framework_extension_centric")
        .when((page > 0) & ((page * 2 >= total) | (page >= body + helper)), "page_object_centric")
        .when((helper > 0) & ((helper * 2 >= total) | (helper >= body + page)), "helper_mediated")
        .when((first * 2 < total) & (second * 4 >= total), "layered").when(body > 0, "inline_direct").otherwise("mixed_or_unclear")
    )


def file_confidence(declares: Column, ui: Column, framework: Column, strong_path: Column, custom: Column, fixture: Column, bdd: Column) -> Column:
    """high, medium, low or none from the kinds of evidence in a file."""
    return (
        F.when(~declares, "none").when(ui & (framework | strong_path), "high").when(ui, "medium")
        .when(custom, F.when(framework, "medium").otherwise("low")).when(fixture & framework, "medium").when(bdd & framework, "medium")
        .when(framework, "low").otherwise("none")
    )


def candidate_role(helpers: Column, page_object: Column, actions: Column, branches: Column, assertions: Column) -> Column:
    return (
        F.when((helpers > 0) | page_object, "abstraction_heavy")
        .when((actions >= 10) | (branches > 0) | (assertions >= 4), "complex").otherwise("simple")
    )


def candidate_score(role: Column, length: Column, helpers: Column, page_object: Column, assertions: Column) -> Column:
    """Lower is better within a role."""
    return (
        F.when(role == "simple", F.abs(length - 4) + 2 * F.greatest(F.lit(0), helpers - 1))
        .when(role == "abstraction_heavy", -helpers - 3 * page_object.cast("int")).otherwise(-length - assertions)
    )


def run_status(code: Column, output: Column) -> Column:
    """The class of a command's outcome from its exit code and output."""
    text = F.lower(blank(output))
    return (
        F.when(code.isNull() | text.contains("timed out"), "timeout").when(code == 0, "passed")
        .when(text.rlike(r"no tests? found|no specs? found"), "no_tests").when(text.rlike(r"cannot find module|command not found|enoent"), "environment_error")
        .when(text.rlike(r"econnrefused|err_connection"), "app_unreachable").otherwise("failed")
    )


def semantic_label(decided: Column, deterministic: Column, abstained: Column, guarded: Column) -> Column:
    """The label that stands: a guarded rule's, then the decision's unless it abstained, then the rule's."""
    use = ~F.coalesce(guarded, F.lit(False)) & ~F.coalesce(abstained, F.lit(False))
    return F.coalesce(F.when(use, unblank(decided)), unblank(deterministic))
