import pytest
from pyspark.sql import functions as F

from testquarry.functions import classifiers as C
from testquarry.functions import parsers, rules
from testquarry.functions import scalars as S


def value(spark, column, **data):
    df = spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} string" for k in data)) if data else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("name, raw, want", [
    ("page.goto", "page.goto('/a')", "navigation"), ("expect", "expect(page).toHaveURL('/a'); page.goto(", "unknown_action"),
    ("cy.get", "cy.get('#a').click()", "locator_query"), ("el", "el.click()", "click"), ("el", "el.fill('x')", "text_input"),
    ("el", "el.press('Enter')", "keyboard_input"), ("el", "el.hover()", "hover"), ("x", "y", "unknown_action"),
])
def test_interaction(spark, name, raw, want):
    assert value(spark, C.interaction_category(F.col("n"), F.col("r")), n=name, r=raw) == want


def test_structured_category_wins_unless_unknown(spark):
    c = C.interaction_category(F.col("n"), F.col("r"), F.col("s"), F.col("t"))
    assert value(spark, c, n="a", r="a.click()", s="hover", t="") == "hover"
    assert value(spark, c, n="a", r="a.click()", s="unknown_action", t="drag_drop") == "drag_drop"
    assert value(spark, c, n="a", r="a.click()", s="", t="") == "click"


@pytest.mark.parametrize("raw, want", [
    ("expect(a).toBeVisible()", "visibility_oracle"), ("s.exists.ok()", "visibility_oracle"), ("expect(a).toHaveValue(1)", "element_state_oracle"),
    ("cy.location().its('a.href').should('eq', 1); to.eq", "url_navigation_oracle"), ("a.should('contain', 'x')", "text_content_oracle"), ("expect(a).toHaveLength(2)", "count_or_length_oracle"),
])
def test_oracle(spark, raw, want):
    assert value(spark, C.oracle_category(F.lit(""), F.col("r")), r=raw) == want


def test_setup_and_input(spark):
    s = lambda raw, source="", kind="": value(spark, C.setup_category(F.lit(""), F.col("r"), F.col("s"), F.col("k")), r=raw, s=source, k=kind)
    assert s("cy.intercept('/x')") == "network_mock" and s("x", "afterEach") == "teardown_cleanup" and s("x", "", "setup") == "hook_setup" and s("x") == "unknown_setup"
    i = lambda raw, d="": value(spark, C.input_source(F.col("d"), F.lit(""), F.col("r")), d=d, r=raw)
    assert i("a.fill('x')") == "literal_input" and i("process.env.A") == "environment_input" and i("x", "unknown") == "unknown_input" and i("faker.name()") == "generated_input"


def test_unknown_source_is_direct_but_not_body(spark):
    no, zero = F.lit(False), F.lit(0)
    assert value(spark, C.assertion_bucket(F.col("s"), no, zero), s="odd") == "direct"
    assert value(spark, C.action_bucket(F.col("s"), no, zero), s="odd") == "test_body"
    assert value(spark, C.is_test_body(F.col("s"), no, zero), s="odd") is False


def test_rules_agree_with_their_python_and_sql_forms(spark):
    import duckdb

    texts = ["page.goto('/x')", "waitForURL page.goto(", "getByRole('a')", "fill it", "", "hover", "nothing", "cy . visit"]
    df = spark.createDataFrame([(t.lower(),) for t in texts], "s string")
    got = [r.x for r in df.select(rules.first_match(C.INTERACTION, F.col("s"), default="unknown_action").alias("x")).collect()]
    assert got == [rules.evaluate(C.INTERACTION, t.lower(), default="unknown_action") for t in texts]
    sql = rules.first_match_sql(C.INTERACTION, "s", default="unknown_action")
    assert got == [duckdb.execute(f"SELECT {sql} FROM (SELECT ? AS s)", [t.lower()]).fetchone()[0] for t in texts]


@pytest.mark.parametrize("code, want", [
    ("page.goto('/a', {t: 1})", ("/a", "string_literal")), ("page.goto(`/a/${id}`)", ("/a/${id}", "dynamic_template_literal")),
    ("cy.visit({ url: '/b' })", ("/b", "object_literal")), ("page.goto(base + f(1, 2))", (None, "expression")), ("page.click('x')", (None, "none")), (None, (None, "none")),
])
def test_navigation_target(spark, code, want):
    got = spark.createDataFrame([(code,)], "c string").select(parsers.navigation_target("c").alias("n")).first().n
    assert tuple(got) == want


def test_arguments_skip_nested_brackets_and_quotes():
    assert parsers.arguments("f(a, g(b, ')'), [1, 2], `x,y`)", 1) == ["a", "g(b, ')')", "[1, 2]", "`x,y`"]
    assert parsers.arguments("f()", 1) == [] and parsers.balanced("f(a", 1) == -1


def test_complexity():
    code = "function f(a) {\n  // if\n  if (a && b) { for (;;) {} }\n\n  return a ? 1 : 2;\n}"
    assert parsers.complexity(code) == {"cyclomatic": 4, "cyclomatic_extended": 5, "max_nesting": 3, "ncloc": 4, "tokens": len(parsers.tokens(code))}
    assert parsers.complexity(None)["cyclomatic"] == 1


def test_html_measures():
    assert parsers.html_measures("<div><a href=x>y</a><br><script>if (a<b) '<p>'</script></div><!-- <p> -->") == {"tags": 4, "links": 1, "scripts": 1, "max_depth": 2}


def test_source_calls():
    code = "describe('s', () => {\n  beforeEach(() => { cy.visit('/') })\n  it.skip('t', () => {\n    cy.get('a').click()\n  })\n})"
    got = parsers.extract_calls(code)
    kinds = {(c["kind"], c["name"]): c for c in got}
    assert kinds["test", "it.skip"]["path"] == ["s"] and kinds["test", "it.skip"]["status"] == "skip" and kinds["test", "it.skip"]["end_line"] == 5
    assert kinds["call", "cy.visit"]["hook"] == "beforeEach" and kinds["call", "cy.get"]["test"] == "t"


def test_scalars(spark):
    assert value(spark, S.safe_int(F.col("a")), a="unknown") == 0 and value(spark, S.safe_int(F.col("a")), a=" 7 ") == 7
    assert value(spark, S.as_bool(F.col("a")), a="YES") is True and value(spark, S.as_bool(F.col("a")), a=None) is False
    assert value(spark, S.strip(F.col("a")), a="   x\t") == "x"
    assert value(spark, S.identifier_words(F.col("a")), a="getHTTPCode_2") == ["get", "http", "code", "2"]
    assert value(spark, S.static_urls(F.col("a")), a="goto('/a'); x('https://b.c/d'); '/a'") == ["/a", "https://b.c/d"]
    assert value(spark, S.has_dynamic_url(F.col("a")), a="`/a/${b}`") is True
    assert value(spark, S.json_signature(F.col("a"), ["x", "y"], F.lit("v1")), a='{"v": 2, "x": "p", "y": "q"}') == "p|q"
    assert value(spark, S.json_signature(F.col("a"), ["x"], F.lit("v1")), a="") == "v1"
    assert value(spark, S.redact(F.col("a")), a="a@b.de 1234567") == "<email> <number>"
    assert value(spark, S.path_class(F.col("a")), a="src/x.spec.ts") == "test"
    assert tuple(value(spark, S.provenance_parts(F.col("a")), a="json:data/a.json#user")) == ("json", "data/a.json", "user")
    assert value(spark, S.mismatch_tags({"a": (F.lit(1), F.lit(2)), "b": (F.lit(None), F.lit(None))})) == "a"
    assert spark.range(6).select(*S.mixed_radix(F.col("id"), [F.lit(2), F.lit(3)])).collect() == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
