"""Parsers that columns can't express: nested arguments, spans and tokens. Arrow batches, never row calls."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "strings": T.ArrayType(T.StringType())}


def _struct(**fields: str) -> T.StructType:
    """A schema made without a session, so that importing this module needs none."""
    return T.StructType([T.StructField(k, _TYPES[v]) for k, v in fields.items()])


_CLOSE = {"(": ")", "[": "]", "{": "}"}
_HTTP = ("get", "post", "put", "patch", "delete", "head", "options")


def balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`, or -1; quoted text is skipped."""
    stack, i, n = [], at, len(text)
    while i < n:
        c = text[i]
        if c in "'\"`":
            i += 1
            while i < n and text[i] != c:
                i += 2 if text[i] == "\\" else 1
        elif c in _CLOSE:
            stack.append(_CLOSE[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    return -1


def arguments(text: str, at: int) -> list[str]:
    """Top-level arguments of the call whose parenthesis opens at `at`."""
    stop = balanced(text, at)
    body, parts, start, i = text[at + 1 : stop - 1 if stop > 0 else len(text)], [], 0, 0
    while i < len(body):
        c = body[i]
        if c in "'\"`":
            i += 1
            while i < len(body) and body[i] != c:
                i += 2 if body[i] == "\\" else 1
        elif c in _CLOSE:
            end = balanced(body, i)
            i = end - 1 if end > 0 else len(body)
        elif c == ",":
            parts.append(body[start:i].strip())
            start = i + 1
        i += 1
    parts.append(body[start:].strip())
    return parts if parts != [""] else []


_NAV = re.compile(r"(?:\.goto|\bcy\.visit|\bnavigateto|\bbrowser\.url)\s*(\()", re.I)
_WAIT = re.compile(r"\b(?:wait\w*|pause|sleep)\s*(\()", re.I)


def _target(code: str | None) -> tuple[str | None, str]:
    """Target and basis of a navigation call's first argument (its second after an HTTP method)."""
    m = _NAV.search(code or "")
    if not m:
        return None, "none"
    args = arguments(code, m.start(1))
    if not args:
        return None, "no_argument"
    first = args[0]
    if first[:1] in "'\"" and first[-1:] == first[:1] and len(first) > 1:
        value = first[1:-1].strip()
        if value.lower() in _HTTP:
            return value, "http_method_literal"
        return value, "string_literal"
    if first[:1] == "`" and first[-1:] == "`" and len(first) > 1:
        return first[1:-1].strip(), "dynamic_template_literal" if "${" in first else "template_literal"
    if first[:1] == "{":
        m = re.search(r"\burl\s*:\s*(['\"])(.*?)\1", first)
        return (m[2].strip(), "object_literal") if m else (None, "object")
    return None, "expression"


@F.pandas_udf(_struct(target="string", basis="string"))
def navigation_target(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_target(c) for c in code], columns=["target", "basis"])


def _wait_argument(code: str | None) -> tuple[str | None, str]:
    m = _WAIT.search(code or "")
    args = arguments(code, m.start(1)) if m else []
    if not args:
        return None, "none"
    first = args[0]
    kind = "number" if re.fullmatch(r"[\d_.]+", first) else "alias" if re.match(r"['\"`]@", first) else "string" if first[:1] in "'\"`" else "function" if "=>" in first or first.startswith("function") else "identifier"
    return first, kind


@F.pandas_udf(_struct(argument="string", kind="string"))
def wait_argument(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_wait_argument(c) for c in code], columns=["argument", "kind"])


_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|&&|\|\||\?\?|\?\.|=>|[{}()\[\];,?:.]|[^\s\w]", re.S)
_BRANCH = {"if", "for", "while", "case", "catch"}


def tokens(source: str) -> list[str]:
    """Lexical tokens of JavaScript or TypeScript without comments."""
    return [m[0] for m in _TOKEN.finditer(source or "") if not m[0].startswith(("//", "/*"))]


def complexity(source: str | None) -> dict[str, int]:
    """Lexical complexity: cyclomatic (1 + branches, loops, cases, catches, conditionals),
    extended (and logical operators), nesting depth of braces, lines with code."""
    toks = tokens(source or "")
    basic = 1 + sum(t in _BRANCH for t in toks) + sum(t == "?" and (i + 1 < len(toks) and toks[i + 1] not in (":", ")", ",")) for i, t in enumerate(toks))
    depth = deepest = 0
    for t in toks:
        depth += (t == "{") - (t == "}")
        deepest = max(deepest, depth)
    bare = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), source or "", flags=re.S)
    ncloc = sum(1 for line in bare.split("\n") if line.strip() and not line.strip().startswith("//"))
    return {"cyclomatic": basic, "cyclomatic_extended": basic + sum(t in ("&&", "||") for t in toks), "max_nesting": deepest, "ncloc": ncloc, "tokens": len(toks)}


@F.pandas_udf(_struct(cyclomatic="int", cyclomatic_extended="int", max_nesting="int", ncloc="int", tokens="int"))
def code_complexity(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([complexity(s) for s in source], columns=["cyclomatic", "cyclomatic_extended", "max_nesting", "ncloc", "tokens"])


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>")
_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}


def html_measures(html: str | None) -> dict[str, int]:
    """Tags, links, scripts and the nesting depth of a page."""
    text = re.sub(r"<!--.*?-->", "", html or "", flags=re.S)
    text = re.sub(r"(<(script|style)\b[^>]*>).*?(?=</\2)", r"\1", text, flags=re.S | re.I)
    depth = deepest = opened = links = scripts = 0
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if m[1]:
            depth = max(0, depth - 1)
        else:
            opened += 1
            links += name == "a"
            scripts += name == "script"
            if name not in _VOID and not m[3].endswith("/"):
                depth += 1
                deepest = max(deepest, depth)
    return {"tags": opened, "links": links, "scripts": scripts, "max_depth": deepest}


@F.pandas_udf(_struct(tags="int", links="int", scripts="int", max_depth="int"))
def html_complexity(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html_measures(h) for h in html], columns=["tags", "links", "scripts", "max_depth"])


_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*(\()")
_SUITE = re.compile(r"(?:^|\.)(describe|context|suite|fixture)(?:\.(only|skip|each|serial|parallel))?$")
_TEST = re.compile(r"^(?:test|it|specify|scenario)(?:\.(only|skip|each|fixme|todo))?$", re.I)
_HOOKS = re.compile(r"^(?:test\.)?(before|after|beforeEach|afterEach|beforeAll|afterAll)$")


def literal(text: str) -> str | None:
    return text[1:-1] if len(text) > 1 and text[0] in "'\"`" and text[-1] == text[0] else None


def extract_calls(source: str | None) -> list[dict]:
    """Suites, tests, hooks and calls of a source text, by line, with the suites around them.

    A lexical reading: comments are skipped, types and imports aren't resolved.
    """
    text = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), source or "", flags=re.S)
    found, stack = [], []
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    from bisect import bisect_right

    for m in _CALL.finditer(text):
        name, at = re.sub(r"\s+", "", m[1]), m.start(2)
        stack = [s for s in stack if s[1] > m.start()]
        stop = balanced(text, at)
        args = arguments(text, at)
        title = literal(args[0]) if args else None
        line = bisect_right(starts, m.start())
        end = bisect_right(starts, (stop if stop > 0 else len(text)) - 1)
        suite, test, hook = _SUITE.search(name), _TEST.match(name), _HOOKS.match(name)
        kind = "suite" if suite and title is not None else "test" if test and title is not None else "hook" if hook else "call"
        status = next((g for g in ((suite and suite[2]) or (test and test[1]),) if g in ("only", "skip")), "normal")
        found.append({
            "kind": kind, "name": name, "title": title, "line": line, "end_line": end, "status": status,
            "path": [s[0] for s in stack if s[2] == "suite"], "test": next((s[0] for s in reversed(stack) if s[2] == "test"), None),
            "hook": next((s[0] for s in reversed(stack) if s[2] == "hook"), None), "raw_code": (source or "")[m.start() : stop if stop > 0 else len(text)][:500],
        })
        if kind != "call" and stop > 0:
            stack.append((title if title is not None else name, stop, kind))
    return found


CALLS = T.ArrayType(_struct(kind="string", name="string", title="string", line="int", end_line="int", status="string", path="strings", test="string", hook="string", raw_code="string"))


@F.pandas_udf(CALLS)
def source_calls(source: pd.Series) -> pd.Series:
    return pd.Series([extract_calls(s) for s in source])
