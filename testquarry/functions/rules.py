"""Ordered rules as data, compiled to one column expression or to SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """label where any test holds: a substring of `on`, a pattern found in it, or a column equal to a value.

    also: a pattern that must be found as well; but: one that must not.
    """

    label: str
    has: tuple[str, ...] = ()
    like: tuple[str, ...] = ()
    equal: dict[str, tuple[str, ...]] = field(default_factory=dict)
    also: str = ""
    but: str = ""


def first_match(rules: list[Rule], on: Column, columns: dict[str, Column] | None = None, default: str | None = None) -> Column:
    """The label of the first rule that holds; one CASE that code generation compiles."""
    columns, out = columns or {}, None
    for r in rules:
        tests = [on.contains(s) for s in r.has] + [on.rlike(p) for p in r.like]
        tests += [F.coalesce(columns[c].isin(*values), F.lit(False)) for c, values in r.equal.items()]
        test = tests[0]
        for t in tests[1:]:
            test = test | t
        if r.also:
            test = test & on.rlike(r.also)
        if r.but:
            test = test & ~on.rlike(r.but)
        out = F.when(test, r.label) if out is None else out.when(test, r.label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def first_match_sql(rules: list[Rule], on: str, columns: dict[str, str] | None = None, default: str | None = None) -> str:
    """The same as DuckDB text."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    columns, parts = columns or {}, []
    for r in rules:
        tests = [f"contains({on}, {quote(s)})" for s in r.has] + [f"regexp_matches({on}, {quote(p)})" for p in r.like]
        tests += [f"coalesce({columns[c]} IN ({', '.join(map(quote, v))}), false)" for c, v in r.equal.items()]
        test = "(" + " OR ".join(tests) + ")"
        if r.also:
            test += f" AND regexp_matches({on}, {quote(r.also)})"
        if r.but:
            test += f" AND NOT regexp_matches({on}, {quote(r.but)})"
        parts.append(f"WHEN {test} THEN {quote(r.label)}")
    return f"CASE {' '.join(parts)} ELSE {quote(default) if default is not None else 'NULL'} END"


def evaluate(rules: list[Rule], on: str, values: dict[str, str] | None = None, default: str | None = None) -> str | None:
    """The same for one text in Python, for tests and for rule tables in Arrow functions."""
    values = values or {}
    for r in rules:
        hit = any(s in on for s in r.has) or any(re.search(p, on) for p in r.like) or any(values.get(c) in v for c, v in r.equal.items())
        if hit and (not r.also or re.search(r.also, on)) and not (r.but and re.search(r.but, on)):
            return r.label
    return default
