"""Unions and set operations on keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import dedupe_features
from .joins import attach_hooks


def stacked(*parts: DataFrame) -> DataFrame:
    """Union by name; stage numbers the parts and missing columns are null."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("stage", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def unify_features(direct: DataFrame, expanded: DataFrame, tests: DataFrame, hooks: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """One stream of features: direct test-body rows, expanded rows, and hook rows for those
    repositories whose expanded rows have none attached; the first of equal rows stays."""
    body = direct.where("not coalesce(is_shared_hook_feature, false) and coalesce(test_id, '') <> '' and not coalesce(attached_from_hook, false) and coalesce(helper_depth, 0) = 0 and source_kind = 'test_body'")
    parts = [body, expanded]
    if hooks is not None:
        done = expanded.where("attached_from_hook").select("repo").distinct()
        parts.append(attach_hooks(tests.join(done, "repo", "left_anti"), hooks, compat))
    return dedupe_features(stacked(*parts), ["stage", "seq"])


def keys_in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def keys_only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def unknown_labels(df: DataFrame, label: str, taxonomy: list[str]) -> DataFrame:
    """Labels outside a taxonomy; empty where it holds."""
    return df.where(F.col(label).isNotNull() & ~F.col(label).isin(*taxonomy)).select(label).distinct()


def merged_counts(a: DataFrame, b: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    return a.select(*keys, n).unionByName(b.select(*keys, n)).groupBy(*keys).agg(F.sum(n).alias(n))


def merged_shards(parts: list[DataFrame]) -> DataFrame:
    """All shards' rows, equal ones once."""
    return stacked(*parts).drop("stage").dropDuplicates()
