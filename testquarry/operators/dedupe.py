"""Keyed deduplication; which row stays is always spelled out, never left to arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip

#: Keys of feature rows, expanded feature rows and helper edges.
FEATURE_KEY = ("repo", "test_id", "feature_type", "name", "line", "source_kind", "helper_depth", "target_file", "hook_instance_key", "attached_from_hook")
EXPANDED_KEY = ("repo", "test_id", "feature_type", "name", "line", "source_kind", "helper_depth", "target_file")
EDGE_KEY = ("repo", "test_id", "hook_instance_key", "from", "to", "target_file", "depth", "resolved")


def keep_one(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    One aggregate with partial maxima before the shuffle, not a window: a key with most of
    the rows sends one row per task. Null keys are keys.
    """
    names = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    made = {n: k for n, k in zip(names, keys) if not isinstance(k, str)}
    ranked = df.withColumns(made) if made else df
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    picked = ranked.groupBy(*names).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select(*(F.col("_row").getField(c).alias(c) for c in df.columns))


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    return keep_one(df, keys, [F.col(c) for c in order])


def keep_last(df: DataFrame, keys: list[str | Column], order: str) -> DataFrame:
    """The last row by one numeric order column."""
    return keep_one(df, keys, [-F.col(order)])


def keep_best(df: DataFrame, keys: list[str | Column], ranks: list[Column], order: list[str]) -> DataFrame:
    """The row with the greatest numeric ranks; ties keep the first."""
    return keep_one(df, keys, [*(-r for r in ranks), *(F.col(c) for c in order)])


def dedupe_features(features: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Feature rows by their key and the start of their source text; rows without ids go."""
    order = order or ["seq"]
    known = features.where("trim(coalesce(repo, '')) <> '' and trim(coalesce(test_id, '')) <> ''")
    return keep_first(known, [*FEATURE_KEY, clip(F.col("raw_code"), "dedupe")], order)


def dedupe_expanded(features: DataFrame, order: list[str] | None = None) -> DataFrame:
    return keep_first(features, list(EXPANDED_KEY), order or ["seq"])


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Edges by their key; unknown resolution is a value of its own."""
    return edges.dropDuplicates(list(EDGE_KEY))


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedupe_navigation(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Only navigation rows count: others neither stay nor hide a later one."""
    return keep_first(events.where("category = 'navigation'"), keys, order)


def dedupe_relaxed(df: DataFrame, strict: list[str], relaxed: list[str], order: list[str], target: int) -> DataFrame:
    """One row per strict key first, then further rows by the relaxed key, up to target rows in all.

    target is a feature of the operator: a task suite of fixed size.
    """
    def place(keys):
        return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))

    ranked = df.withColumn("_pass", F.when(place(strict) == 1, 1).when(place(relaxed) == 1, 2))
    return ranked.where("_pass is not null").orderBy("_pass", *order).limit(target).drop("_pass")
