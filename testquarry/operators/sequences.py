"""Ordered-sequence metrics: runs, repeats, revisits and positions within a test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classifiers import UNCLASSIFIED_ACTIONS, USER_ACTIONS

MISSING_LINE = 1_000_000_000


def line_key(line: Column) -> Column:
    """Missing and non-positive lines last."""
    return F.when(line > 0, line).otherwise(MISSING_LINE)


def runs(df: DataFrame, keys: list[str], order: list[Column | str], signature: str) -> DataFrame:
    """keys, signature, start, length of each run of equal neighbours. One sort per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.select(*keys, F.col(signature).alias("_sig"), F.row_number().over(w).alias("_at"), F.lag(signature).over(w).alias("_prev"))
    step = F.when((F.col("_at") == 1) | ~F.col("_sig").eqNullSafe(F.col("_prev")), 1).otherwise(0)
    island = F.sum(step).over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", island).groupBy(*keys, "_run").agg(
        F.min("_at").alias("start"), F.count("*").alias("length"), F.first("_sig").alias(signature)
    ).drop("_run")


def repeat_metrics(df: DataFrame, keys: list[str], order: list[Column | str], signature: str) -> DataFrame:
    """keys, event_count, repeated_count, repeat_fraction, max_run, top_signature.

    Repeated events stand in runs of two or more; the top signature is that of the first
    longest such run, null without one. All steps share the partitioning by keys.
    """
    long = F.col("length") >= 2
    return runs(df, keys, order, signature).groupBy(*keys).agg(
        F.sum("length").cast("long").alias("event_count"),
        F.coalesce(F.sum(F.when(long, F.col("length"))), F.lit(0)).cast("long").alias("repeated_count"),
        F.max("length").cast("long").alias("max_run"),
        F.max_by(F.when(long, F.col(signature)), F.struct(F.when(long, F.col("length")).otherwise(0), -F.col("start"))).alias("top_signature"),
    ).withColumn("repeat_fraction", F.col("repeated_count") / F.col("event_count"))


def revisits(df: DataFrame, keys: list[str], value: str, counts: Column | None = None) -> DataFrame:
    """keys, visits, revisits: rows with a value, and those whose value was met before."""
    rows = df.where(counts) if counts is not None else df
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("visits"), (F.count("*") - F.countDistinct(value)).alias("revisits"))


def scoped(events: DataFrame, scope: str, category: str = "category") -> DataFrame:
    """all, user or classified events; runs are recomputed after this."""
    if scope == "all":
        return events
    user = events.where(F.col(category).isin(*USER_ACTIONS))
    return user if scope == "user" else user.where(~F.col(category).isin(*UNCLASSIFIED_ACTIONS))


def sequence_metrics(events: DataFrame, keys: list[str], order: list[Column | str], signature: str, category: str = "category", scopes: tuple[str, ...] = ("all", "user", "classified")) -> DataFrame:
    """Repeat metrics of every scope under its prefix, a row per key of the events."""
    out = events.select(*keys).distinct()
    for scope in scopes:
        m = repeat_metrics(scoped(events, scope, category), keys, order, signature)
        out = out.join(m.select(*keys, *(F.col(c).alias(f"{scope}_{c}") for c in m.columns if c not in keys)), keys, "left")
    return out.fillna(0, [c for c in out.columns if c.endswith(("_count", "_max_run"))])


def signature_version(events: DataFrame, keys: list[str], structured: str) -> DataFrame:
    """v2 where all events have a structured signature, mixed where some, else v1."""
    n = F.count_if(F.trim(F.coalesce(structured, F.lit(""))) != "")
    return events.groupBy(*keys).agg(F.when(n == F.count("*"), "v2").when(n > 0, "mixed").otherwise("v1").alias("signature_version"))


def sequence_index(df: DataFrame, keys: list[str], order: list[str], out: str = "sequence_index") -> DataFrame:
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def up_to_first(df: DataFrame, keys: list[str], order: list[str], stop: Column) -> DataFrame:
    """Rows at or before each key's first row that meets `stop`; all rows where none does."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_past", F.coalesce(F.max(stop.cast("int")).over(w), F.lit(0))).where("_past = 0").drop("_past")


def first_line(df: DataFrame, keys: list[str], line: str, counts: Column) -> DataFrame:
    """Each row with the least positive line of its key's counted rows."""
    return df.withColumn("first_line", F.min(F.when(counts & (F.col(line) > 0), F.col(line))).over(Window.partitionBy(*keys)))


def lifecycle_window(calls: DataFrame, keys: list[str], line: str, category: str, anchored: Column) -> DataFrame:
    """Calls no later than the first UI action that isn't a navigation, or tied to a hook."""
    marked = first_line(calls, keys, line, (F.col("feature_type") == "ui_action") & (F.col(category) != "navigation"))
    return marked.where(anchored | F.col("first_line").isNull() | (F.col(line) <= F.col("first_line"))).drop("first_line")


def navigation_bootstrap(units: DataFrame, keys: list[str]) -> DataFrame:
    """units with accepted: at most one navigation unit of each key opens the test.

    units: line, name, is_navigation, is_setup, hook_instance_key, first_ui_line, intent. In
    order of (line, name), a candidate is barred by a setup unit on an earlier line outside
    its hook. The first that is not barred is taken if it does not come after the first UI
    line (a later candidate only if it comes before it) and its intent is
    navigation_bootstrap; any other intent leaves the place free. As barring only grows, the
    taken one is a minimum over candidates and needs no sequential state.
    """
    w = Window.partitionBy(*keys)
    hook, setup = F.coalesce("hook_instance_key", F.lit("")), F.col("is_setup") & ~F.col("is_navigation")
    lines = F.collect_set(F.when(setup, F.struct(F.col("line").alias("line"), hook.alias("h")))).over(w)
    marked = units.withColumns({"_h": hook, "_setups": lines})
    barred = F.exists("_setups", lambda s: (s["line"] < F.col("line")) & ~((s["h"] == F.col("_h")) & (s["h"] != "")))
    marked = marked.withColumn("_open", F.col("is_navigation") & ~barred)
    rank = F.row_number().over(w.orderBy(F.when(F.col("_open"), 0).otherwise(1), "line", "name"))
    ui = F.coalesce("first_ui_line", F.lit(0))
    fits = F.when(rank == 1, (ui == 0) | (F.col("line") <= ui)).otherwise(F.col("line") < ui)
    marked = marked.withColumn("_fits", F.col("_open") & fits & (F.col("intent") == "navigation_bootstrap"))
    first = F.min(F.when(F.col("_fits"), F.struct("line", "name"))).over(w)
    return marked.withColumn("accepted", F.coalesce(F.col("_fits") & (F.struct("line", "name") == first), F.lit(False))).drop("_h", "_setups", "_open", "_fits")


def tertile_bins(df: DataFrame, value: str, out: str = "bin") -> DataFrame:
    """small, medium or large by the values at ranks round(.33 (n-1)) and round(.66 (n-1))."""
    low, high = nearest_rank_values(df, value, (33, 66))
    v = F.col(value)
    return df.withColumn(out, F.when(v.isNull(), None).when(v <= low, "small").when(v <= high, "medium").otherwise("large"))


def nearest_rank_values(df: DataFrame, value: str, percents: tuple[int, ...]) -> list:
    """Values at the nearest ranks, on the driver: one number for each percent."""
    from .aggregates import nearest_rank_percentiles

    row = nearest_rank_percentiles(df, [], value, percents).first()
    return [row[f"p{p}"] if row else None for p in percents]


def top_sources(df: DataFrame, keys: list[str], label: str, n: str, priority: list[str], k: int = 2) -> DataFrame:
    """keys with the k largest labels and their shares, ties in order of priority."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(label)), F.lit(0))
    rows = df.groupBy(*keys, label).agg(F.sum(n).alias("_n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), order.alias("p"), F.col(label).alias("label"))))
    out = rows.groupBy(*keys).agg(F.slice(ranked, 1, k).alias("top"), F.sum("_n").alias("total"))
    return out.withColumn("top", F.transform("top", lambda x: F.struct(x["label"].alias("label"), (-x["n"] / F.col("total")).alias("share")))).drop("total")
