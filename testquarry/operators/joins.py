"""Joins of events, tests, hooks and metrics. No side is broadcast by hint: Spark broadcasts what its size allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import starts_with_path, strip, unblank
from .dedupe import keep_first, keep_last


def attach_to_spine(events: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """Events of known tests; orphans go."""
    return events.join(spine.select(*keys).distinct(), keys, "left_semi")


def left_join_flagged(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "sm_", status: str | None = None, order: str | None = None) -> DataFrame:
    """left with right's columns under a prefix, null where unmatched, and <prefix>joined.

    With order, right's last row of a key counts. With status, <prefix>metrics_ok says
    whether that column reads ok.
    """
    right = keep_last(right, list(keys), order) if order else right
    rest = [c for c in right.columns if c not in keys]
    named = right.select(*keys, *(F.col(c).alias(prefix + c) for c in rest), F.lit(True).alias(f"{prefix}joined"))
    out = left.join(named, keys, "left").withColumn(f"{prefix}joined", F.coalesce(f"{prefix}joined", F.lit(False)))
    if status:
        out = out.withColumn(f"{prefix}metrics_ok", F.coalesce(F.lower(F.trim(F.col(prefix + status))) == "ok", F.lit(False)))
    return out


def join_coverage(left: DataFrame, right: DataFrame, keys: list[str], ok: Column | None = None) -> DataFrame:
    """One row: matched, matched_ok, unmatched and orphan keys of two tables."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.groupBy(*keys).agg(F.max((ok if ok is not None else F.lit(True)).cast("int")).alias("_ok"), F.lit(1).alias("_r"))
    both = a.join(b, keys, "full_outer")
    hit = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(
        F.count_if(hit).alias("matched"), F.count_if(hit & (F.col("_ok") == 1)).alias("matched_ok"),
        F.count_if(F.col("_r").isNull()).alias("unmatched"), F.count_if(F.col("_l").isNull()).alias("orphan"),
    )


def join_filled(left: DataFrame, right: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """left with right's columns, defaults where unmatched."""
    return left.join(right, keys, "left").fillna(fill)


def attach_by_key_array(left: DataFrame, array: str, right: DataFrame, key: str, also: list[str] | None = None) -> DataFrame:
    """A row of left for each element of its key array that right has, distinct elements only."""
    rows = left.withColumn(key, F.explode(F.array_distinct(array)))
    return rows.join(right, [*(also or []), key])


def attach_hooks(tests: DataFrame, hook_features: DataFrame, compat: bool = False, suppressed: DataFrame | None = None) -> DataFrame:
    """Shared hook features as features of every test that names the hook.

    Hooks are matched within their repository and file; compat matches by the bare key.
    suppressed: (repo, test_id, hook_instance_key) attached elsewhere already.
    """
    also = [] if compat else ["repo", "file_path"]
    keep = ["test_id", *(c for c in also)]
    spine = tests.select(*keep, "hook_instance_keys", *([F.col("repo").alias("_repo")] if compat else []))
    hooks = hook_features.drop("test_id", *(["repo"] if compat else []))
    rows = attach_by_key_array(spine, "hook_instance_keys", hooks, "hook_instance_key", also).drop("hook_instance_keys")
    rows = rows.withColumnRenamed("_repo", "repo").withColumn("attached_from_hook", F.lit(True))
    return rows if suppressed is None else rows.join(suppressed, ["repo", "test_id", "hook_instance_key"], "left_anti")


def join_by_path_prefix(left: DataFrame, left_path: str, right: DataFrame, right_path: str, keys: list[str]) -> DataFrame:
    """Pairs of equal keys where right's path begins left's; an empty path begins all.

    Left's path is cut at each of its lengths and joined by equality on (keys, prefix), so
    no key's pairs are formed and then filtered.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.size(left_path)), lambda n: F.array_join(F.slice(left_path, F.lit(1), n), "\x1f"))
    a = left.withColumn("_prefix", F.explode(prefixes))
    b = right.withColumn("_prefix", F.array_join(F.col(right_path), "\x1f"))
    same = [c for c in b.columns if c in left.columns and c not in keys]
    return a.join(b.drop(*same), [*keys, "_prefix"]).drop("_prefix")


def hooks_in_scope(tests: DataFrame, hooks: DataFrame) -> DataFrame:
    """Test and hook pairs of one repository and file whose suite path the hook's begins."""
    h = hooks.select("repo", "file_path", "hook_instance_key", F.col("describe_path").alias("hook_path"))
    return join_by_path_prefix(tests, "describe_path", h, "hook_path", ["repo", "file_path"]).where(starts_with_path(F.col("describe_path"), F.col("hook_path")))


def latest_before(events: DataFrame, keys: list[str], order: list[str], is_context: Column, context: str, out: str) -> DataFrame:
    """Each row with the latest context value at or before it within its keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(out, F.last(F.when(is_context, F.col(context)), ignorenulls=True).over(w))


def match_by_priority(left: DataFrame, right: DataFrame, keys: list[str], rank: Column, left_id: str, order: list[str]) -> DataFrame:
    """For each row of left the one row of right with equal keys and the least rank."""
    return keep_first(left.join(right, keys).withColumn("_rank", rank), [left_id], ["_rank", *order]).drop("_rank")


def match_with_fallback(left: DataFrame, right: DataFrame, exact: list[str], name: str, value: str, scope: list[str]) -> DataFrame:
    """value from right by the exact keys, else by the name where right has it once in the scope."""
    first = right.groupBy(*exact).agg(F.first(value, ignorenulls=True).alias("_exact"))
    once = right.groupBy(*scope, name).agg(F.count("*").alias("_n"), F.first(value).alias("_named")).where("_n = 1").drop("_n")
    return left.join(first, exact, "left").join(once, [*scope, name], "left").withColumn(value, F.coalesce("_exact", "_named")).drop("_exact", "_named")


def fill_blanks(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Blank columns of left from the first row of right with equal keys; others stay."""
    found = keep_first(right, list(keys), order).select(*keys, *(F.col(c).alias("_r_" + c) for c in columns))
    out = left.join(found, keys, "left")
    return out.withColumns({c: F.coalesce(unblank(F.col(c)), F.col("_r_" + c)) for c in columns}).drop(*("_r_" + c for c in columns))


def siblings(sample: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows that share keys with a sampled one, once."""
    return rows.join(sample.select(*keys).distinct(), keys, "left_semi").dropDuplicates()


def distribution_delta(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """label, old, new, delta, delta_pct (null where old is 0) over all labels of both tables."""
    a, b = old.groupBy(label).agg(F.count("*").alias("old")), new.groupBy(label).agg(F.count("*").alias("new"))
    zero = F.lit(0).cast("long")
    both = a.join(b, label, "full_outer").select(label, F.coalesce("old", zero).alias("old"), F.coalesce("new", zero).alias("new"))
    delta = F.col("new") - F.col("old")
    return both.withColumn("delta", delta).withColumn("delta_pct", F.when(F.col("old") != 0, F.col("delta") * 100.0 / F.col("old")))


def join_either_key(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], left_id: str, order: list[str]) -> DataFrame:
    """Left rows with the first right row that shares any of their keys: both sides' keys are
    exploded, so a disjunction stays an equality join."""
    a = left.withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.array(*left_keys)))))
    b = right.withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.array(*right_keys)))))
    return keep_first(a.join(b.drop(*(c for c in right.columns if c in left.columns)), "_key").drop("_key"), [left_id], order)


def latest_binding(uses: DataFrame, bindings: DataFrame, keys: list[str], use_line: str, decl_line: str, value: str) -> DataFrame:
    """Each use with the binding of equal keys declared last at or before its line.

    A union and one running last value per key: rows of a key are sorted once, and no pairs
    of uses and bindings are formed.
    """
    rows = uses.withColumns({"_line": F.col(use_line), "_bind": F.lit(1)})
    marks = bindings.select(*keys, F.col(decl_line).alias("_line"), F.lit(0).alias("_bind"), F.col(value).alias("_value"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_line", "_bind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_bind = 1").drop("_line", "_bind", "_value")


def expand_calls(calls: DataFrame, definitions: DataFrame, hops: int = 2, max_files: int = 20) -> DataFrame:
    """(root, node, depth, path): definitions reached from each root over at most `hops` calls.

    calls: (caller, callee); definitions: (node, file). A node on its own path is not
    entered again. Of each root the max_files files reached first count, by depth then name.
    """
    step = calls.select(F.col("caller").alias("node"), F.col("callee").alias("_next")).distinct()
    level = definitions.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    reached = None
    for depth in range(1, hops + 1):
        level = (
            level.join(step, "node").where(~F.array_contains("path", F.col("_next")))
            .select("root", F.col("_next").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("_next")).alias("path"))
        )
        reached = level if reached is None else reached.unionByName(level)
    found = reached.join(definitions.select("node", "file"), "node")
    nearest = found.groupBy("root", "file").agg(F.min("depth").alias("_d"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy("_d", "file"))
    return found.join(nearest.withColumn("_r", rank).where(F.col("_r") <= max_files).select("root", "file"), ["root", "file"])


def semi_by_names(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return df.join(names.select(strip(F.col(key)).alias(key)).distinct(), key, "left_semi")
