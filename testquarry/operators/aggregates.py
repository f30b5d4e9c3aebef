"""Grouped measures: histograms, weighted shares, percentiles, densities, chains, placement, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_bool, ratio, unblank

LINK_RATE, RESOLVE_RATE = 0.60, 0.20
UNCLASSIFIED = ("locator_query", "wait_synchronization", "unknown_action")


def histogram(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, label, n: the long form of a label counter; blank labels don't count."""
    return df.where(unblank(F.col(label)).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))


def histogram_map(df: DataFrame, keys: list[str], label: str, out: str = "counts") -> DataFrame:
    """keys and a map of labels to counts."""
    rows = histogram(df, keys, label).groupBy(*keys)
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias(out))


def merge_maps(df: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """Sum of the count maps of a key, label by label."""
    rows = df.select(*keys, F.explode(counts).alias("label", "n")).groupBy(*keys, "label").agg(F.sum("n").alias("n"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias(counts))


def event_weighted(events: DataFrame, label: str) -> DataFrame:
    """label, n, share of all events; rows of a blank label count in the whole only."""
    by = events.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return by.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1)))).where(unblank(F.col("label")).isNotNull()).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def test_weighted(events: DataFrame, spine: DataFrame, keys: list[str], label: str) -> DataFrame:
    """label, tests, share of all tests of the spine that have it."""
    total = spine.agg(F.count_distinct(F.struct(*keys)).alias("total"))
    pairs = events.where(unblank(F.col(label)).isNotNull()).select(*keys, F.col(label).alias("label")).distinct()
    by = pairs.groupBy("label").agg(F.count("*").alias("tests"))
    n = total.first()[0]
    return by.select("label", "tests", (F.col("tests") / F.lit(n)).alias("share"))


def repo_weighted(events: DataFrame, spine: DataFrame, repo: str, keys: list[str], label: str) -> DataFrame:
    """label, mean over all repositories of the share of their tests that have it, repos_with_label, repo_count."""
    sizes = spine.select(repo, *keys).distinct().groupBy(repo).agg(F.count("*").alias("tests"))
    repos = sizes.count()
    have = events.where(unblank(F.col(label)).isNotNull()).select(repo, *keys, F.col(label).alias("label")).distinct()
    by = have.groupBy(repo, "label").agg(F.count("*").alias("n")).join(sizes, repo)
    return by.groupBy("label").agg((F.sum(F.col("n") / F.col("tests")) / F.lit(repos)).alias("mean_share"), F.count("*").alias("repos_with_label"), F.lit(repos).cast("long").alias("repo_count"))


def nearest_rank_percentiles(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """keys, n, p<percent>: the value at the 0-based rank percent / 100 * (n - 1), rounded half to even.

    Values are counted first, so a key's sorted distinct values carry cumulative counts and
    the rank is looked up among them: no list of all rows is formed.
    """
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    part = [F.col(k) for k in keys] or [F.lit(1)]
    up = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = by.withColumns({"_up": F.sum("_c").over(up), "_n": F.sum("_c").over(Window.partitionBy(*part))})
    picks = [F.min(F.when(F.col("_up") > F.bround(F.lit(p) * (F.col("_n") - 1) / 100.0), F.col(value))).alias(f"p{p}") for p in percents]
    return ranked.groupBy(*keys).agg(F.first("_n").cast("long").alias("n"), *picks)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, median: the value at 0-based rank n // 2."""
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    part = [F.col(k) for k in keys] or [F.lit(1)]
    up = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = by.withColumns({"_up": F.sum("_c").over(up), "_n": F.sum("_c").over(Window.partitionBy(*part))})
    return ranked.groupBy(*keys).agg(F.first("_n").cast("long").alias("n"), F.min(F.when(F.col("_up") > F.floor(F.col("_n") / 2), F.col(value))).alias("median"))


def true_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(value).alias("median"))


def control_flow(events: DataFrame, keys: list[str], classified: bool = False, category: str = "category") -> DataFrame:
    """Loop, branch and conditional counts of UI actions and the deepest loop."""
    rows = events.where(~F.col(category).isin(*UNCLASSIFIED)) if classified else events
    where = F.col("control_flow_enclosure")
    loop, branch = where.isin("loop", "loop_and_branch"), where.isin("branch", "loop_and_branch")
    conditional = branch & ~F.coalesce(F.col("control_flow_branch_kind"), F.lit("")).isin("try_catch")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("actions"), F.count_if(loop).alias("loop_driven"), F.count_if(branch).alias("branch_driven"),
        F.count_if(conditional).alias("conditionalized"), F.coalesce(F.max("control_flow_loop_depth"), F.lit(0)).alias("max_loop_depth"),
    )
    return out.withColumn("conditionalized_fraction", ratio(F.col("conditionalized"), F.col("actions"), 6))


def densities(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Assertion densities of by-test counts; null where a denominator is missing or not positive."""
    c = F.col
    return df.withColumns({
        "assertion_density_all_actions": ratio(c("assertions"), c("ui_actions"), digits),
        "assertion_density_test_body": ratio(c("body_assertions"), c("body_ui_actions"), digits),
        "assertion_density_per_ncloc": ratio(c("assertions"), c("ncloc"), digits),
        "assertion_density_per_statement": ratio(c("assertions"), c("statements"), digits),
        "no_assertions": c("assertions") == 0,
        "only_helper_assertions": (c("assertions") > 0) & (c("direct_assertions") == 0) & (c("hook_assertions") == 0) & (c("helper_assertions") > 0),
    })


def assertion_chains(rows: DataFrame, keys: list[str], root: str = "assertion_chain_root_id", length: str = "assertion_chain_length", matcher: str | None = None) -> DataFrame:
    """Matcher-level and chain-level measures of each test.

    Rows without a root, a matcher or a length count as missing. Chain lengths are the
    greatest of each root's rows; roots of length 0 don't count in the mean.
    """
    n = F.coalesce(F.col(length).try_cast("int") if rows.schema[length].dataType.simpleString() == "string" else F.col(length).cast("int"), F.lit(0))
    known = (F.coalesce(F.col(root).cast("string"), F.lit("")) != "") | (n > 0)
    if matcher:
        known = known | (F.coalesce(F.col(matcher), F.lit("")) != "")
    soft = [F.count_if(as_bool(F.col(c))).alias(o) for c, o in (("is_soft_assertion", "soft"), ("is_grouped_assertion", "grouped")) if c in rows.columns]
    flat = rows.groupBy(*keys).agg(
        F.count("*").alias("assertions"), F.count_if(~known).alias("missing"), F.count_if(known & (n > 1)).alias("chained_matchers"), *soft
    )
    tops = rows.where(known & F.col(root).isNotNull()).groupBy(*keys, root).agg(F.max(n).alias("_top"))
    chains = tops.groupBy(*keys).agg(
        F.count("*").alias("chains"), F.count_if(F.col("_top") > 1).alias("chained_roots"),
        F.max("_top").alias("max_chain_length"), F.avg(F.when(F.col("_top") > 0, F.col("_top"))).alias("mean_chain_length"),
    )
    return flat.join(chains, keys, "left")


def placement(ui_min: Column, ui_max: Column, as_min: Column, as_max: Column, inside: Column) -> Column:
    """Where assertions stand among UI actions; inside: any lies strictly between the first and last."""
    return (
        F.when(as_min.isNull(), "none").when(ui_min.isNull(), "assertions_only").when(as_min > ui_max, "end_only")
        .when(as_max < ui_min, "start_only").when(inside, "interleaved").otherwise("mixed")
    )


def assertion_placement(events: DataFrame, keys: list[str], at: str, is_ui: Column, is_assertion: Column) -> DataFrame:
    """keys, placement. The span of UI actions and the assertions' list of places are one
    aggregate; a test's assertions are few."""
    by = events.groupBy(*keys).agg(
        F.min(F.when(is_ui, F.col(at))).alias("u0"), F.max(F.when(is_ui, F.col(at))).alias("u1"),
        F.min(F.when(is_assertion, F.col(at))).alias("a0"), F.max(F.when(is_assertion, F.col(at))).alias("a1"),
        F.collect_set(F.when(is_assertion, F.col(at))).alias("places"),
    )
    inside = F.exists("places", lambda x: (x > F.col("u0")) & (x < F.col("u1")))
    return by.select(*keys, placement(F.col("u0"), F.col("u1"), F.col("a0"), F.col("a1"), inside).alias("placement"))


def source_pattern(counts: dict[str, Column]) -> Column:
    """Names of the sources that have any, joined by _and_, or none."""
    out = F.concat_ws("_and_", *(F.when(c > 0, F.lit(n)) for n, c in counts.items()))
    return F.when(out == "", "none").otherwise(out)


def gates(rows: DataFrame, candidate: Column, linked: Column, variable: Column, resolved: Column) -> DataFrame:
    """One row: link and resolve rates, their thresholds and whether the unrounded rates pass."""
    by = rows.agg(
        F.count_if(candidate).alias("candidates"), F.count_if(candidate & linked).alias("linked"),
        F.count_if(variable).alias("variables"), F.count_if(variable & resolved).alias("resolved"),
    )
    link, res = F.col("linked") / F.greatest("candidates", F.lit(1)), F.col("resolved") / F.greatest("variables", F.lit(1))
    return by.select("*", F.bround(link, 4).alias("link_rate"), F.bround(res, 4).alias("resolve_rate"), (link >= LINK_RATE).alias("link_pass"), (res >= RESOLVE_RATE).alias("resolve_pass"))


def range_gates(rows: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: for each measure whether its least value is low enough and its greatest below the bound."""
    tests = [((F.min(c) >= low) & (F.max(c) < high)).alias(f"{c}_pass") for c, (low, high) in bounds.items()]
    return rows.agg(F.count("*").alias("rows"), *tests)


def navigation_by_test(calls: DataFrame, keys: list[str], urls: str = "urls", dynamic: str = "dynamic") -> DataFrame:
    """keys, navigation calls, dynamic ones, distinct static URLs and their sum as estimate."""
    flat = calls.select(*keys, F.explode(urls).alias("_u")).groupBy(*keys).agg(F.count_distinct("_u").alias("static_urls"))
    by = calls.groupBy(*keys).agg(F.count("*").alias("navigations"), F.count_if(F.col(dynamic)).alias("dynamic"), F.bool_or(dynamic).alias("has_dynamic"))
    out = by.join(flat, keys, "left").fillna(0, ["static_urls"])
    return out.withColumn("page_estimate", F.col("static_urls") + F.col("dynamic"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n in the long form, most first."""
    return df.groupBy(a, b).agg(F.count("*").alias("n")).orderBy(F.desc("n"), a, b)


def group_summary(df: DataFrame, group: str, sums: list[str], unknown: str = "Unknown") -> DataFrame:
    """group (blank as unknown), row_count and the sums."""
    return df.groupBy(F.coalesce(unblank(F.col(group)), F.lit(unknown)).alias(group)).agg(F.count("*").alias("row_count"), *(F.sum(c).alias(c) for c in sums))


def primary_label(df: DataFrame, keys: list[str], label: str, order: str | None = None) -> DataFrame:
    """keys and the most frequent label; ties go to the first seen, or without order to the least."""
    by = df.where(unblank(F.col(label)).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"), (F.min(order) if order else F.lit(0)).alias("_first"))
    return by.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("_n"), "_first", label)).alias(label))


def highest_rank(df: DataFrame, keys: list[str], label: str, ranks: list[str]) -> DataFrame:
    """keys and the label that comes last in ranks."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), F.col(label)), F.lit(0))
    return df.groupBy(*keys).agg(F.max_by(label, F.struct(place, label)).alias(label))


def stability(runs: DataFrame, keys: list[str], passed: str, duration: str) -> DataFrame:
    """keys, attempted, passed, stable (all passed), median and greatest of positive durations."""
    positive = F.when(F.col(duration) > 0, F.col(duration))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("attempted"), F.count_if(F.col(passed)).alias("passed"), F.every(F.coalesce(F.col(passed), F.lit(False))).alias("stable"),
        F.median(positive).alias("median_duration"), F.max(positive).alias("max_duration"),
    )


def validation_report(df: DataFrame, status: str, measures: list[str]) -> DataFrame:
    """measure, n, min, p50, p90, p99, max of the rows whose status is ok."""
    ok = df.where(F.lower(F.trim(F.col(status))) == "ok")
    long = ok.select(F.explode(F.create_map(*(x for m in measures for x in (F.lit(m), F.col(m).cast("double"))))).alias("measure", "value"))
    ends = long.groupBy("measure").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return nearest_rank_percentiles(long, ["measure"], "value").join(ends, "measure")


def outliers(df: DataFrame, measure: str, bound: float, n: int = 50) -> DataFrame:
    """The n largest values above the bound, a report's limit."""
    return df.where(F.col(measure) > bound).orderBy(F.desc(measure), *(c for c in df.columns if c != measure)).limit(n)


def single_or_mixed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the one value of a key, or `mixed`."""
    v = F.array_sort(F.collect_set(unblank(F.col(value))))
    return df.groupBy(*keys).agg(F.when(F.size(v) == 1, v[0]).when(F.size(v) > 1, "mixed").alias(value))


def flag_counts(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Rows and the rows that meet each flag; global without keys."""
    out = [F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items())]
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def pattern_summary(events: DataFrame, keys: list[str], label: str, labels: list[str]) -> DataFrame:
    """Counts and shares of the given labels and the dominant one of each key."""
    counts = [F.count_if(F.col(label) == x).alias(f"{x}_count") for x in labels]
    by = events.groupBy(*keys).agg(F.count("*").alias("total"), *counts)
    shares = {f"{x}_share": ratio(F.col(f"{x}_count"), F.col("total")) for x in labels}
    top = F.array_sort(F.array(*(F.struct((-F.col(f"{x}_count")).alias("n"), F.lit(x).alias("label")) for x in labels)))[0]
    return by.withColumns(shares | {"dominant": F.when(top["n"] < 0, top["label"])})


