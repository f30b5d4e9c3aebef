"""Deterministic top-k, stratified samples, quotas and panels.

Random order is the MD5 of seed and key, so any engine and any partitioning picks the same
rows. Limits are these operators' feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: str) -> Column:
    """The order of a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """k rows of each key in the given order; Spark cuts to k per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def top_n(df: DataFrame, order: list[Column | str], n: int, exclude: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """n rows of all, without those whose keys `exclude` has."""
    rows = df if exclude is None else df.join(exclude.select(*keys).distinct(), keys, "left_anti")
    return rows.orderBy(*order).limit(n)


def stratified_sample(df: DataFrame, strata: list[str], ident: list[str], n: int, seed: int = 42, cap: int | None = None) -> DataFrame:
    """n rows of each stratum in a seeded order, then at most cap of all."""
    picked = top_k(df, strata, [draw(seed, *ident), *ident], n)
    return picked if cap is None else picked.orderBy(draw(f"{seed}cap", *ident), *ident).limit(cap)


def random_sample(df: DataFrame, ident: list[str], n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(seed, *ident), *ident).limit(n)


def bucket_samples(df: DataFrame, bucket: str, ident: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of each bucket, each bucket shuffled with a seed of its own."""
    return top_k(df, [bucket], [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(bucket).cast("string"), *(F.col(c).cast("string") for c in ident))), *ident], n)


def best_per_role(df: DataFrame, group: str, role: str, score: str, order: list[str], cap: int) -> DataFrame:
    """The best row of each role of a group, then the group's others by role, score and order, up to cap."""
    best = F.row_number().over(Window.partitionBy(group, role).orderBy(score, *order))
    ranked = df.withColumn("_best", F.when(best == 1, 0).otherwise(1))
    return top_k(ranked, [group], ["_best", role, score, *order], cap).drop("_best")


def quota_selection(df: DataFrame, group: str, quotas: DataFrame, order: list[Column | str], target: int) -> DataFrame:
    """Each group's first rows up to its quota, then the best others until target rows."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = df.join(quotas.select(group, F.col("quota").alias("_quota")), group, "left").withColumn("_rank", rank)
    ranked = ranked.withColumn("_extra", (F.col("_rank") > F.coalesce("_quota", F.lit(0))).cast("int"))
    return ranked.orderBy("_extra", *order, group).limit(target).drop("_quota", "_rank", "_extra")


def panel(targets: DataFrame, repo: str, stable: str, framework: str, k: int, size: int, reserve: int) -> DataFrame:
    """Repositories with k stable targets or more, by framework, stable count and name, as panel and then reserve."""
    by = targets.groupBy(repo, framework).agg(F.count_if(F.col(stable)).alias("stable_count")).where(F.col("stable_count") >= k)
    order = [F.col(framework), F.desc("stable_count"), F.col(repo)]
    rows = by.orderBy(*order).limit(size + reserve)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    return rows.withColumn("role", F.when(place <= size, "panel").otherwise("reserve"))


def stratified_quota(df: DataFrame, stratum: str, share: dict[str, int], size_bin: str, prefer: Column, ident: str, seed: int = 42) -> DataFrame:
    """Rows of each stratum up to its quota, taken in turn from the size bins, preferred rows first.

    Turns over bins shrink and pass on by themselves where a bin is short; a stratum that is
    short is filled up from what is left of the others.
    """
    turn = F.row_number().over(Window.partitionBy(stratum, size_bin).orderBy(F.when(prefer, 0).otherwise(1), draw(seed, ident), ident))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_turn", size_bin, ident))
    quota = F.lit(0)
    for k, v in share.items():
        quota = F.when(F.col(stratum) == k, v).otherwise(quota)
    ranked = df.withColumn("_turn", turn).withColumn("_place", place).withColumn("_extra", (F.col("_place") > quota).cast("int"))
    return ranked.orderBy("_extra", "_place", stratum, ident).limit(sum(share.values())).drop("_turn", "_place", "_extra")


def balanced_buckets(df: DataFrame, bucket: str, once: str, ident: str, per_bucket: int, must: Column, seed: int = 42) -> DataFrame:
    """Rows that must be in, then up to per_bucket of each bucket, one of each `once`."""
    first = F.row_number().over(Window.partitionBy(once).orderBy(F.when(must, 0).otherwise(1), draw(seed, ident), ident))
    single = df.withColumn("_must", must).withColumn("_one", first).where("_must or _one = 1")
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(F.when(F.col("_must"), 0).otherwise(1), draw(seed, ident), ident))
    return single.withColumn("_place", place).where(F.col("_must") | (F.col("_place") <= per_bucket)).drop("_must", "_one", "_place")


def union_samples(parts: dict[str, DataFrame], ident: list[str], cap: int) -> DataFrame:
    """Samples in order of their names' place, each row once under its first origin, at most cap."""
    rows = None
    for i, (name, df) in enumerate(parts.items()):
        part = df.withColumns({"origin": F.lit(name), "_at": F.lit(i)})
        rows = part if rows is None else rows.unionByName(part)
    once = F.row_number().over(Window.partitionBy(*ident).orderBy("_at"))
    return rows.withColumn("_once", once).where("_once = 1").orderBy("_at", *ident).limit(cap).drop("_at", "_once")


def weighted_score(weights: dict[str, float]) -> Column:
    """Weighted sum of columns; null counts as 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * weight
    return total


def pack_bins(df: DataFrame, ident: str, size: str, bins: int) -> DataFrame:
    """ident, size (long) and bin: each item, the largest first, goes to the bin that holds least.

    Ties go to the lesser ident and the lower bin; a null size counts as 0. Each choice
    depends on all before it, so one task sees the items, sorted, and holds the bins' loads
    alone: sum up to repositories or files first, of which there are few.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(0, k) for k in range(bins)]
        for batch in batches:
            into = []
            for n in batch[size].to_pylist():
                load, k = loads[0]
                heapreplace(loads, (load + n, k))
                into.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(into, pa.int32())], names=[*batch.schema.names, "bin"])

    items = df.select(ident, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))
    return items.repartition(1).sortWithinPartitions(F.desc(size), ident).mapInArrow(run, items.schema.add("bin", "integer"))
