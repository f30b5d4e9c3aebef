"""Sinks: CSV, JSON lines, bucketed Parquet, one-row summaries, bundles and the decision table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as CSV text: missing ones and nulls blank, nested ones as JSON."""
    have, out = dict(df.dtypes), []
    for c in columns:
        if c not in have:
            out.append(F.lit("").alias(c))
        elif have[c].startswith(("array", "map", "struct")):
            out.append(F.coalesce(F.to_json(c), F.lit("")).alias(c))
        else:
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None, one_file: bool = False) -> None:
    """CSV of fixed columns; a header even without rows.

    one_file is for reports: it sorts and writes in one task. Event tables stay in parts.
    """
    out = _text(df, columns or df.columns)
    if order:
        out = out.orderBy(*order)
    if one_file or out.isEmpty():
        out = out.coalesce(1)
    out.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"', emptyValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; lone surrogates can't be in Spark strings, so nothing is scrubbed."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_by_repo(df: DataFrame, path: str, key: str = "repo", buckets: int = 64) -> None:
    """Parquet in folders of a hash of the key, so that later reads of some keys prune files.

    Rows are dealt by bucket and a salt, so one key with most rows is written by many tasks.
    """
    bucketed = df.withColumn("repo_bucket", F.pmod(F.hash(key), F.lit(buckets)))
    bucketed.repartition("repo_bucket", (F.rand(7) * 8).cast("int")).write.mode("overwrite").partitionBy("repo_bucket").parquet(path)


def summary_json(df: DataFrame) -> str:
    """A one-row table as a JSON object."""
    row = df.toJSON().first() if hasattr(df, "toJSON") else None
    return row or "{}"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def register_views(tables: dict[str, DataFrame], aliases: dict[str, str]) -> None:
    """Tables under their names and older names as views, without copies."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for alias, name in aliases.items():
        tables[name].createOrReplaceTempView(alias)


def write_bundle(tables: dict[str, DataFrame], path: str, title: str) -> dict:
    """Review tables as CSV with a manifest of their rows; tables without rows have a header."""
    counts = {}
    for name, df in tables.items():
        write_csv(df, f"{path}/csv/{name}", one_file=True)
        counts[name] = df.count()
    manifest = {"title": title, "tables": counts}
    some = next(iter(tables.values()), None)
    if some is not None:
        write_text(some.sparkSession, json.dumps(manifest, sort_keys=True), f"{path}/manifest")
    return manifest


def look_up_decisions(requests: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("model", "prompt_version", "input_hash")) -> tuple[DataFrame, DataFrame]:
    """Requests with their cached decision, and those without one."""
    cached = decisions.dropDuplicates(list(keys))
    return requests.join(cached, list(keys)), requests.join(cached.select(*keys), list(keys), "left_anti")


def decide(requests: DataFrame, provider, schema: str, batch: int = 64) -> DataFrame:
    """Decisions of a provider, a function from a list of rows to a list of rows, in batches.

    The provider is given by the caller; nothing here reaches a network.
    """

    def run(batches):
        import pandas as pd

        for frame in batches:
            for i in range(0, len(frame), batch):
                yield pd.DataFrame(provider(frame.iloc[i : i + batch].to_dict("records")))

    return requests.mapInPandas(run, schema)
