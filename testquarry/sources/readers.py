"""Readers: JSON lines, CSV, Parquet, sidecars, source trees and result logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dedupe import keep_first, keep_last

_CODE = r"\.(js|jsx|ts|tsx|mjs|cjs)$"
_NAMED = r"\.(spec|test|cy|e2e)\.[a-z]+$"
_FOLDERS = r"(^|/)(__tests__|tests?|e2e|specs?|cypress|playwright|testcafe)/"
_IGNORED = r"(^|/)(node_modules|dist|build|coverage|\.git)(/|$)"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON lines by an explicit schema; blank lines are skipped. Bad lines raise, or are dropped where not strict."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).json(path, mode=mode)


def read_jsonl_reported(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and one row with the numbers of lines read and malformed."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", StructType.fromDDL(schema + ", _bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.agg(F.count("*").alias("lines"), F.count_if(bad).alias("malformed"))


def read_jsonl_where(spark: SparkSession, path: str | list[str], schema: str, contains: list[str]) -> DataFrame:
    """Rows of lines that contain one of the strings: lines are filtered before they are parsed."""
    test = F.lit(False)
    for s in contains:
        test = test | F.col("value").contains(s)
    return spark.read.text(path).where(test).select(F.from_json("value", StructType.fromDDL(schema)).alias("r")).where("r is not null").select("r.*")


def read_ordered(spark: SparkSession, path: str | list[str], schema: str, stage: int = 0) -> DataFrame:
    """JSON lines with seq, a struct that orders rows by stage, file, split and place in it.

    The order of lines is part of several operators' results; files carry no row number, so
    it is made where the file is read and kept from then on.
    """
    raw = spark.read.text(path).select(
        "value", F.struct(F.lit(stage).alias("stage"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq")
    )
    return raw.where("trim(value) <> ''").select(F.from_json("value", StructType.fromDDL(schema), {"mode": "FAILFAST"}).alias("r"), "seq").select("r.*", "seq")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header, all columns strings; a byte-order mark is taken off the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: .csv, .json (one document a file), .jsonl, .orc or .parquet."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix == "jsonl":
        return read_jsonl(spark, path, schema) if schema else spark.read.json(path)
    if suffix == "json":
        return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True, mode="DROPMALFORMED")
    if suffix in ("parquet", "orc"):
        return getattr(spark.read, suffix)(path)
    raise ValueError(f"no reader for .{suffix}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_source(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists: a merged file, else sidecars, else direct features."""
    return next((p for p in paths if exists(spark, p)), None)


def read_sidecars(spark: SparkSession, folder: str, suffix: str, schema: str) -> DataFrame:
    """Per-repository files of a folder, with the file each row came from."""
    return read_jsonl(spark, f"{folder}/*{suffix}", schema).withColumn("sidecar", F.col("_metadata.file_name"))


def with_fallback(sidecars: DataFrame, root: DataFrame, key: str = "repo") -> DataFrame:
    """Sidecar rows, and root rows of the keys that have none."""
    return sidecars.unionByName(root.join(sidecars.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def load_tests(tests: DataFrame, order: str) -> DataFrame:
    """Test cases with trimmed ids, the last row of a key."""
    trimmed = tests.withColumns({c: F.trim(c) for c in ("repo", "test_id")}).where("repo <> '' and test_id <> ''")
    return keep_last(trimmed, ["repo", "test_id"], order)


def load_keyed(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """The first row of a key, some columns."""
    return keep_first(df.select(*keys, *columns, *(c for c in order if c not in keys and c not in columns)), keys, order).select(*keys, *columns)


def load_static_metrics(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Metrics by (repo, test_id), the last row of a key, and one row of rows, malformed and duplicates."""
    keyed = df.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("repo", "test_id")})
    good = (F.col("repo") != "") & (F.col("test_id") != "")
    report = keyed.agg(
        F.count("*").alias("rows"), F.count_if(~good).alias("malformed"),
        (F.count_if(good) - F.count_distinct(F.when(good, F.struct("repo", "test_id")))).alias("duplicates"),
    )
    return keep_last(keyed.where(good), ["repo", "test_id"], order), report


def read_tree(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path and text of the files below a folder, ignored folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.where(~F.col("path").rlike(_IGNORED)).select("path", F.decode("content", "UTF-8").alias("text"))


def is_test_file(path: Column) -> Column:
    """Source files named or placed like tests."""
    low = F.lower(path)
    return low.rlike(_CODE) & (low.rlike(_NAMED) | low.rlike(_FOLDERS))


def tree_hash(files: DataFrame, key: str) -> DataFrame:
    """key and a hash of its files' paths and contents, whatever their order."""
    rows = F.array_sort(F.collect_list(F.struct("path", F.sha2("text", 256).alias("sha"))))
    return files.groupBy(key).agg(F.sha2(F.to_json(rows), 256).alias("tree_hash"))


def last_result(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, the last record that has a cost, turns or a duration, and the number of invalid lines.

    lines: keys, order and value, a line of a log.
    """
    schema = "cost double, turns long, duration double"
    rec = F.from_json("value", schema)
    rows = lines.where("trim(value) <> ''").withColumn("_r", rec).withColumn("_ok", F.expr("try_parse_json(value) is not null"))
    has = F.col("_r.cost").isNotNull() | F.col("_r.turns").isNotNull() | F.col("_r.duration").isNotNull()
    return rows.groupBy(*keys).agg(F.max_by(F.when(has, F.col("_r")), F.when(has, F.col(order))).alias("r"), F.count_if(~F.col("_ok")).alias("invalid")).select(*keys, "r.*", "invalid")
