"""Files as sources and sinks: JSON lines, CSV, folders of task documents, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.durable import path_exists

TASK = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("candidate_category", T.StringType()),
        T.StructField("candidate_list", T.ArrayType(T.StringType())),
        T.StructField("loc", T.ArrayType(T.DoubleType())),
    ]
)


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """One object per line under a declared schema; blank lines are skipped, broken ones give NULLs."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(paths if isinstance(paths, str) else list(paths))


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """CSV with a header, several files as one table; empty and unreadable cells are NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths if isinstance(paths, str) else list(paths))


def require_files(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raise with the list of those that are missing."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_tasks(spark: SparkSession, tasks: str, truths: str) -> DataFrame:
    """(task_no, type, user_id, target, candidates, loc): task documents with their ground truth.

    Both folders hold one document a file, ``task_<n>.json`` and
    ``groundtruth_<n>.json``; they are joined by that number, so gaps on either
    side shift nothing. A task without ground truth is left out. A simulation
    task has its item as the only candidate and target.
    """
    number = lambda name: F.regexp_extract(F.col("_metadata.file_name"), rf"{name}_(\d+)\.json$", 1).try_cast("int")
    task = spark.read.schema(TASK).option("multiLine", True).json(f"{tasks}/task_*.json").withColumn("task_no", number("task"))
    truth = spark.read.schema("`ground truth` string, ground_truth string, stars double, review string").option("multiLine", True).json(f"{truths}/groundtruth_*.json").withColumn("task_no", number("groundtruth"))
    truth = truth.select("task_no", F.coalesce("ground truth", "ground_truth").alias("truth"), "stars", "review")
    simulated = F.col("type") == "user_behavior_simulation"
    return task.join(truth, "task_no").select(
        "task_no", "type", "user_id", F.when(simulated, F.col("item_id")).otherwise(F.col("truth")).alias("target"),
        F.when(simulated, F.array("item_id")).otherwise(F.col("candidate_list")).alias("candidates"), "loc", "stars", "review",
    )


def write_tasks(df: DataFrame, path: str) -> None:
    """Task rows as JSON lines, one folder per source; a rerun replaces what it wrote before."""
    df.write.mode("overwrite").partitionBy("source").json(path)


def first_existing_path(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first path that exists, for results whose names changed over time."""
    return next((p for p in paths if path_exists(spark, p)), None)


def update_by_key(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the values of ``changes`` (``keys`` unique in it) where a row is given one; no row is lost."""
    values = [c for c in changes.columns if c not in keys]
    new = changes.withColumnsRenamed({c: f"__ll_{c}" for c in values})
    joined = table.join(new, list(keys), "left")
    return joined.select(*(F.coalesce(f"__ll_{c}", c).alias(c) if c in values else F.col(c) for c in table.columns))


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction records as JSON lines, a folder per run (column ``run``, its file name): what ``read_predictions`` reads."""
    df.select("run", "run_index", "groundtruth", "output", "error").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("run").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(run_index, groundtruth, output, error, run); the target stands under either of its two names."""
    schema = "run_index bigint, groundtruth struct<`ground truth`: string, ground_truth: string>, output array<string>, error string, run string"
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("groundtruth", F.coalesce(F.col("groundtruth.`ground truth`"), F.col("groundtruth.ground_truth")))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; NULL is the empty cell."""
    df.write.mode("overwrite").option("header", True).csv(path)
