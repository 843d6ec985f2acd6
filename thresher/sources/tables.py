"""Reading and writing tables: datasets, rules and evaluation results."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from thresher.operators.prepare import preprocess
from thresher.operators.ranking import (benchmark_report, best_per_category, best_per_model,
                                        flatten_summary)
from thresher.operators.rules import RULE_SCHEMA
from thresher.session import cut_lineage, ensure_checkpoint_dir

FORMATS = ("csv", "json", "parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p)) if any(c in path for c in "*?[{") else fs.exists(p)


def load_data(spark: SparkSession, path: str, file_type: str | None = None,
              schema: str | T.StructType | None = None, **options) -> DataFrame:
    """A table from csv, json or parquet; the type comes from the suffix unless given.

    Give CSV and JSON a schema: without one Spark reads the data once more to infer it.
    """
    file_type = (file_type or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if file_type not in FORMATS:
        raise ValueError(f"unsupported file type: {file_type!r}")
    reader = spark.read.format(file_type)
    if file_type == "csv":
        options = {"header": True, "escape": '"', "multiLine": True, **options}
        if schema is None:
            options.setdefault("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def open_dataset(spark: SparkSession, data: DataFrame | None = None, path: str | None = None,
                 default_path: str | None = None, label: str | None = None,
                 handle_missing: str = "drop", **options) -> DataFrame:
    """A cleaned table from a frame, else a path, else the default path."""
    if data is None:
        if not (path or default_path):
            raise ValueError("no data source specified")
        data = load_data(spark, path or default_path, **options)
    return preprocess(data, handle_missing, label=label)


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error",
           partition_by: Sequence[str] = ()) -> None:
    """Writes a table; an unknown format is an error."""
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_rules(rules: DataFrame, path: str, mode: str = "error") -> None:
    rules.write.mode(mode).json(path)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_SCHEMA).json(path)


SCORES_SCHEMA = ("model string, model_ord int, size string, size_ord int, score double, "
                 "level string")


def save_results(scores: DataFrame, path: str, mode: str = "error") -> None:
    """Scores by level, the flattened summary and the text report under one folder."""
    scores = cut_lineage(scores)        # one row per cell, read a dozen times below
    export(scores, f"{path}/scores", "csv", mode, ["level"])
    export(flatten_summary(scores), f"{path}/benchmark_summary", "csv", mode)
    lines = benchmark_report(scores).orderBy("line_no").select("line")
    lines.coalesce(1).write.mode(mode).text(f"{path}/evaluation_report")  # a few dozen lines


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """The scores written by ``save_results``."""
    if not _exists(spark, f"{path}/scores"):
        raise FileNotFoundError(path)
    return load_data(spark, f"{path}/scores", "csv", SCORES_SCHEMA)


def export_tables(scores: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> list[str]:
    """One folder per table: scores of each level, performance, best models, summary."""
    scores = cut_lineage(scores)
    tables = {"level_scores": scores, "performance_summary": best_per_model(scores),
              "best_models": best_per_category(scores),
              "benchmark_summary": flatten_summary(scores)}
    for name, df in tables.items():
        export(df, f"{path}/{name}", fmt, mode,
               ["level"] if name == "level_scores" else ())
    return list(tables)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
