"""Tables that an operator writes on its way, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thresher.sources.tables import scratch_path

STAGED = "_staged_path"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the session's shared folder and read again.

    Cuts the lineage: a lost executor costs no more than the tasks it was running.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, STAGED, path)
    return out


def unstaged(df: DataFrame | None) -> None:
    """Deletes the files of a table from ``staged`` that nothing will read again."""
    path = getattr(df, STAGED, None)
    if path is None:
        return
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that no plan refers to any more."""
    spark.sparkContext._jvm.System.gc()
