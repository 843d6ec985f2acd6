"""Session construction and lineage cutting."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "thresher",
                  shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine. On a cluster the caller brings a session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own:
    on a cluster a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="thresher-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, with a short plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Lets Spark drop broadcasts, shuffles and cached rows that nothing refers to any more, and the JVM its free heap."""
    spark.sparkContext._jvm.System.gc()


def in_task(spark: SparkSession, function: Callable, *arguments):
    """``function(*arguments)``, evaluated in one task.

    For the algebra of small matrices: tasks run it on one thread, while the threads of a linear
    algebra library may be lost where the driver started the JVM, and never answer.
    """
    sent = spark.sparkContext.broadcast(arguments)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"out": [pickle.dumps(function(*sent.value))]})
    found = spark.range(0, 1, 1, 1).mapInArrow(run, "out binary").first()["out"]
    sent.unpersist()
    return pickle.loads(found)
