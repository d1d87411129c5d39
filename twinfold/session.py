"""Session settings, and staging of intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, app: str = "twinfold", memory: str = "8g", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    own = {"spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='twinfold-')}"}
    for key, value in {**SETTINGS, **own, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_stage_root(spark: SparkSession) -> None:
    """Name a folder for intermediate data where the session names none and driver and executors are one process."""
    if not _named_root(spark) and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='twinfold-')}")


def _named_root(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; the setting is required.

    ``local_session`` and the driver's entry point set it for a session on one machine.
    """
    root = _named_root(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return root.rstrip("/")


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the written table.

    Used where a result feeds several later joins: the lineage is cut, nothing is computed twice, and a
    lost executor costs only a re-read.
    """
    return _written(df, label)[0]


class Held:
    """``stage`` for one unit of work, such as a micro-batch: ``release`` deletes what it wrote."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        table, path = _written(df, label)
        self._paths.append(path)
        return table

    def release(self) -> None:
        jvm = self._spark._jvm
        conf = self._spark._jsc.hadoopConfiguration()
        while self._paths:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop())
            path.getFileSystem(conf).delete(path, True)


#: How an intermediate table is kept: by ``stage``, or by a ``Held``.
Keep = Callable[[DataFrame, str], DataFrame]
