"""Session settings and the lineage cut used by the iterative jobs."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rasters whose decoded blocks stay below this size may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "ridgecast", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stored_folder(spark: SparkSession) -> str:
    """A new folder, shared by all executors, for one intermediate table.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``; only where that is
    unset, as in tests, below the session's warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/intermediate"
    return f"{folder.rstrip('/')}/ridgecast-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Stores a table and reads it back, so a lost executor never sends a loop back to round one.

    Unlike a checkpointed plan, whose size estimates multiply from join to join, a stored table has
    its true size, so each round of a loop is planned from facts and small tables are broadcast
    on their own.
    """
    spark = df.sparkSession
    path = stored_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """``cut_lineage``, and how many rows meet a condition, counted while they are written.

    A plan that is known to be empty has nothing to observe; then the stored table is asked.
    """
    seen = Observation()
    stored = cut_lineage(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    try:
        return stored, seen.get["n"]
    except Py4JJavaError:
        return stored, stored.filter(condition).count()


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``cut_lineage`` stored, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/ridgecast-" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
