"""Reading inputs, schemas of appended columns and the choice of a broadcast."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A side is broadcast only when its counted rows prove that it stays below this.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def appended(docs: DataFrame, ddl: str) -> tuple[DataFrame, T.StructType]:
    """The input without columns that an operator makes itself, and the schema with those added.

    An input column that has the name of a made column is dropped, ``text`` is kept in its place.
    """
    made = T.StructType.fromDDL(ddl)
    names = {n.lower() for n in made.names}
    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in names])
    return kept, T.StructType([*kept.schema.fields, *made.fields])


def arrow(schema: T.StructType):
    return to_arrow_schema(schema)


def maybe_broadcast(small: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a stored table for broadcast when its row count proves it small; else the join shuffles."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


#: Rows of an Arrow batch at most, as texts are long: a batch is held by the executor and by its Python worker at once.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch where they are more; results never depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_for(total_bytes: int, limit: int) -> int:
    return max(1, math.ceil(total_bytes / limit))
