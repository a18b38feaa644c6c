"""Tables in the folder that all executors share, and joins whose broadcast is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows take at most this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and there is but one machine, as in tests."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docpipe-"))
    return context.getCheckpointDir()


def batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Sets how many bytes of rows are handed to Python at once, for this session: texts are long, and 10,000 of them take much of an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from Parquet in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it fits, else as it is, to be joined by a shuffle. df should be written()."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df
