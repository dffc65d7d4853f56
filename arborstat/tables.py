"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a Parquet row group, which a task holds whole while it writes.
ROW_GROUP = 16 << 20


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share, as `spark.checkpoint.dir` names it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):  # driver and executor are one process
        return f"file://{tempfile.gettempdir()}/checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table: read again without its lineage, and kept when an executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete `written` tables that no later step and no result reads."""
    for table in tables:
        remove(table.sparkSession, table._written_at)
