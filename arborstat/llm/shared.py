"""What the operators share: the shared folder, written tables and Arrow batch limits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborstat.tables import ROW_GROUP, discard, new_path, remove, shared_dir, written

__all__ = ["ROW_GROUP", "bounded_batches", "discard", "few_files", "join_ids", "map_batches", "new_path", "partitions", "release", "remove", "shared_dir", "written"]
#: Rows of one Arrow batch, and its bytes where the Spark version can bound them.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(rows, schema)


#: Rows of one file of a small table.
FILE_ROWS = 100_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of which no more than so many rows are known to come, in no more files than these fill."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS))) if rows < FILE_ROWS * partitions(df.sparkSession) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let go of what earlier steps left: the driver's plans, whose shuffle files Spark then deletes, and executors' garbage and buffers."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


#: Rows of ids that are broadcast, at most; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def join_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join with a written table of ids, broadcast only if its counted rows are few."""
    small = ids.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, df[on].eqNullSafe(ids[on]), how)
