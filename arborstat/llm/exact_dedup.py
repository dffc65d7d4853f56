"""Exact deduplication as a stream with keyed state on disk that never expires.

Texts are equal when identical without white space. The state, in RocksDB, holds for each digest
of such a text the row that stays (code points, stable identifier doc_id, content locator: file and place
in it) and the number of rows; it takes no event time and so drops nothing. With a `folder` a later
call goes on from the state that earlier arrivals left there.
Each micro-batch is summed before it is dealt out, so a hot text reaches the state as a row a task.
A hit on a digest is not believed: the full texts of every digest with two rows or more are
read at the rows' locators, of this arrival and earlier ones, and compared; digests that stand for
different texts are resolved by the texts themselves. Beyond BROADCAST_HITS rows of hits the read is a
shuffle join, before which Spark filters the texts by a Bloom filter of the hits. DataFrame operations only.

Of equal texts the row with the most code points stays, then the smallest doc_id, then the first locator.

Defined results: null text is empty; all empty and white-space texts are equal; a repeated row is
a member of its group and one of it stays at most; a null doc_id loses every tie; an empty table
gives no rows; further columns are ignored, and kept by `without_copies` whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ROW_GROUP, discard, new_path, release, written

SPACES = " \t\n\x0b\x0c\r"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Stores are closed when a task has committed, so an executor's disk holds few at a time, however many there are.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Spark's own filter of the large side of a join by the keys of the small one.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100g", "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "100000000", "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(1 << 30)}
#: Files of a micro-batch, at least, and micro-batches of a run, at most.
LEAST_FILES, MOST_BATCHES = 32, 4
#: Rows (locator and digest, some 200 bytes each) that are broadcast, at most; beyond it they are joined by a shuffle.
BROADCAST_HITS = 250_000
KEYS = "arrival string, doc_id long, digest binary, text_sha256 string, code_points int, _file string, _position long"
LOCATOR = ["_file", "_position"]


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def without_spaces(text: Column) -> Column:
    return reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), SPACES, text)


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def rows_of_files(docs: DataFrame) -> bool:
    """Whether each row of `docs` is a row of a file: nothing but selections and filters stand over one relation of files."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty() and bool(docs.inputFiles())


def located(docs: DataFrame) -> DataFrame:
    """`docs` with the locator of each row; rows that aren't each a file's own are written to the shared folder first."""
    locator = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_position")]
    if rows_of_files(docs):
        try:
            return docs.select("*", *locator)
        except AnalysisException:  # a format whose rows have no place
            pass
    return written(docs, "landed").select("*", *locator)


def contents(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, content, code_points) and the locator, from located rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), without_spaces(text).alias("content"), F.char_length(text).alias("code_points"), *LOCATOR)


def best_row() -> Column:
    """The row that stays, as the least of its group."""
    return F.min(F.struct((-F.col("code_points")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", *LOCATOR))


def updates(folder: str, files_per_batch: int, spark: SparkSession) -> str:
    """Run the stream over the key rows that it has not seen; the folder of the state's updates."""
    out = f"{folder}/updates"
    state = spark.readStream.schema(KEYS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/keys").groupBy("digest").agg(best_row().alias("best"), F.count("*").alias("group_size"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a batch that is run again replaces its own

    with settings(spark, ROCKSDB):
        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start()
        query.awaitTermination()
    return out


def read_at(rows: DataFrame, hits: DataFrame, few: bool) -> DataFrame:
    """(digest, arrival) and what `rows` hold, of the rows at the locators of `hits`."""
    return rows.join(F.broadcast(hits) if few else hits, LOCATOR).select("digest", "arrival", "doc_id", "content", "code_points", *LOCATOR)


def judged(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], folder: str | None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) and the locator of each of the located rows."""
    spark, folder, arrival = rows.sparkSession, folder or new_path(rows.sparkSession, "dedup"), uuid.uuid4().hex
    texts = contents(rows, id_col, text_col)
    found = texts.select(F.lit(arrival).alias("arrival"), "doc_id", digest(F.col("content")).alias("digest"), F.sha2("content", 256).alias("text_sha256"), "code_points", *LOCATOR)
    found.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/keys")
    every = spark.read.schema(KEYS).parquet(f"{folder}/keys")
    keys = every.where(F.col("arrival") == arrival)
    files = rows.inputFiles()
    if not files or keys.isEmpty():
        return keys.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *LOCATOR)
    # What later calls need to read these texts again: a row a file.
    spark.createDataFrame([(arrival, f, id_col, text_col) for f in files], "arrival string, file string, id_col string, text_col string").coalesce(1).write.mode("append").parquet(f"{folder}/sources")
    release(spark)
    out = updates(folder, max(LEAST_FILES, -(-len(every.inputFiles()) // MOST_BATCHES)), spark)
    # A digest's best row only falls and its number of rows only grows from one update to the next.
    state = written(spark.read.parquet(out).groupBy("digest").agg(F.min("best").alias("best"), F.max("group_size").alias("group_size")), "groups")
    release(spark)
    hits = written(every.join(state.where("group_size > 1").select("digest"), "digest", "left_semi").select("digest", "arrival", *LOCATOR), "hits")
    few, hits = hits.count() <= BROADCAST_HITS, hits.where("_position >= 0")
    sources = spark.read.parquet(f"{folder}/sources").where(F.col("arrival") != arrival).groupBy("id_col", "text_col").agg(F.collect_set("file").alias("files")).collect()  # files, not documents
    stores = [texts, *(contents(located(spark.read.parquet(*s["files"])), s["id_col"], s["text_col"]) for s in sources)]
    with settings(spark, {} if few else BLOOM):
        # Smallest and largest text of a digest: the same only if all its texts are. Summed before the shuffle.
        members = [read_at(s, hits, few) for s in stores]
        spans = reduce(DataFrame.unionByName, [m.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high")) for m in members])
        mixed = written(spans.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("digest"), "mixed")
        if mixed.isEmpty():
            discard(mixed)
            return resolved(keys.join(state, "digest"))
        split = written(reduce(DataFrame.unionByName, members).join(mixed, "digest", "left_semi").withColumn("text_sha256", F.sha2("content", 256)), "split")
    groups = split.groupBy("content").agg(best_row().alias("best"), F.count("*").alias("group_size"))
    return resolved(keys.join(state, "digest").join(mixed, "digest", "left_anti")).unionByName(resolved(split.where(F.col("arrival") == arrival).join(groups, "content")))


def resolved(members: DataFrame) -> DataFrame:
    kept = (F.col("_file") == F.col("best._file")) & (F.col("_position") == F.col("best._position"))
    return members.select(members["doc_id"], F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", *LOCATOR)


def stream_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest, folder: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of `docs`.

    folder: a shared folder with the state of earlier arrivals, if any, which count as members of the groups
    and whose files must still be there; a new one if None.
    """
    return judged(located(docs.select(id_col, text_col)), id_col, text_col, digest, folder).drop(*LOCATOR)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    rows = located(docs)
    gone = written(judged(rows, id_col, text_col, sha256_digest, None).where("not kept").select(*LOCATOR), "gone")
    few = gone.count() <= BROADCAST_HITS
    return rows.join(F.broadcast(gone) if few else gone, LOCATOR, "left_anti").drop(*LOCATOR)
