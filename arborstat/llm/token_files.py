"""Token ids in Arrow stream-file format: fixed-size-list batches of equal-length sequences and masks.

Documents go to parts by ranges of doc_id and stand in that order; a part's file holds their ids
on end, cut into sequences of equal length; the mask, a bit an id, is 0 where the last sequence is padded.
Each batch but the last has the same number of sequences, so sequence k is row k mod R of batch
k div R: a memory map gives the ids as an array and the mask as an Arrow bitmap, views without copying. A second file gives the documents' ends.
Files are renamed into place when whole, so a task that is run again replaces its own.

Defined results: null text is empty, and an empty document is the end id alone; rows with equal
doc_id stand in the order of their texts; a null doc_id comes first; an empty table writes no file
and reads back as no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import map_batches, new_path, partitions, written
from .tokens import text_ids

#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH_SEQUENCES = 2048, 256
#: Documents whose ids are put into the file in one go.
SOME = 100
MANIFEST = "part int, file string, tokens long, docs long"
INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Takes ids in any amounts and writes whole batches of sequences."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer, self.held, self.n, self.total = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def put(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.length * BATCH_SEQUENCES:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids, whole = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype), self.length * BATCH_SEQUENCES
        stop = len(ids) if last else len(ids) // whole * whole
        for at in range(0, stop, whole):
            part = ids[at : min(at + whole, stop)]
            mask = np.ones(-(-len(part) // self.length) * self.length, bool)
            mask[len(part) :] = False
            padded = np.zeros(len(mask), self.dtype)
            padded[: len(part)] = part
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held, self.n = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self.flush(True)
        self.writer.close()


class SequenceFile:
    """Random access to a file's sequences by views of its memory map."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batches = self.file.num_record_batches
        last = self.file.get_batch(self.batches - 1).num_rows if self.batches else 0
        self.sequences = max(self.batches - 1, 0) * BATCH_SEQUENCES + last

    def flat(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def get(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence k, as views."""
        if not 0 <= k < self.sequences:
            raise IndexError(k)
        batch, row = divmod(k, BATCH_SEQUENCES)
        return self.flat(batch)[row * self.length : (row + 1) * self.length], self.file.get_batch(batch).column(1).values.slice(row * self.length, self.length)


def write_files(docs: DataFrame, path: str, end_id: int, folder: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files under `folder`; the written manifest: part, file, tokens, docs."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encoder = text_ids(path)
        end = np.array([end_id], "<u4").tobytes()
        dtype = np.dtype("<u2") if max(encoder.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        context = TaskContext.get()
        part = context.partitionId()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, attempt = f"{base}/part-{part:06d}", f".{context.taskAttemptId()}.tmp"
        ends: list[int] = []
        keys: list[pa.Array] = []
        with fs.open_output_stream(f"{name}.arrow{attempt}") as sink:
            out = SequenceWriter(sink, length, dtype)

            def take(batch: pa.RecordBatch) -> None:
                keys.append(batch.column(0))
                for at in range(0, batch.num_rows, SOME):
                    held = [encoder.encode_bytes(text or "") + end for text in batch.column(1).slice(at, SOME).to_pylist()]
                    out.put(np.frombuffer(b"".join(held), "<u4"))
                    ends.extend(len(h) // 4 for h in held)

            take(first)
            for batch in batches:
                take(batch)
            out.close()
        with fs.open_output_stream(f"{name}.index{attempt}") as sink, pa.ipc.new_file(sink, INDEX) as index:
            index.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(ends, pa.int64())], schema=INDEX))
        for kind in ("arrow", "index"):
            fs.move(f"{name}.{kind}{attempt}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}"]), pa.array([out.total], pa.int64()), pa.array([len(ends)], pa.int64())], ["part", "file", "tokens", "docs"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = slim.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(map_batches(ordered, rows, MANIFEST), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files that the manifest lists.

    The prefix sum runs over the manifest, a row for each part, never over documents.
    """
    placed = manifest.withColumn("before", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, base = filesystem(file)
                opened = pa.memory_map if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
                with opened(f"{base}.index") as index, opened(f"{base}.arrow") as ids:
                    docs = pa.ipc.open_file(index).read_all().combine_chunks()
                    counts = docs.column("n_tokens").to_numpy()
                    held = SequenceFile(ids)
                    crcs, crc, at, doc, left = np.zeros(len(counts), np.int64), 0, 0, 0, int(counts[0])
                    for k in range(held.batches):
                        flat = held.flat(k).astype("<u4")
                        at = 0
                        while doc < len(counts) and at < len(flat):
                            took = min(left, len(flat) - at)
                            crc = zlib.crc32(flat[at : at + took], crc)
                            at, left = at + took, left - took
                            if not left:
                                crcs[doc], crc, doc = crc, 0, doc + 1
                                left = int(counts[doc]) if doc < len(counts) else 0
                    starts = before + np.cumsum(counts) - counts
                    for cut in range(0, len(counts), 10_000):
                        piece = slice(cut, cut + 10_000)
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks().slice(cut, 10_000) if isinstance(docs.column("doc_id"), pa.ChunkedArray) else docs.column("doc_id").slice(cut, 10_000), pa.array(starts[piece], pa.int64()), pa.array(counts[piece], pa.int64()), pa.array(crcs[piece], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A table of its own, dealt out by part: one file a task.
    spread = written(placed, "placed").repartitionByRange(partitions(manifest.sparkSession), "part").select("file", "before")
    return map_batches(spread, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write `docs` as files and read each document's ids back from them."""
    return read_files(write_files(docs, path, end_id, folder or new_path(spark, "ids")))


def sequence_paths(folder: str) -> list[str]:
    """The finished sequence files of a folder on this machine, in order."""
    _, base = filesystem(folder)
    return sorted(f"{base}/{f}" for f in os.listdir(base) if f.endswith(".arrow"))
