"""Packing into sequences by first-fit decreasing, in randomised groups of documents.

Each document is cut into full sequences and a rest; whole documents are dealt to groups, and a group
packs its documents' pieces on its own, so that no task sees more than a group. Within a group pieces come in order of falling length;
a tournament tree over the bins' free room finds the first bin that holds a piece.

Defined results: null text is empty, and an empty document is the end id alone; ties in length
go by doc_id and start; a repeated row is packed again; an empty table gives no rows; a null
doc_id is packed like any other; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches
from .tokens import KEPT, text_ids

#: Documents of a group, on average. Padding falls with it, a task's work grows with it.
GROUP_DOCUMENTS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
KINDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32"]


class FirstFit:
    """Bins of equal capacity; put(size) gives (bin, offset) of the first bin with room."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.capacity = capacity
        self.room = [capacity] * (2 * self.leaves)  # a node holds the most room below it

    def put(self, size: int) -> tuple[int, int]:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        out = at - self.leaves, self.capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return out


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; `lengths` fall and none is over `capacity`."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int(np.searchsorted(-lengths, -capacity, side="right"))
    bins[:full] = np.arange(full)
    tree = FirstFit(len(lengths) - full, capacity)
    for i, size in enumerate(lengths[full:].tolist(), full):
        at, offsets[i] = tree.put(size)
        bins[i] = full + at
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """A row for each piece of at most `capacity` ids of each document, its end id included; doc_crc32 is of all its ids."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = text_ids(path, kept)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list[int | None]] = [[] for _ in KINDS]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = ids.encode_bytes(text or "") + end
                total, whole = len(raw) // 4, zlib.crc32(raw)
                for start in range(0, total, capacity):
                    piece = raw[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), total, whole), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], KINDS)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(slim, rows, PIECES + ", doc_crc32 long")


def pack_pieces(pieces: DataFrame, n_documents: int, capacity: int, seed: int = 11) -> DataFrame:
    """`pieces` with sequence_id and offset. A sequence's id is its group's number times 2^32 plus its bin."""
    groups = max(1, round(n_documents / GROUP_DOCUMENTS))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_crc32"), F.lit(groups))).drop("doc_crc32")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["group"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="group")

    return dealt.groupBy("group").applyInPandas(pack, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece. kept: words whose ids a worker keeps."""
    return pack_pieces(token_pieces(docs, path, capacity, end_id, id_col, text_col, kept), docs.count(), capacity)
