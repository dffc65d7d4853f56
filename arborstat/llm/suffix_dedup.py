"""Removal of passages that repeat: every byte of a string of `size` bytes that also starts earlier.

Anchors bring equal strings together without sorting every suffix of the corpus: the anchor of a
string is its smallest-hashed substring of two fifths of its size, the leftmost of such. Equal strings have
the same anchor at the same place. A document is cut into runs of strings with one anchor; a run
and its bytes make a context (some 130 bytes), and a string stands in one context only.

Contexts with equal anchor and equal bytes are copies: all but the earliest are covered whole. Bytes
are told apart by the 128 bits of BLAKE2b that a context has of its own; the anchor's hash only groups, and
grams that collide in it meet as different contexts. What is left, anchors with different contexts, is where repeated passages
begin, end or differ. These contexts go, by anchor, into blocks of bounded size, for each of which
the collection's Burrows-Wheeler transform and common prefixes are built column by column (`bwt`);
rows with a common prefix of `size` bytes are equal strings. Anchors with more contexts than a block
holds are resolved exactly by hashes of all their strings, summed before they are dealt out.

Copies within an Arrow batch are found before the shuffle, so a hot passage is dealt as a row a batch.

Defined results: null text is empty; texts shorter than `size` lose nothing; documents are ordered by
doc_id, and where ids are null or repeat, by doc_id (null first) and text, a repeated row being a later
document; an empty table gives no rows; further columns are ignored. Removed runs are bytes: a cut inside a
letter leaves an incomplete letter, which `kept` holds as it is. A `size` outside 5 to 6,000 is a ValueError,
and so is a column to keep that has the name of a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_starts
from .shared import discard, join_ids, map_batches, partitions, release, written

U = np.uint64
#: Contexts of an anchor that is resolved in one block, at most twice; contexts from which a block ends with an anchor.
BLOCK, FILL = 4096, 512
#: Bytes that are hashed in one go: a worker holds some hundred bytes for each.
PIECE = 256 << 10
#: Sizes of a passage for which span and place of a packed run fit their bits.
SIZES = range(5, 6001)
RESULTS = ("doc", "doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "found")
#: Of a packed run: its first string's start, the strings after it, the anchor's place in it, covered already.
START, SPAN, COVERED = 24, 12, 1 << 62
ROWS = "anchor long, context long, check long, doc long, run long"
NAMES = ["anchor", "context", "check", "doc", "run"]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Hasher:
    """Hashes of all substrings of one size, and of any, of a piece of bytes."""

    def __init__(self, most: int):
        letters = np.arange(256, dtype=U)
        self.letters = scrambled(letters * U(0x9E3779B97F4A7C15) + U(0x1F83D9ABFB41BD6B)) | U(1)
        base = 0x9E3779B97F4A7C15
        self.up = np.cumprod(np.concatenate([[U(1)], np.full(most, base, U)]))
        self.down = np.cumprod(np.concatenate([[U(1)], np.full(most, pow(base, -1, 1 << 64), U)]))

    def read(self, data: np.ndarray) -> None:
        self.sums = np.concatenate([[U(0)], np.cumsum(self.letters[data] * self.up[: len(data)])])

    def each(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return scrambled((self.sums[size:] - self.sums[:n]) * self.down[:n])


def anchor_runs(hasher: Hasher, data: bytes, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor, of texts that stand on end: first and last start, anchor, its hash, the context's two words."""
    raw = np.frombuffer(data, np.uint8)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) + (np.zeros(0, np.int64),) * 2
    if len(raw) < size:
        return none
    half = size * 2 // 5
    hasher.read(raw)
    grams = hasher.each(half)
    keyed = (grams >> U(24) << U(24)) | np.arange(len(grams), dtype=U)  # the leftmost of equals is least
    window, reach, low = size - half + 1, 1, keyed
    while reach * 2 <= window:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    count = len(keyed) - window + 1
    low = np.minimum(low[:count], low[window - reach : window - reach + count])
    inside = np.zeros(len(raw) + 1, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= size
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - size + 1, -1)
    first = np.flatnonzero(np.cumsum(inside)[:count] > 0)
    if not len(first):
        return none
    anchor = (low[first] & U(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(first), bool)
    # Strings of two documents never follow each other: the last of the first ends where the second begins.
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    begins = np.flatnonzero(new)
    last = first[np.append(begins[1:], len(first)) - 1]
    first, anchor = first[begins], anchor[begins]
    digests = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + size).tolist(), strict=True)])
    context = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return first, last, anchor, scrambled(grams[anchor]), context[:, 0], context[:, 1]


def packed_run(start: np.ndarray, span: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (start << START) | (span << SPAN) | before


def run_start(run: np.ndarray) -> np.ndarray:
    return (run & (COVERED - 1)) >> START


def run_span(run: np.ndarray) -> np.ndarray:
    return (run >> SPAN) & 0xFFF


def context_rows(docs: DataFrame, size: int) -> DataFrame:
    """ROWS of every context; copies of one in the same batch are marked covered and dealt anywhere."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE + size)
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            held: list[bytes] = []
            owners: list[tuple[int, int]] = []

            def flush() -> None:
                ends = np.cumsum([len(x) for x in held])
                first, last, anchor, gram, context, check = anchor_runs(hasher, b"".join(held), ends, size)
                which = np.searchsorted(ends, first, side="right")
                doc, base = np.array([o[0] for o in owners], np.int64)[which], np.array([o[1] for o in owners], np.int64)[which]
                begin = np.concatenate([[0], ends[:-1]])[which]
                parts.append((gram.view(np.int64), context, check, doc, packed_run(first - begin + base, last - first, anchor - first)))
                held.clear()
                owners.clear()

            total = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                # A very long text goes in pieces that share size - 1 bytes, so each string is in one piece.
                for at in range(0, max(len(raw) - size + 1, 0), PIECE):
                    piece = raw[at : at + PIECE + size - 1]
                    if held and total + len(piece) > PIECE:
                        flush()
                        total = 0
                    held.append(piece)
                    owners.append((doc, at))
                    total += len(piece)
            if held:
                flush()
            if not parts:
                continue
            anchor, context, check, doc, run = (np.concatenate([p[i] for p in parts]) for i in range(5))
            order = np.lexsort((run, doc, check, context, anchor))
            anchor, context, check, doc, run = (x[order] for x in (anchor, context, check, doc, run))
            copy = np.zeros(len(anchor), bool)
            copy[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1]) & (check[1:] == check[:-1])
            spread = scrambled(doc.view(U) * U(0x9E3779B97F4A7C15) + run.view(U)).view(np.int64)
            anchor, run = np.where(copy, spread, anchor), np.where(copy, run | COVERED, run)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, context, check, doc, run)], NAMES)

    return map_batches(docs, rows, ROWS)


def sorted_copies(contexts: DataFrame) -> DataFrame:
    """(anchor, doc, run, open): contexts whose anchor has others (true) and copies of an earlier one (false).

    Sorted rows stream past; the last row and the last distinct context are all that is held.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        held: list[np.ndarray] | None = None  # the last distinct context, as NAMES
        told = False  # it has been passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(5)]
            anchor, context, check, doc, run = columns
            done = (run & COVERED) != 0
            fresh = np.ones(len(anchor), bool)
            live = np.flatnonzero(~done)
            if len(live):
                a, c, d = anchor[live], context[live], check[live]
                new = np.ones(len(live), bool)
                new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
                new[0] = last is None or (a[0], c[0], d[0]) != last
                last = (a[-1], c[-1], d[-1])
                fresh[live] = new
            copies = done | ~fresh
            reps = [x[~copies] for x in columns]
            if held is not None:
                reps = [np.concatenate([h, x]) for h, x in zip(held, reps, strict=True)]
            if len(reps[0]):
                same = reps[0][1:] == reps[0][:-1]
                is_open = np.concatenate([same, [False]]) | np.concatenate([[False], same])
                if held is not None and told:
                    is_open[0] = False
                    told_now = len(reps[0]) == 1
                else:
                    told_now = False
                held, told = [x[-1:] for x in reps], bool(is_open[-1]) or told_now
                out = [np.concatenate([x[copies], r[is_open]]) for x, r in zip(columns, reps, strict=True)]
            else:
                out, is_open = [x[copies] for x in columns], np.zeros(0, bool)
            flags = np.concatenate([np.zeros(int(copies.sum()), bool), np.ones(int(is_open.sum()), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[3]), pa.array(out[4]), pa.array(flags)], ["anchor", "doc", "run", "open"])

    dealt = contexts.repartition(partitions(contexts.sparkSession), "anchor").sortWithinPartitions("anchor", "context", "check", "doc", "run")
    return map_batches(dealt, rows, "anchor long, doc long, run long, open boolean")


def context_bytes(docs: DataFrame, open_rows: DataFrame, size: int) -> DataFrame:
    """(anchor, doc, run, bytes) of contexts."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                for item in found:
                    start, span = run_start(item["run"]), run_span(item["run"])
                    for column, value in zip(out, (item["anchor"], doc, item["run"], raw[start : start + span + size]), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "doc", "run", "bytes"])

    per_doc = open_rows.groupBy("doc").agg(F.collect_list(F.struct("anchor", "run")).alias("found"))  # at most a document's own
    ids = written(open_rows.select("doc").distinct(), "ids")
    both = join_ids(docs, ids, "doc", "left_semi").join(per_doc, "doc").select("doc", "text", "found")
    return map_batches(both, rows, "anchor long, doc long, run long, bytes binary")


def covered_runs(doc: np.ndarray, start: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, stop) of the bytes under strings that are not the earliest of their group."""
    order = np.lexsort((start, doc, group))
    doc, start, group = doc[order], start[order], group[order]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    doc, start = doc[later], start[later]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + size)
    begins = np.flatnonzero(new)
    last = start[np.append(begins[1:], len(doc)) - 1] if len(begins) else start[:0]
    return doc[begins], start[begins], last + size


def block_repeats(contexts: DataFrame, size: int) -> DataFrame:
    """Covered (doc, first, stop) among contexts with the same anchor, block by block."""

    def resolve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        doc, run = whole.column("doc").to_numpy(), whole.column("run").to_numpy()
        who, start, group = repeated_starts(whole.column("bytes").to_pylist(), size)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in covered_runs(doc[who], run_start(run[who]) + start, group, size)], ["doc", "first", "stop"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                anchor = batch.column(0).to_numpy()
                if n < FILL:
                    take = min(batch.num_rows, FILL - n)
                else:  # to the end of the anchor that the block has reached
                    same = held[-1].column(0)[-1].as_py()
                    take = int(np.argmax(anchor != same)) if (anchor != same).any() else batch.num_rows
                    if take < batch.num_rows:
                        if take:
                            held.append(batch.slice(0, take))
                        yield resolve(held)
                        held, n, batch = [], 0, batch.slice(take)
                        continue
                held.append(batch.slice(0, take))
                n += take
                batch = batch.slice(take)
        if held:
            yield resolve(held)

    dealt = contexts.repartition(partitions(contexts.sparkSession), "anchor").sortWithinPartitions("anchor")
    return map_batches(dealt, rows, "doc long, first long, stop long")


def hashed_repeats(contexts: DataFrame, size: int) -> DataFrame:
    """The same for anchors with more contexts than a block holds: by hashes of all their strings."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc, run, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for at in range(len(raw) - size + 1):
                    for column, value in zip(out, (hashlib.blake2b(raw[at : at + size], digest_size=16).digest(), doc, run_start(run) + at), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["hash", "doc", "first"])

    strings = map_batches(contexts.select("anchor", "doc", "run", "bytes"), rows, "hash binary, doc long, first long")
    earliest = strings.groupBy("hash").agg(F.min(F.struct("doc", "first")).alias("earliest"))
    later = strings.join(earliest, "hash").where(F.struct("doc", "first") != F.col("earliest"))
    return later.select("doc", "first", (F.col("first") + size).alias("stop"))


def merged_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union as runs in order, none touching the next."""
    out: list[tuple[int, int]] = []
    for first, stop in sorted(spans):
        if out and first <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((first, stop))
    return out


def numbered(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(doc, doc_id, text) and `keep`, with an own number in order, which is doc_id unless ids are null or repeat."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    odd = slim.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return slim.withColumn("doc", F.col("doc_id"))
    ordered = slim.repartitionByRange(partitions(docs.sparkSession), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    return written(ordered.withColumn("doc", F.monotonically_increasing_id()), "numbered")


def remove_repeats(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row and the columns of `keep`.

    kept: the remaining bytes, or as_text, the text that they are without letters that a cut left incomplete.
    """
    if size not in SIZES or set(keep) & set(RESULTS):
        raise ValueError(f"size must be in {SIZES} and keep without {RESULTS}")
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    docs = numbered(docs, id_col, text_col, keep)
    texts = docs.select("doc", "text")
    marked = written(sorted_copies(context_rows(texts, size)), "marked")
    release(spark)
    open_rows = marked.where("open").select("anchor", "doc", "run")
    large = written(open_rows.groupBy("anchor").count().where(F.col("count") > BLOCK // 2).select("anchor"), "large")
    contexts = context_bytes(texts, open_rows, size)
    large_is_empty = large.isEmpty()
    if large_is_empty:
        found = block_repeats(contexts, size)
    else:
        contexts = written(contexts, "contexts")
        found = block_repeats(contexts.join(large, "anchor", "left_anti"), size).unionByName(hashed_repeats(contexts.join(large, "anchor", "left_semi"), size))
    start = F.shiftright(F.col("run").bitwiseAND(F.lit(COVERED - 1)), START)
    copied = marked.where("not open").select("doc", start.alias("first"), (start + F.shiftright("run", SPAN).bitwiseAND(F.lit(0xFFF)) + size).alias("stop"))
    covered = written(found.unionByName(copied), "covered")
    discard(marked, large, *([] if large_is_empty else [contexts]))
    release(spark)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                runs = merged_runs([(x["first"], x["stop"]) for x in found]) if found else []
                edges, at, left = len(runs), 0, []
                for first, stop in runs:
                    left.append(raw[at:first])
                    at = stop
                kept = b"".join([*left, raw[at:]]) if runs else raw
                for column, value in zip(out, (len(raw), len(raw) - len(kept), int(edges), kept.decode("utf-8", "ignore") if as_text else kept), strict=True):
                    column.append(value)
            cuts = [pa.array(c, k) for c, k in zip(out, [pa.int64()] * 3 + [pa.string() if as_text else pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cuts, *batch.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *keep])

    ids = written(covered.select("doc").distinct(), "ids")
    spans = covered.groupBy("doc").agg(F.collect_list(F.struct("first", "stop")).alias("found"))  # at most a document's own
    touched = join_ids(docs, ids, "doc", "left_semi").join(spans, "doc").select("doc_id", "text", "found", *keep)
    whole = join_ids(docs, ids, "doc", "left_anti").select("doc_id", "text", F.lit(None).cast("array<struct<first:long,stop:long>>").alias("found"), *keep)
    result = ", ".join([f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}", *(f"`{c}` {kinds[c]}" for c in keep)])
    return map_batches(touched, cut, result).unionByName(map_batches(whole, cut, result))
