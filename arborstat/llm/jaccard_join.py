"""Similarity join on word shingles by parity sketches.

A document's set is hashed into a sketch of bits: each shingle flips one. A bit survives where an
odd number of shingles falls, so equal shingles of two sets cancel and the Hamming distance of two
sketches is at most the size of the sets' symmetric difference. Jaccard similarity p % bounds that
difference by (100 - p) / (100 + p) of the sizes' sum, d say. Hence of d + 1 blocks into which the
sketch is cut at least one is the same in both: blocks are join keys (pigeonhole). Sizes are
banded, so that d is fixed where two documents meet: a key space for each band and one across
each border between bands. A block is compared by a 64-bit linear fingerprint of its bits.

Blocks of few shingles are poor keys. They are left out only where d is so large that two linked
documents would share no better block with odds under MISS, like those of a hash collision;
`exact` keeps every block.

Candidates: a run of documents with the same key gives links to its smallest id alone, never all
pairs. A run is first formed within a batch, so a key that a third of all documents have reaches the
shuffle as a row a batch; its other members go anywhere with their batch's smallest id, and by key and that
id they find the whole run's smallest.
Candidates are thinned by size and by the Hamming distance of short sketches, then verified on
the whole sets, a star's pairs dealt out among salted copies of its centre. Only runs that links have
not made one component by then are compared further, in blocks of bounded size; longer ones
are first dealt anew by other sketches, and what is still long then is compared block against block.
Copies of the same set join through one of them, whatever their number.

Defined results: null or empty text and text without words give an empty set, linked with nothing;
fewer words than a shingle has make one shingle; rows of one doc_id are one node; a null doc_id has no
links and no component; repeated rows come back as often; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, few_files, join_ids, map_batches, partitions, release, written

#: Ratio of a band's ends, at least; short sketch in 64-bit words; odds of a link lost by leaving out poor blocks.
BAND, SKETCH_WORDS, MISS = 1.5, 8, 1e-13
#: A block has at least so many shingles to be left in where blocks may be left out at all.
GOOD_BLOCK = 4
#: Members of a run that are compared with each other within a task; times that longer runs are dealt anew.
RUN, DEALS = 2048, 2
#: Pairs of one centre that are verified with the same copy of its text; sets that a task keeps to know copies by.
STAR, SEEN = 256, 100_000
SETS = "doc_id long, n_shingles long, set_hash binary, sketch array<long>, copy_of long, keys array<long>"

U = np.uint64


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = (x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)).astype(U)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z in lower case."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), U, len(found))
    n = max(len(h) - words + 1, 1)
    out = np.full(n, len(h) if len(h) < words else words, U)
    for k in range(min(words, len(h))):
        out = mixed(out ^ h[k : k + n], k + 1)
    return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


@cache
def borders(percent: int) -> list[int]:
    """Smallest size of each band; a link spans at most one border."""
    ratio, out = max(BAND, 100 / percent), [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
    return out


def least_in_block(size: int, blocks: int) -> int:
    """How many shingles a block must have to be a key: 0 if every block is needed."""
    mean = size / blocks
    for least in range(GOOD_BLOCK, 0, -1):
        poor = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least))
        if (1 - (1 - 1 / blocks) ** (blocks - 1) * (1 - poor)) ** blocks < MISS:
            return least
    return 0


@cache
def spaces(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(id, blocks, least shingles) of each key space that a set of `size` takes part in."""
    edge = borders(percent)
    i = int(np.searchsorted(edge, size, side="right")) - 1
    low, high = edge[i], edge[i + 1]
    out = [(2 * i, 2 * (high - 1))]
    if 100 * size >= percent * high:  # partners over the upper border
        out.append((2 * i + 1, high - 1 + (high - 1) * 100 // percent))
    if i and percent * size <= 100 * (low - 1):  # partners under the lower one
        out.append((2 * i - 1, low - 1 + (low - 1) * 100 // percent))
    found = []
    for space, total in out:
        blocks = total * (100 - percent) // (100 + percent) + 1
        # Judged by the space's smallest size, so that both ends of a link leave out the same blocks.
        smallest = low if space == 2 * i else -(-percent * (high if space > 2 * i else low) // 100)
        found.append((space, blocks, least_in_block(smallest, blocks)))
    return found


def sketch_keys(hashes: np.ndarray, percent: int, seed: int = 0, exact: bool = False) -> np.ndarray:
    """The block keys of a set; exact: of every block, however few shingles it has."""
    h = hashes if not seed else np.sort(mixed(hashes, 100 + seed))
    flips, out = mixed(h, 50 + seed), []
    for space, blocks, least in spaces(len(h), percent):
        block = ((h >> U(32)) * U(blocks)) >> U(32)  # rises with h
        starts = np.flatnonzero(np.diff(block, prepend=U(blocks + 1)))
        content, counts = np.zeros(blocks, U), np.zeros(blocks, np.int64)
        content[block[starts]] = np.bitwise_xor.reduceat(flips, starts)
        counts[block[starts]] = np.diff(np.append(starts, len(h)))
        keys = mixed(content ^ mixed(np.arange(blocks, dtype=U) + U(space << 32), 7 + seed), 9)
        out.append(keys if exact else keys[counts >= least])
    return np.concatenate(out).view(np.int64)


def short_sketch(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((mixed(hashes, 77) % U(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def document_sets(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, exact: bool = False) -> DataFrame:
    """SETS of each row. A set among the last SEEN of its task has no keys and names the first with it."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingle_set(text, words)
                digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                if len(seen) >= SEEN:
                    seen.clear()  # later copies have keys of their own and meet by these
                copy_of = doc if not len(h) or doc is None else seen.setdefault(digest, doc)
                keys = sketch_keys(h, percent, 0, exact) if len(h) and copy_of == doc and doc is not None else np.zeros(0, np.int64)
                for column, value in zip(out, (len(h), digest, short_sketch(h), copy_of, keys), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_shingles", "set_hash", "sketch", "copy_of", "keys"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(slim, rows, SETS)


def batch_runs(sets: DataFrame) -> DataFrame:
    """(deal, key, doc, first) of each key of each document, by batch: the smallest id of a key has the key
    itself as `deal` and no more; another has it in `key`, the batch's smallest id in `first`, and is dealt anywhere."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            key, counts = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
            doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            if not len(key):
                continue
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order].astype(np.int64)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            own = first == doc
            spread = mixed(key.view(U) ^ mixed(doc.view(U), 5), 6).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(own, key, spread)), pa.array(key, mask=own), pa.array(doc), pa.array(first, mask=own)], ["deal", "key", "doc", "first"])

    return map_batches(sets.where("size(keys) > 0").select("doc_id", "keys"), rows, "deal long, key long, doc long, first long")


def key_runs(dealt: DataFrame) -> DataFrame:
    """(key, u, v, local) from `batch_runs`: a batch's smallest id v with the run's smallest u, or (local) another member v with its batch's u.

    Sorted rows stream past; only the current key's first id is held.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, first_id = None, 0
        for batch in batches:
            alone = batch.column(3).is_null()
            known = batch.filter(pa.compute.invert(alone))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(1), known.column(3), known.column(2), pa.array(np.ones(known.num_rows, bool))], ["key", "u", "v", "local"])
            batch = batch.filter(alone)
            if not batch.num_rows:
                continue
            key, doc = (batch.column(i).to_numpy() for i in (0, 2))
            starts = np.empty(len(key), bool)
            starts[1:] = key[1:] != key[:-1]
            starts[0] = last_key is None or key[0] != last_key
            at = np.maximum.accumulate(np.where(starts, np.arange(len(key)), -1))
            first = np.where(at >= 0, doc[at], first_id)
            last_key, first_id = key[-1], first[-1]
            take = ~starts & (first != doc)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[take]) for x in (key, first, doc)), pa.array(np.zeros(int(take.sum()), bool))], ["key", "u", "v", "local"])

    ordered = dealt.repartition(partitions(dealt.sparkSession), "deal").sortWithinPartitions("deal", "doc")
    return map_batches(ordered, rows, "key long, u long, v long, local boolean")


def whole_runs(parts: DataFrame) -> DataFrame:
    """(key, u, v): every member v of a key's run but the smallest id u, from the written `key_runs`.

    The join is by key and batch, so that no task gets a whole run of a common key.
    """
    firsts = parts.where("not local").select("key", "u", "v")
    up = firsts.select(F.col("key").alias("_key"), F.col("v").alias("_first"), F.col("u").alias("_least"))
    others = parts.where("local").join(up, (F.col("key") == F.col("_key")) & (F.col("u") == F.col("_first")), "left")
    return firsts.unionByName(others.select("key", F.coalesce("_least", "u").alias("u"), "v"))


def most_different(n: Column, m: Column, percent: int) -> Column:
    return F.floor((n + m) * (100 - percent) / (100 + percent))


def distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col(f"{a}.sketch")[0].bitwiseXOR(F.col(f"{b}.sketch")[0])))


def thinned(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, equal) of the pairs that sizes and short sketches allow."""
    side = sets.where("copy_of = doc_id").select("doc_id", F.struct("n_shingles", "set_hash", "sketch").alias("set"))
    both = pairs.join(side.select(F.col("doc_id").alias("u"), F.col("set").alias("a")), "u").join(side.select(F.col("doc_id").alias("v"), F.col("set").alias("b")), "v")
    n, m = F.col("a.n_shingles"), F.col("b.n_shingles")
    equal = F.col("a.set_hash") == F.col("b.set_hash")
    near = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (distance("a", "b") <= most_different(n, m, percent))
    return both.where(equal | near).select("u", "v", equal.alias("equal")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The pairs (u, v) that are linked, judged by the whole sets, as a written table.

    A centre u with many pairs has a copy of its text for each STAR of them, so that no task gets them all.
    """
    pairs = written(pairs, "pairs")
    apart = pairs.where("not equal").select("u", "v")
    n = apart.count()
    centres = written(few_files(apart.groupBy("u").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")), n), "centres")
    ids = written(few_files(apart.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), 2 * n), "ids")
    texts = written(join_ids(docs, ids, "doc_id", "left_semi"), "texts")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_set = None, np.zeros(0, U)
        for batch in batches:
            keep = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if u != held:
                    held, held_set = u, shingle_set(a, words)
                keep.append(linked(held_set, shingle_set(b, words), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    left = texts.withColumnRenamed("doc_id", "u").join(centres, "u").select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("a"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))
    dealt = apart.join(centres, "u").select("u", "v", F.pmod(F.xxhash64("v"), "salts").cast("int").alias("salt"))
    both = dealt.join(right, "v").join(left, ["u", "salt"]).select("u", "v", "a", "b")
    out = written(pairs.where("equal").select("u", "v").unionByName(map_batches(both, rows, "u long, v long")), name)
    discard(pairs, centres, ids, texts)
    return out


def near_in_runs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components within a run that sizes and short sketches allow, from
    (key, doc_id, component_id, n_shingles, sketch); a run has at most RUN members."""

    def pairs(key: list, doc: np.ndarray, component: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = np.asarray(key)
        cuts = np.flatnonzero(np.diff(key)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            for i in range(start, stop - 1):
                rest = slice(i + 1, stop)
                apart = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                fits = (apart <= (n[rest] + n[i]) * (100 - percent) // (100 + percent)) & (component[rest] != component[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
                if fits.any():
                    other = doc[rest][fits]
                    yield np.minimum(doc[i], other), np.maximum(doc[i], other)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = whole.column(0).to_numpy()
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            rest = whole.slice(done)
            yield from compare(whole.slice(0, done))
        if rest is not None:
            yield from compare(rest)

    def compare(held: pa.Table) -> Iterator[pa.RecordBatch]:
        if held.num_rows:
            columns = [held.column(i).to_numpy() for i in range(4)]
            sketch = pa.concat_arrays(held.column(4).chunks).flatten().to_numpy().reshape(-1, SKETCH_WORDS)
            found = list(pairs(*columns, sketch))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], ["u", "v"])

    dealt = members.repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key", "doc_id")
    return map_batches(dealt.select("key", "doc_id", "component_id", "n_shingles", "sketch"), rows, "u long, v long").distinct()


def second_keys(docs: DataFrame, ids: DataFrame, words: int, percent: int, seed: int, exact: bool) -> DataFrame:
    """(doc_id, next): block keys of another sketch, for the documents in `ids`."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sketch_keys(shingle_set(t, words), percent, seed, exact) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "keys"])

    return map_batches(join_ids(docs, ids, "doc_id", "left_semi"), rows, "doc_id long, keys array<long>").select("doc_id", F.explode("keys").alias("next"))


def block_pairs(members: DataFrame) -> DataFrame:
    """Each long run as runs of two of its blocks, dealt by a hash; a block stands with every other and with itself."""
    blocks = F.ceil(F.col("length") * 2 / RUN).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select("key", "doc_id", "component_id")


def unresolved(members: DataFrame) -> DataFrame:
    """The runs whose members lie in more than one component; their length in `members`."""
    several = members.groupBy("key").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.count("*").alias("length")).where("low <> high")
    return members.join(several.select("key", "length"), "key")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id: the smallest doc_id that links reach.

    exact: no block is left out as a key, whatever the odds.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = written(document_sets(docs, words, percent, "doc_id", "text", exact), "sets")
    own = docs.where("doc_id is not null")
    parts = written(key_runs(batch_runs(sets)), "parts")
    release(docs.sparkSession)  # the keys' shuffle
    runs = written(whole_runs(parts), "runs")
    discard(parts)
    release(docs.sparkSession)
    links = verified(thinned(runs.select("u", "v").distinct(), sets, percent), own, words, percent, "stars")
    copies = sets.where("copy_of <> doc_id").select(F.col("copy_of").alias("u"), F.col("doc_id").alias("v"))
    found = components(links)
    # Links to a run's smallest id are settled; what is left is between its other members, where they are of different components.
    members = runs.select("key", F.col("v").alias("doc_id")).distinct()
    members = members.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    open_runs, more, seed = written(unresolved(members), "open"), [links], 0
    discard(runs, found)
    release(docs.sparkSession)
    side = sets.where("copy_of = doc_id").select("doc_id", "n_shingles", "sketch")
    while not open_runs.isEmpty():
        near = near_in_runs(open_runs.where(F.col("length") <= RUN).join(side, "doc_id"), percent)
        more.append(verified(thinned(near, sets, percent), own, words, percent, "more"))
        long_runs = open_runs.where(F.col("length") > RUN)
        if long_runs.isEmpty():
            break
        seed += 1
        if seed > DEALS:
            near = near_in_runs(block_pairs(long_runs).join(side, "doc_id"), percent)
            more.append(verified(thinned(near, sets, percent), own, words, percent, "more"))
            break
        ids = written(long_runs.select("doc_id").distinct(), "ids")
        dealt = long_runs.drop("length").join(second_keys(own, ids, words, percent, seed, exact), "doc_id").withColumn("key", F.xxhash64("key", "next")).drop("next")
        old, open_runs = open_runs, written(unresolved(dealt), "open")
        discard(old, ids)
    found = components(reduce(DataFrame.unionByName, more).unionByName(copies))
    discard(open_runs, *more)
    release(docs.sparkSession)
    return sets.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
