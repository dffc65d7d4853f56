"""Records of runs: their graph, completeness, flattening, export, recording, sweeps and validation."""

from __future__ import annotations

import inspect
import itertools
import json
import math
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import wraps
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import call_id, differences, plain, recipe_id
from ..tables import written

RECORD = "hash string, cache_key string, function string, uid string, op string, kwargs string, parents array<string>, impl_version int, inputs string, outputs string, time_sec double"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECORD).option("multiLine", True).json(folder)


def latest(records: DataFrame, key: str = "hash", by: str = "ts") -> DataFrame:
    """The last record of each key."""
    return records.groupBy(key).agg(F.max_by(F.struct(*records.columns), by).alias("r")).select("r.*")


def ancestors(edges: DataFrame) -> DataFrame:
    """(uid, ancestor, depth) from (uid, parent) of an acyclic graph, by doubling paths: rounds grow with the log of its depth."""
    reach = written(edges.select("uid", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "reach")
    while True:
        left, right = reach.alias("a"), reach.alias("b")
        longer = left.join(right, F.col("a.ancestor") == F.col("b.uid")).select(F.col("a.uid").alias("uid"), F.col("b.ancestor").alias("ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        new = written(reach.unionByName(longer).groupBy("uid", "ancestor").agg(F.min("depth").alias("depth")), "reach")
        if new.count() == reach.count():
            return new
        reach = new


def flattened(records: DataFrame, edges: DataFrame, leaf_function: str, columns: Sequence[str]) -> DataFrame:
    """A row for each leaf record with every ancestor's columns under '<function>.<column>', the nearest first, repeated roles '#2', '#3'."""
    leaf = records.where(F.col("function") == leaf_function)
    up = ancestors(edges).join(records.withColumnRenamed("uid", "ancestor"), "ancestor")
    up = up.join(leaf.select("uid"), "uid", "left_semi")
    nth = F.row_number().over(Window.partitionBy("uid", "function").orderBy("depth", "ancestor"))  # a leaf's own ancestors
    named = up.withColumn("role", F.concat("function", F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise("")))
    roles = [r[0] for r in named.select("role").distinct().orderBy("role").collect()]  # the steps of the catalogue
    wide = named.groupBy("uid").pivot("role", roles).agg(*(F.first(c).alias(c) for c in columns)) if roles else named.select("uid").distinct()
    if len(columns) == 1:
        wide = wide.select("uid", *(F.col(f"`{r}`").alias(f"{r}.{columns[0]}") for r in roles))
    else:
        wide = wide.select("uid", *(F.col(f"`{r}_{c}`").alias(f"{r}.{c}") for r in roles for c in columns))
    return leaf.select("uid", *(F.col(c).alias(f"{leaf_function}.{c}") for c in columns)).join(wide, "uid", "left")


def missing(declared: DataFrame, records: DataFrame) -> DataFrame:
    return declared.join(records.select("uid").distinct(), "uid", "left_anti")


def complete_cells(declared: DataFrame, records: DataFrame) -> DataFrame:
    """(cell, n, complete): whether every declared leaf of the cell is recorded."""
    marked = declared.join(records.select("uid").distinct().withColumn("held", F.lit(True)), "uid", "left")
    return marked.groupBy("cell").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("held", F.lit(False))).alias("complete"))


def estimated_seconds(leaves: DataFrame) -> DataFrame:
    """Adds cost: a leaf's own recorded time, else its cell's longest leaf's, plus the cell's build where that is not held."""
    cell = Window.partitionBy("cell")
    return leaves.withColumn("cost", F.coalesce("time_sec", F.max("time_sec").over(cell), F.lit(0.0)) + F.when(F.col("cell_held"), 0.0).otherwise(F.coalesce("cell_sec", F.lit(0.0))))


def run_all(todo: Sequence, step: Callable, budget: float | None = None, cost: Callable | None = None) -> tuple[list, list]:
    """Run steps in order while their estimated cost fits the budget; (done, left)."""
    done, left, spent = [], [], 0.0
    for item in todo:
        c = cost(item) if cost else 0.0
        if budget is not None and spent + c > budget:
            left.append(item)
            continue
        step(item)
        done.append(item)
        spent += c
    return done, left


def members(records: DataFrame, declared: DataFrame) -> DataFrame:
    """The records whose uid is declared."""
    return records.join(declared.select("uid").distinct(), "uid", "left_semi")


def grid_product(axes: Sequence[DataFrame]) -> DataFrame:
    """Every combination of small frames, numbered with the last varying fastest; an axis without rows gives none."""
    out = None
    for i, axis in enumerate(axes):
        numbered = axis.withColumn(f"_p{i}", F.monotonically_increasing_id())
        out = numbered if out is None else out.crossJoin(F.broadcast(numbered))  # declared settings, a handful each
    order = Window.orderBy(*(f"_p{i}" for i in range(len(axes))))
    return out.withColumn("position", F.row_number().over(order) - 1).drop(*(f"_p{i}" for i in range(len(axes))))


def grid(**axes: Iterable) -> list[dict]:
    """The same of plain settings; an axis of None alone stands for the null, where an empty one leaves nothing."""
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]


def leaves_by_cell(records: DataFrame, function: str, declared: DataFrame | None = None) -> DataFrame:
    """(cell, uid, time_sec): the leaves of one function by their first parent, or the declared ones alone."""
    held = records.where(F.col("function") == function)
    held = held if declared is None else members(held, declared)
    return held.select(F.get("parents", F.lit(0)).alias("cell"), "uid", "time_sec")


def export_closure(records: DataFrame, edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, manifest): the chosen (uid, cache) with all their ancestors, and counts by cache and function."""
    up = ancestors(edges).join(chosen.select("uid", "cache").distinct(), "uid").select(F.col("ancestor").alias("uid"), "cache")
    whole = written(chosen.select("uid", "cache").unionByName(up).distinct(), "closure")
    manifest = whole.join(records.select("uid", "function"), "uid").groupBy("cache", "function").agg(F.countDistinct("uid").alias("n"))
    return records.join(whole.select("uid").distinct(), "uid", "left_semi"), manifest


def validation_order(jobs: DataFrame, caches: Sequence[str], seed: int) -> DataFrame:
    """Adds place: caches take turns, each in an order that the seed and the uids give."""
    rank = F.create_map(*(F.lit(x) for i, c in enumerate(caches) for x in (c, i)))[F.col("cache")]
    mark = F.md5(F.concat(F.lit(f"{seed}:"), "uid").cast("binary"))
    turn = jobs.withColumn("_turn", F.row_number().over(Window.partitionBy("cache").orderBy(mark, "uid")))
    return turn.withColumn("place", F.row_number().over(Window.orderBy("_turn", rank)) - 1).drop("_turn")  # a study's jobs


def merged_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, mean, std) of partial moments (keys, n, mean, m2): unknown values are in none of them; n under 2 has no std."""
    whole = parts.where("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    apart = parts.where("n > 0").withColumnsRenamed({"n": "n_part", "mean": "mean_part"}).join(whole, list(keys))
    m2 = F.sum(F.col("m2") + F.col("n_part") * (F.col("mean_part") - F.col("mean")) * (F.col("mean_part") - F.col("mean")))
    out = apart.groupBy(*keys, "n", "mean").agg(F.greatest(m2, F.lit(0.0)).alias("m2"))
    return out.select(*keys, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"))


def chunk_slices(n: int, row_bytes: int, chunks: int, most_bytes: int = 1 << 28) -> list[slice]:
    """Slices of n rows whose sizes differ by one at most: as many as `chunks`, or more where one would have over `most_bytes`."""
    if not n:
        return []
    rows = max(1, most_bytes // max(1, row_bytes))
    parts = min(n, max(chunks, math.ceil(n / rows)))
    size, longer = divmod(n, parts)
    return [slice(k * size + min(k, longer), (k + 1) * size + min(k + 1, longer)) for k in range(parts)]


@dataclass
class Recorder:
    """Keeps a record of every call of the functions it wraps; a call that fails leaves none, one that is held is not run again."""

    held: dict[str, dict] = field(default_factory=dict)
    results: dict[str, Any] = field(default_factory=dict)

    def __call__(self, outputs: Sequence[str] = (), ignore: Sequence[str] = (), version: int | None = None) -> Callable:
        """Decorator: names of the outputs, arguments that are no part of the key."""

        def wrap(function: Callable) -> Callable:
            signature = inspect.signature(function)

            @wraps(function)
            def called(*args, **kwargs):
                bound = signature.bind(*args, **kwargs)
                bound.apply_defaults()
                named = {k: v for k, v in bound.arguments.items() if k not in ignore}
                key = call_id(function.__qualname__, named)
                if key in self.results:
                    return self.results[key]
                began = time.perf_counter()
                result = function(*args, **kwargs)
                values = result if isinstance(result, tuple) and len(outputs) > 1 else (result,)
                shown = dict(zip(outputs or ("result",), values, strict=False))
                self.held[key] = {
                    "hash": key, "function": function.__qualname__, "op": function.__qualname__, "uid": recipe_id(function.__qualname__, named, version=version), "kwargs": json.dumps(plain(named), sort_keys=True),
                    "outputs": json.dumps({k: v for k, v in plain_outputs(shown).items()}, sort_keys=True), "parents": [], "impl_version": version or 0, "time_sec": time.perf_counter() - began,
                }
                self.results[key] = result
                return result

            return called

        return wrap

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([{k: r.get(k) for k in ("hash", "function", "uid", "op", "kwargs", "parents", "impl_version", "outputs", "time_sec")} for r in self.held.values()], "hash string, function string, uid string, op string, kwargs string, parents array<string>, impl_version int, outputs string, time_sec double")

    def write(self, spark: SparkSession, folder: str) -> None:
        if self.held:
            self.frame(spark).write.mode("append").json(folder)


def plain_outputs(outputs: Mapping[str, Any]) -> dict:
    """What of the outputs a record can hold: large arrays are left to their own tables."""
    out = {}
    for k, v in outputs.items():
        try:
            out[k] = plain(v)
        except ValueError:
            out[k] = f"array{np.shape(v)}"
    return out


def check_workers(settings: Mapping[str, Any], outer: int) -> None:
    """Sweeps and fits don't both ask for workers of their own."""
    if outer > 1 and (settings.get("n_jobs") or 1) > 1:
        raise ValueError("a sweep and its fits both ask for several workers")


@dataclass
class Sweep:
    """What became of a sweep's cells."""

    done: list[dict] = field(default_factory=list)
    skipped: list[dict] = field(default_factory=list)
    failed: list[tuple[dict, str]] = field(default_factory=list)


def drive(cells: Sequence[Mapping], leaves: Sequence[Mapping], build: Callable[..., Any], score: Callable[..., Mapping], recorded: set[str] = frozenset(), only_new: bool = True) -> Sweep:
    """Every leaf on every cell, cell by cell: a cell whose leaves are all recorded is not built, and a failure ends its own cell or leaf alone."""
    out = Sweep()
    for cell in cells:
        keys = {recipe_id("leaf", dict(leaf), [recipe_id("cell", dict(cell))]): leaf for leaf in leaves}
        todo = {k: leaf for k, leaf in keys.items() if not (only_new and k in recorded)}
        out.skipped += [{**cell, **leaf} for k, leaf in keys.items() if k not in todo]
        if not todo:
            continue
        try:
            held = build(**cell)
        except Exception as broke:  # one cell's failure is its own
            out.failed.append((dict(cell), repr(broke)))
            continue
        for key, leaf in todo.items():
            began = time.perf_counter()
            try:
                found = score(held, **leaf)
            except Exception as broke:
                out.failed.append(({**cell, **leaf}, repr(broke)))
                continue
            out.done.append({"uid": key, **cell, **leaf, **found, "time_sec": time.perf_counter() - began})
    return out


def validate(order: Sequence[Mapping], replay: Callable[[Mapping], Mapping], budget: float, rtol: float = 1e-9, cost: str = "time_sec") -> list[dict]:
    """Replay records in order while their recorded seconds fit the budget: each is identical, close, differs or failed."""
    out: list[dict] = []

    def step(record: Mapping) -> None:
        try:
            apart = differences(json.loads(record["outputs"]), plain_outputs(replay(record)), rtol)
            verdict = "differs" if "differs" in apart.values() else "close" if apart else "identical"
        except Exception as broke:
            apart, verdict = {}, f"failed: {broke!r}"
        out.append({"uid": record["uid"], "verdict": verdict, "paths": apart})

    run_all(order, step, budget, lambda r: r.get(cost) or 0.0)
    return out


def stamped_name(taken: Iterable[str], stamp: str) -> str:
    """A stamp that no archive has: with a number after it where it is taken."""
    held = set(taken)
    return next(name for name in itertools.chain([stamp], (f"{stamp}-{k}" for k in itertools.count(2))) if name not in held)


def archive(spark: SparkSession, folders: Sequence[str], into: str, stamp: str) -> list[str]:
    """Move folders under one shared stamp; their new paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(into).getFileSystem(conf)
    taken = [s.getPath().getName() for s in fs.listStatus(path(into))] if fs.exists(path(into)) else []
    base, out = f"{into}/{stamped_name(taken, stamp)}", []
    fs.mkdirs(path(base))
    for folder in folders:
        to = f"{base}/{folder.rstrip('/').rsplit('/', 1)[-1]}"
        if not fs.rename(path(folder), path(to)):
            raise OSError(f"{folder} can't be moved to {to}")
        out.append(to)
    return out
