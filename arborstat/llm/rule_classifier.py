"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled documents, each on a part of it and of the
statistics. Every path from a root is a rule, a conjunction of bounds on statistics. A logistic
model with a lasso penalty weighs the rules and leaves most out; what is left is compiled into
one Spark column expression over the statistics, so documents are scored without Python models.

The statistics are of the text alone: never labels, language, source or id.

Defined results: null text is empty; an empty text has all statistics 0 and a score like any other;
rows are scored on their own, so repeated rows and ties score alike; without labels, or with labels of
one kind, every score is the mean label (0.5 without any); an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_batches

STATISTICS = (
    "log_words", "word_length", "long_words", "distinct_words", "common_word", "upper", "capitals", "digits", "symbols", "bangs", "pipes",
    "marked_words", "lines", "repeated_lines", "line_words", "stops", "commas", "non_ascii", "short_words", "distinct_trigrams",
)
#: Labelled documents that a model is fitted on, at most; trees, their depth, bins of a statistic, least share of a leaf.
SAMPLE_ROWS, TREES, DEPTH, BINS, LEAF = 8_000, 20, 3, 32, 0.005
#: Lasso penalties that are tried, from strong to weak, and steps for each.
PENALTIES, STEPS = (0.01, 0.003, 0.001), 120
SYMBOLS, TERMINAL = b"*$%#&@^~_=+<>{}[]\\/", b".!?"


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a text."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, counts = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = float(counts.sum() - counts[32] - counts[9:14].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = float(counts[65:91].sum()), float(counts[97:123].sum())
    symbols = np.frombuffer(SYMBOLS, np.uint8)
    marked = sum(v for w, v in seen.items() if w[-2:].strip(b"*$%#&!@") == b"" and len(w) > 2)
    trigrams = max(n - 2, 1)
    return [
        float(np.log1p(n)), float(lengths.mean()), float((lengths > 14).mean()), len(seen) / n, max(seen.values()) / n, upper / max(upper + lower, 1), sum(v for w, v in seen.items() if len(w) > 1 and w.isupper()) / n,
        float(counts[48:58].sum()) / size, float(counts[symbols].sum()) / size, float(counts[33]) / size, float(counts[124]) / n, marked / n, len(lines) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
        float(counts[np.frombuffer(TERMINAL, np.uint8)].sum()) / n, float(counts[44]) / n, float(counts[128:].sum()) / size, float((lengths <= 2).mean()), len(set(zip(words, words[1:], words[2:], strict=False))) / trigrams,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, a column for each of STATISTICS) and the columns of `keep`, none of which may have such a name (ValueError)."""
    if set(keep) & {"doc_id", "_text", *STATISTICS}:
        raise ValueError(f"a column to keep has the name of a result: {keep}")
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in keep), *(f"{s} double" for s in STATISTICS)])
    names = ["doc_id", *keep, *STATISTICS]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            kept = [batch.column(0), *(batch.column(2 + i) for i in range(len(keep)))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[:, i]) for i in range(len(STATISTICS)))], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c) for c in keep))
    return map_batches(slim, rows, schema)


Bound = tuple[int, bool, float]  # statistic, above (else at most), value


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctions; a text's score is the logistic of the weights of the rules it meets."""

    rules: tuple[tuple[Bound, ...], ...]
    weights: tuple[float, ...]
    start: float

    def column(self) -> Column:
        total = F.lit(self.start)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for statistic, above, value in rule:
                c = F.col(STATISTICS[statistic])
                met = met & ((c > value) if above else (c <= value))
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + meets(self.rules, x) @ np.array(self.weights))))


def meets(rules: tuple[tuple[Bound, ...], ...], x: np.ndarray) -> np.ndarray:
    """Rows of x by rules: 1 where the rule is met."""
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for statistic, above, value in rule:
            out[:, j] *= (x[:, statistic] > value) == above
    return out


def grow(binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, features: np.ndarray, edges: list[np.ndarray], least: int, depth: int, path: tuple[Bound, ...], rules: list, step: np.ndarray) -> None:
    """Split by the largest fall of squared gradient; note every path; `step` gets the leaves' values."""
    g, h = gradient[rows].sum(), weight[rows].sum()
    best = (1e-6, -1, 0)
    if depth:
        for f in features:
            n = len(edges[f]) + 1
            if n < 2:
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (gradient[rows], weight[rows], None))
            fits = (ns >= least) & (len(rows) - ns >= least)
            if fits.any():
                gain = np.where(fits, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), k)
    if best[1] < 0:
        step[rows] = g / (h + 1)
        return
    _, f, k = best
    value = float(edges[f][k])
    for above in (False, True):
        part = rows[(binned[rows, f] > k) == above]
        longer = (*path, (f, above, value))
        rules.append(longer)
        grow(binned, gradient, weight, part, features, edges, least, depth - 1, longer, rules, step)


def tightest(rule: tuple[Bound, ...]) -> tuple[Bound, ...]:
    """One bound a statistic and side, in order."""
    kept: dict[tuple[int, bool], float] = {}
    for statistic, above, value in rule:
        old = kept.get((statistic, above), value)
        kept[statistic, above] = max(old, value) if above else min(old, value)
    return tuple(sorted((s, a, v) for (s, a), v in kept.items()))


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[tuple[Bound, ...], ...]:
    """The distinct paths of boosted trees."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(len(y), max(len(y) * 7 // 10, 1), replace=False))
        features = np.sort(rng.choice(x.shape[1], max(x.shape[1] * 6 // 10, 1), replace=False))
        found: list[tuple[Bound, ...]] = []
        step = np.zeros(len(y))
        grow(binned, y - p, p * (1 - p), rows, features, edges, max(2, int(len(rows) * LEAF)), DEPTH, (), found, step)
        margin += 0.3 * step
        rules += found
    return tuple(dict.fromkeys(map(tightest, rules)))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, start: float) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps from (w, start)."""
    n = len(y)
    rate = 4 / (np.linalg.norm(a, 2) ** 2 / n + 1)
    v, c, old_w, old_c, t = w, start, w, start, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(a @ v + c))) - y
        w = v - rate * (a.T @ r) / n
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        start = c - rate * r.mean()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = w + (last - 1) / t * (w - old_w), start + (last - 1) / t * (start - old_c)
        old_w, old_c = w, start
    return w, start


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """A model of labels y (0 or 1) by statistics x. A quarter of the rows choose the penalty."""
    if not len(y) or y.min() == y.max():
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return RuleModel((), (), float(np.log(mean / (1 - mean))))
    rng = np.random.default_rng(seed)
    rules = tree_rules(x, y, rng)
    a = meets(rules, x)
    spread = np.sqrt(np.maximum(a.mean(axis=0) * (1 - a.mean(axis=0)), 1e-3))
    a = a / spread  # rare rules are not favoured by their scale
    held = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)
    w, c, best = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), (np.inf, PENALTIES[-1])
    if held.any():
        for penalty in PENALTIES:
            w, c = lasso(a[~held], y[~held], penalty, w, c)
            z = a[held] @ w + c
            loss = float(np.mean(np.logaddexp(0, z) - y[held] * z))
            best = min(best, (loss, penalty))
    w, c = lasso(a, y, best[1], w, c)
    chosen = np.flatnonzero(np.abs(w) > 1e-8)
    return RuleModel(tuple(rules[j] for j in chosen), tuple(float(w[j] / spread[j]) for j in chosen), float(c))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fit on at most SAMPLE_ROWS labelled documents that are not held out, chosen by a hash of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_label")).where("_label is not null and doc_id is not null")
    sample = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    # The sample has at most SAMPLE_ROWS rows, and so has what is sent to the driver: statistics, no texts.
    rows = with_statistics(texts.join(F.broadcast(sample), "doc_id"), text_col="_text", keep=("_label",)).orderBy("doc_id", "_label", *STATISTICS).limit(2 * SAMPLE_ROWS).toArrow()
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], axis=1) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, rows.column("_label").to_numpy().astype(float))


def score_documents(docs: DataFrame, model: RuleModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`."""
    scored = with_statistics(docs, id_col, text_col).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
