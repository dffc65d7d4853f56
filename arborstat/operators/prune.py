"""Disjoint sets of significant regions: greedy, single best, penalised and oracle."""

from __future__ import annotations

import bisect
import math
from collections.abc import Mapping, Sequence

import numpy as np

from .tree_kernels import layout, nearest_included, node_sums, sizes

RULES = ("greedy", "single_max", "dp")


def intervals(children: np.ndarray, n_leaves: int) -> tuple[np.ndarray, np.ndarray]:
    _, low, high = layout(children, n_leaves)
    return low, high


def greedy(regions: Sequence[int], children: np.ndarray, n_leaves: int, stat: Mapping[int, float]) -> tuple[int, ...]:
    """By falling statistic, those over 0 that no chosen region contains or lies in."""
    low, high = intervals(children, n_leaves)
    spans: list[tuple[int, int, int]] = []  # those chosen, in leaf order
    for r in sorted(regions, key=lambda r: (-stat[r], r)):
        at = bisect.bisect_left(spans, (int(low[r]),))
        if stat[r] > 0 and (at == len(spans) or high[r] <= spans[at][0]) and (at == 0 or spans[at - 1][1] <= low[r]):
            spans.insert(at, (int(low[r]), int(high[r]), r))
    return tuple(sorted(r for _, _, r in spans))


def single_max(regions: Sequence[int], stat: Mapping[int, float]) -> tuple[int, ...]:
    return (max(regions, key=lambda r: stat[r]),) if len(regions) else ()


def best_antichain(regions: Sequence[int], children: np.ndarray, n_leaves: int, gain: Mapping[int, float], penalty: float | Mapping[int, float] = 0.0) -> tuple[int, ...]:
    """The disjoint regions of the largest summed gain less penalties; a region beats its parts on a tie, a part needs more than 0."""
    up = nearest_included(regions, children, n_leaves)
    size = sizes(children, n_leaves)
    below: dict[int, list[int]] = {r: [] for r in up}
    for r, parent in up.items():
        if parent >= 0:
            below[parent].append(r)
    cost = penalty if isinstance(penalty, Mapping) else dict.fromkeys(up, penalty)
    value, whole = {}, {}
    for r in sorted(up, key=lambda r: (size[r], r)):
        own, parts = gain[r] - cost[r], sum(value[c] for c in below[r])
        whole[r] = own > 0 and own >= parts
        value[r] = own if whole[r] else parts
    chosen, stack = [], [r for r, parent in up.items() if parent < 0]
    while stack:
        r = stack.pop()
        if whole[r]:
            chosen.append(r)
        else:
            stack += below[r]
    return tuple(sorted(chosen))


def is_antichain(regions: Sequence[int], children: np.ndarray, n_leaves: int) -> bool:
    low, high = intervals(children, n_leaves)
    spans = sorted((low[r], high[r]) for r in regions)
    return all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def prune(rule: str, regions: Sequence[int], children: np.ndarray, n_leaves: int, stat: Mapping[int, float], *, penalty: float = 0.0, expected_effects: float | None = None) -> tuple[int, ...]:
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}")
    if rule != "dp" and (penalty or expected_effects is not None):
        raise ValueError("only dp takes a penalty")
    if penalty and expected_effects is not None:
        raise ValueError("a penalty or a number of effects, not both")
    if penalty < 0 or (expected_effects is not None and expected_effects <= 0):
        raise ValueError("a penalty is at least 0 and a number of effects over 0")
    if rule == "greedy":
        return greedy(regions, children, n_leaves, stat)
    if rule == "single_max":
        return single_max(regions, stat)
    lam = math.log1p(1 / expected_effects) if expected_effects is not None else penalty
    return best_antichain(regions, children, n_leaves, stat, lam)


def dice(regions: Sequence[int], tp: np.ndarray, size: np.ndarray, target: int) -> float:
    found, held = sum(tp[r] for r in regions), sum(size[r] for r in regions)
    return float(2 * found / (held + target)) if held + target else 0.0


def oracle(regions: Sequence[int], children: np.ndarray, target: np.ndarray) -> tuple[int, ...]:
    """The disjoint regions of the best Dice with a target over leaves: ratios d until 2 tp - d size gains no more."""
    n, best, ratio = len(target), (), 0.0
    tp, size = node_sums(target.astype(np.int64), children), sizes(children, n)
    while True:
        chosen = best_antichain(regions, children, n, {r: float(2 * tp[r] - ratio * size[r]) for r in regions})
        reached = dice(chosen, tp, size, int(target.sum()))
        if reached <= ratio + 1e-12:
            return best
        best, ratio = chosen, reached


def oracle_by_count(children: np.ndarray, target: np.ndarray, most: int, significant: set[int] | None = None) -> list[tuple[float, tuple[int, ...]]]:
    """For every k up to `most`, the best Dice of at most k disjoint regions and the regions."""
    n = len(target)
    tp, size, total = node_sums(target.astype(np.int64), children), sizes(children, n), int(target.sum())
    out = []
    for k in range(1, most + 1):
        ratio, best = 0.0, ()
        while True:
            table: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
            for node in range(n + len(children)):
                row = [(0.0, ())] * (k + 1)
                if node >= n:
                    a, b = (table.pop(int(c)) for c in children[node - n])
                    for j in range(1, k + 1):
                        row[j] = max(((a[i][0] + b[j - i][0], a[i][1] + b[j - i][1]) for i in range(j + 1)), key=lambda x: (x[0], -len(x[1])))
                own = float(2 * tp[node] - ratio * size[node])
                if significant is None or node in significant:
                    row = [row[0], *((own, (node,)) if own >= x[0] and own > 0 else x for x in row[1:])]
                table[node] = row
            score, chosen = 0.0, ()
            merged = [(0.0, ())] * (k + 1)
            for row in table.values():  # what is left are the roots
                merged = [max(((merged[i][0] + row[j - i][0], merged[i][1] + row[j - i][1]) for i in range(j + 1)), key=lambda x: x[0]) for j in range(k + 1)]
            score, chosen = merged[k]
            reached = dice(chosen, tp, size, total)
            if reached <= ratio + 1e-12:
                break
            best, ratio = chosen, reached
        out.append((ratio, tuple(sorted(best))))
    return out
