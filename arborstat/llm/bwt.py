"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Each round inserts one symbol of every string that is not finished, from their ends on: if a
string's last inserted suffix stands at row p and c is the symbol before it, the suffix that
begins with c stands, by LF mapping, after all suffixes with smaller first symbols and as many
with c as there are c's above row p. Its common prefix with its upper neighbour is one more than
the least common prefix between row p and the c above it; the same holds for the lower neighbour.
Transform and common prefixes are sequential files that every round reads once and writes anew.
The files are in memory by default, as blocks of strings are small; `folder` puts them on disk.
"""

from __future__ import annotations

import os

import numpy as np


class Files:
    """The two sequential files of a round, in memory or in a folder."""

    def __init__(self, folder: str | None):
        self.folder, self.round, self.names = folder, 0, []

    def write(self, *columns: np.ndarray) -> list[np.ndarray]:
        if self.folder is None:
            return list(columns)
        self.round += 1
        old, self.names = self.names, [os.path.join(self.folder, f"{kind}.{self.round}") for kind in ("bwt", "lcp")]
        for name, column in zip(self.names, columns, strict=True):
            column.tofile(name)
        for name in old:
            os.remove(name)
        return [np.memmap(name, column.dtype, "r") for name, column in zip(self.names, columns, strict=True)]

    def close(self) -> None:
        for name in self.names:
            os.remove(name)
        self.names = []


def merged(old: np.ndarray, rows: np.ndarray, new: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """`old` with `new` at `rows` of the result; fresh: mask of the result's rows that are new."""
    out = np.empty(len(old) + len(rows), old.dtype)
    out[rows] = new
    out[~fresh] = old
    return out


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first : last + 1]) of each pair."""
    if not len(first):
        return np.zeros(0, values.dtype)
    padded = np.append(values, values[:1])  # reduceat needs a place beyond the last row
    return np.minimum.reduceat(padded, np.stack([first, last + 1], axis=1).ravel())[::2]


def build(strings: list[bytes], folder: str | None = None, most: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes up to `most` at least) of the strings, whose bytes are below 255.

    Symbol 0 ends a string, byte b is b + 1; ends compare by the strings' order.
    """
    m, kind = len(strings), np.uint8 if most <= 255 else np.uint16 if most <= 65535 else np.uint32
    top = np.iinfo(kind).max - 1
    lengths = np.fromiter(map(len, strings), np.int64, m)
    ends = np.cumsum(lengths)
    text = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1) if ends[-1:].sum() else np.zeros(0, np.uint8)

    def symbol(who: np.ndarray, done: int) -> np.ndarray:
        """Before the suffix of length `done`."""
        out = np.zeros(len(who), np.uint8)
        more = lengths[who] > done
        out[more] = text[ends[who[more]] - 1 - done]
        return out

    files = Files(folder)
    who, at = np.arange(m), np.arange(m)
    bwt, lcp = files.write(symbol(who, 0), np.zeros(m, kind))
    done = 0
    while True:
        going = lengths[who] > done
        who, at = who[going], at[going]
        if not len(who):
            files.close()
            return np.asarray(bwt), np.asarray(lcp)
        order = np.argsort(bwt, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        finished = int(np.count_nonzero(bwt == 0))
        rank = place[at]
        rows = m + rank - finished  # after this round
        first = bwt[at]
        above = order[rank - 1]  # rank is at least 1 or its row has no c above it
        tied = (rank > 0) & (bwt[above] == first)
        prefix = np.zeros(len(rows), kind)
        low = least_between(lcp, above[tied] + 1, at[tied])
        prefix[tied] = np.minimum(low, top) + 1
        below_rank = np.minimum(rank + 1, len(order) - 1)
        below = order[below_rank]
        next_tied = (rank + 1 < len(order)) & (bwt[below] == first)
        next_low = np.minimum(least_between(lcp, at[next_tied] + 1, below[next_tied]), top) + 1
        fresh = np.zeros(len(bwt) + len(rows), bool)
        fresh[rows] = True
        done += 1
        new_lcp = merged(lcp, rows, prefix, fresh)
        new_lcp[rows[next_tied] + 1] = next_low
        bwt, lcp = files.write(merged(bwt, rows, symbol(who, done), fresh), new_lcp)
        at = rows


def suffix_rows(bwt: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row of each string's suffix of each length, (string, length); -1 beyond a string's length."""
    m = len(lengths)
    order = np.argsort(bwt, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    step = place - int(np.count_nonzero(bwt == 0)) + m  # LF mapping, of rows whose string goes on
    out = np.full((m, int(lengths.max(initial=0)) + 1), -1, np.int64)
    at = np.arange(m)
    out[:, 0] = at
    for n in range(1, out.shape[1]):
        who = np.flatnonzero(lengths >= n)
        at[who] = step[at[who]]
        out[who, n] = at[who]
    return out


def repeated_starts(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, class) of every substring of `size` bytes that occurs twice or more."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    bwt, lcp = build(strings, most=size)
    rows = suffix_rows(bwt, lengths)[:, size:]
    who, over = np.nonzero(rows >= 0)
    group = np.cumsum(lcp < size)[rows[who, over]]
    shared = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    who, over, group = who[shared], over[shared], group[shared]
    return who, lengths[who] - size - over, group
