"""Likeness of texts by matching blocks (Ratcliff and Obershelp): the longest common block, then the same left and right of it.

Worked out for a batch of pairs at once: all open stretches of all pairs advance together, one letter of the
first texts at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second texts of this length on pass over letters that make up more than a hundredth of them when blocks are looked for.
LONG = 200
#: Letters of a batch's padded texts that are compared at once.
CELLS = 1 << 22


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one text a row, and the texts' lengths."""
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(1, size.max(initial=0))), -1, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def _popular(b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Letters of long second texts that are too common to look up blocks by."""
    out = np.zeros(b.shape, bool)
    for i in np.flatnonzero(size >= LONG).tolist():
        each, where, n = np.unique(b[i, : size[i]], return_inverse=True, return_counts=True)
        out[i, : size[i]] = n[where] > size[i] // 100 + 1
    return out


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """Letters in matching blocks of each pair. Of equally long blocks the first of the first text counts, then of the second."""
    (a, la), (b, lb) = _letters(a), _letters(b)
    common = _popular(b, lb)
    total = np.zeros(len(a), np.int64)
    todo = np.stack((np.arange(len(a)), np.zeros_like(la), la, np.zeros_like(lb), lb), 1)
    todo = todo[(la > 0) & (lb > 0)]
    while len(todo):
        pair, alo, ahi, blo, bhi = todo.T
        inside = (np.arange(b.shape[1]) >= blo[:, None]) & (np.arange(b.shape[1]) < bhi[:, None])
        there, usable = b[pair], inside & ~common[pair]
        run = np.zeros(there.shape, np.int32)
        best, besti, bestj = np.zeros(len(todo), np.int64), alo.copy(), blo.copy()
        for i in range(int(alo.min()), int(ahi.max())):
            here = usable & (there == a[pair, min(i, a.shape[1] - 1)][:, None]) & ((i >= alo) & (i < ahi))[:, None]
            run[:, 1:] = run[:, :-1].copy()
            run[:, 0] = 0
            run = np.where(here, run + 1, 0)
            j = run.argmax(1)
            size = run[np.arange(len(run)), j]
            better = size > best
            best[better], besti[better], bestj[better] = size[better], i - size[better] + 1, j[better] - size[better] + 1
        while True:  # letters passed over may still lengthen a block
            more = (besti > alo) & (bestj > blo) & (a[pair, np.maximum(besti - 1, 0)] == b[pair, np.maximum(bestj - 1, 0)])
            if not more.any():
                break
            besti[more] -= 1
            bestj[more] -= 1
            best[more] += 1
        while True:
            i, j = besti + best, bestj + best
            more = (i < ahi) & (j < bhi) & (a[pair, np.minimum(i, a.shape[1] - 1)] == b[pair, np.minimum(j, b.shape[1] - 1)])
            if not more.any():
                break
            best[more] += 1
        np.add.at(total, pair, best)
        found = best > 0
        left = np.stack((pair, alo, besti, blo, bestj), 1)[found]
        right = np.stack((pair, besti + best, ahi, bestj + best, bhi), 1)[found]
        todo = np.concatenate((left, right))
        todo = todo[(todo[:, 1] < todo[:, 2]) & (todo[:, 3] < todo[:, 4])]
    return total


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the matched letters over all letters; 1 for two empty texts."""
    out, at = np.ones(len(a)), 0
    order = np.argsort([len(x) + len(y) for x, y in zip(a, b, strict=True)], kind="stable")
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto - at) * (len(a[order[upto]]) + len(b[order[upto]]) + 1) <= CELLS:
            upto += 1
        part = order[at:upto]
        x, y = [a[i] for i in part], [b[i] for i in part]
        n = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
        out[part] = np.where(n > 0, 2.0 * matched(x, y) / np.maximum(n, 1), 1.0)
        at = upto
    return out


def ratio(a: Column, b: Column) -> Column:
    """The ratio of two text columns, null where one is; each different pair of an Arrow batch is worked out once, equal and empty ones never."""

    @F.pandas_udf("double")
    def worked_out(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = pd.MultiIndex.from_arrays([x, y])
        code, each = pairs.factorize()
        return pd.Series(ratios(list(each.get_level_values(0)), list(each.get_level_values(1)))[code] if len(x) else np.zeros(0))

    same = F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
    none = a.isNull() | b.isNull()
    ask = same.isNull() & ~none
    # the worker sees blanks where the answer is known
    return F.when(~none, F.coalesce(same, worked_out(F.when(ask, a).otherwise(""), F.when(ask, b).otherwise(""))))
