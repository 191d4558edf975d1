"""Edit distance of symbol sequences, a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_counts(ref: list, hyp: list) -> tuple[int, int, int, int]:
    """(correct, substitutions, deletions, insertions) of a cheapest alignment with unit costs; a deletion is a reference symbol
    without a counterpart. The traceback prefers a match, then a deletion, then an insertion, then a substitution."""
    n, m = len(ref), len(hyp)
    d = np.zeros((n + 1, m + 1), np.int32)
    d[:, 0], d[0] = np.arange(n + 1), np.arange(m + 1)
    steps = np.arange(m + 1, dtype=np.int32)
    h = np.array(hyp, object)
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int32)
        best[0] = i
        best[1:] = np.minimum(d[i - 1, 1:] + 1, d[i - 1, :-1] + (h != ref[i - 1]))
        d[i] = np.minimum.accumulate(best - steps) + steps
    i, j, c, s, dels, ins = n, m, 0, 0, 0, 0
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1] and d[i, j] == d[i - 1, j - 1]:
            c, i, j = c + 1, i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            dels, i = dels + 1, i - 1
        elif j and d[i, j] == d[i, j - 1] + 1:
            ins, j = ins + 1, j - 1
        else:
            s, i, j = s + 1, i - 1, j - 1
    return c, s, dels, ins


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("correct", "substitutions", "deletions", "insertions")]))
def edit_counts_of(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [edit_counts(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(ref, hyp, strict=True)]
    return pd.DataFrame(rows, columns=["correct", "substitutions", "deletions", "insertions"])


class Trie:
    """Edit distances of some strings to many: the many are walked in sorted order, as the nodes of their prefix trie, and a node's row
    of the distance table, for all of the some at once, is made from its parent's once. ``nodes`` counts the rows made."""

    def __init__(self, some: list[tuple], many: list[tuple]):
        self.codes = {x: i for i, x in enumerate(dict.fromkeys(s for string in (*some, *many) for s in string))}
        self.sizes = np.array([len(s) for s in some], int)
        self.some = np.full((len(some), int(self.sizes.max(initial=0))), -1, np.int32)
        for i, s in enumerate(some):
            self.some[i, : len(s)] = [self.codes[x] for x in s]
        self.many, self.nodes = many, 0

    def __iter__(self):
        """(index in ``many``, distances of all of ``some``), in the order of the sorted strings."""
        steps = np.arange(self.some.shape[1] + 1, dtype=np.int32)
        rows, last, at = [np.broadcast_to(steps, (len(self.some), len(steps)))], (), np.arange(len(self.some))
        spelt = [tuple(self.codes[x] for x in s) for s in self.many]
        for k in sorted(range(len(spelt)), key=lambda k: spelt[k]):
            word, same = spelt[k], 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            del rows[same + 1 :]
            for depth in range(same, len(word)):
                old = rows[-1]
                new = np.empty_like(old, shape=old.shape)
                new[:, 0] = depth + 1
                np.minimum(old[:, 1:] + 1, old[:, :-1] + (self.some != word[depth]), out=new[:, 1:])
                rows.append(np.minimum.accumulate(new - steps, axis=1) + steps)
                self.nodes += 1
            last = word
            yield k, rows[-1][at, self.sizes]


def distance_sums(left: list[tuple], n: np.ndarray, right: list[tuple], m: np.ndarray, same: bool) -> tuple[float, float]:
    """(pairs, sum of distance over longer length) of the pairs of ``left`` and ``right``, each counted ``n`` times ``m``; with ``same``, of two
    equal lists of distinct strings, each pair of different ones once."""
    pairs = total = 0.0
    longest = max(max(map(len, left), default=0) * max(map(len, right), default=0), 1)
    step = max(1, 20_000_000 // longest)
    for lo in range(0, len(left), step):
        own, weight = left[lo : lo + step], n[lo : lo + step].astype(float)
        trie = Trie(own, right)
        for k, d in trie:
            w = np.where(np.arange(lo, lo + len(own)) < k, weight, 0.0) if same else weight
            pairs += m[k] * w.sum()
            total += m[k] * (w * d / np.maximum(np.maximum(trie.sizes, len(right[k])), 1)).sum()
    return pairs, total
