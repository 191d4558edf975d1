"""Edit distances by a prefix trie against the plain table."""

import random

import numpy as np

from lexground.functions.sequences import Trie, distance_sums, edit_counts
from lexground.operators import evaluation as ev


def strings(seed, n, kinds=4, longest=7):
    rng = random.Random(seed)
    return list(dict.fromkeys(tuple(rng.choice("abcdefgh"[:kinds]) for _ in range(rng.randrange(longest + 1))) for _ in range(n)))


def plain(a, b):
    return sum(edit_counts(list(a), list(b))[1:])


def test_distances_and_one_row_for_each_node():
    some, many = strings(1, 20), strings(2, 60)
    trie = Trie(some, many)
    seen = {k: d.tolist() for k, d in trie}
    assert seen == {k: [plain(a, b) for a in some] for k, b in enumerate(many)}
    assert trie.nodes == len({b[:i] for b in many for i in range(1, len(b) + 1)}) < sum(map(len, many))


def test_sums_of_blocks():
    some, many = strings(3, 30), strings(4, 25, kinds=6)
    n, m = np.arange(1, len(some) + 1), np.arange(2, len(many) + 2)
    pairs, total = distance_sums(some, n, many, m, False)
    want = [(x * y, x * y * plain(a, b) / max(1, len(a), len(b))) for a, x in zip(some, n, strict=True) for b, y in zip(many, m, strict=True)]
    assert pairs == sum(w for w, _ in want) and np.isclose(total, sum(w for _, w in want))
    pairs, total = distance_sums(some, n, some, n, True)
    want = [(x * y, x * y * plain(a, b) / max(1, len(a), len(b))) for i, (a, x) in enumerate(zip(some, n, strict=True)) for b, y in zip(some[i + 1 :], n[i + 1 :], strict=True)]
    assert pairs == sum(w for w, _ in want) and np.isclose(total, sum(w for _, w in want))


def test_empty_strings_and_lone_members(spark):
    t = spark.createDataFrame([(1, []), (1, []), (1, ["a"]), (2, ["b"])], "class_id int, phones array<string>")
    row = ev.ned(t).first()
    assert row.pairs == 3 and row.ned == 2 / 3
    assert ev.ned(t.where("class_id = 2")).first().pairs == 0
