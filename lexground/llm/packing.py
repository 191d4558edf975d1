"""Best-fit packing by bin completion: documents are tokenised, cut and packed into sequences of at most ``size`` tokens.

Only lengths matter for packing, and there are at most ``size`` of them: Spark counts the pieces of every length, the driver
packs these counts (a table of ``size`` numbers, however large the corpus), and Spark deals the plan out to the pieces by
their rank within their length.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices
from .common import bound_batches, materialise

#: Nodes of the branch-and-bound search, pieces of one rank group.
NODES, GROUP = 4000, 100_000

# Fixed value: the public pattern that splits text before byte-pair merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes: by the rank file of the vocabulary, which gives the same ids as the
    ``tokenizers`` file several times faster; texts that may hold a special token's string go to ``tokenizers`` itself."""

    def __init__(self, ranks_path: str, json_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.other = json_path, None

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        if self.other is None:
            from tokenizers import Tokenizer

            self.other = Tokenizer.from_file(self.json_path)
        return np.array(self.other.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, ranks_path: str, json_path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise every text (null: empty), add id ``end``, and cut what is longer than ``size``: all pieces but the first then
    have ``size`` tokens. Rows: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, with ``keep_ids``, ``ids``. Rows that repeat are cut
    each; an empty table gives no piece; other columns are not read."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, json_path)
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            which = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                raw = (encoder.encode(text) if text else b"") + last
                n = len(raw) // 4
                cut = n % size or min(n, size)
                at = 0
                for piece in range(-(-n // size)):
                    to = cut if piece == 0 else at + size
                    own = raw[4 * at : 4 * to]
                    rows.append((piece, at, to - at, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int64) if keep_ids else None))
                    which.append(k)
                    at = to
            cols = list(zip(*rows, strict=True))
            arrays = [batch.column("id").take(pa.array(which)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            if keep_ids:
                arrays.append(pa.array(list(cols[4]), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))  # names may have dots
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


Pattern = tuple[int, tuple[int, ...]]


def least_bins(counts: np.ndarray, size: int) -> int:
    """A lower bound: the total, and for every threshold the pieces that cannot share a sequence (Martello and Toth's L2)."""
    at = np.arange(size + 1)
    best = -(-int((counts * at).sum()) // size)
    n, mass = np.cumsum(counts), np.cumsum(counts * at)
    for t in range(size // 2 + 1):
        big = int(n[size] - n[size - t])
        mid = int(n[size - t] - n[size // 2])
        mid_mass = int(mass[size - t] - mass[size // 2])
        small = int(mass[size // 2] - (mass[t - 1] if t else 0))
        best = max(best, big + mid + max(0, -(-(small - (mid * size - mid_mass)) // size)))
    return best


def best_fit(counts: np.ndarray, size: int) -> list[Pattern]:
    """Best-fit decreasing over counts: equal sequences are kept as one group (repeats, lengths)."""
    groups: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    open_at = np.zeros(size + 1, bool)
    for s in range(size, 0, -1):
        left = int(counts[s])
        while left:
            fits = np.flatnonzero(open_at[s:])
            if not len(fits):
                per = size // s
                for times, own in ((left // per, per), (1 if left % per else 0, left % per)):
                    if times:
                        room, p = size - own * s, (s,) * own
                        groups[room][p] = groups[room].get(p, 0) + times
                        open_at[room] = True
                break
            room = s + int(fits[0])
            p, n = groups[room].popitem()
            put = min(left, n)
            if put < n:
                groups[room][p] = n - put
            open_at[room] = bool(groups[room])
            groups[room - s][(*p, s)] = groups[room - s].get((*p, s), 0) + put
            open_at[room - s] = True
            left -= put
    return [(n, p) for g in groups for p, n in g.items()]


def fillings(counts: np.ndarray, room: int, most: int = 6) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first. One length dominates every set that would fit in its place, so
    beyond the largest single length only sets with a larger sum are of interest."""
    at = np.arange(room + 1)
    there = counts[: room + 1] > 0
    there[0] = False
    below = np.maximum.accumulate(np.where(there, at, 0))
    single = int(below[room])
    if not single:
        return [()]
    out = {(single,): single}
    if single < room:
        a = np.flatnonzero(there)[::-1]
        cap = np.minimum(room - a, a)
        b = below[cap]
        twice = (b == a) & (counts[a] < 2)
        b = np.where(twice, below[np.maximum(cap - 1, 0)], b)
        total = a + b
        order = np.argsort(-total, kind="stable")[:most]
        out |= {(int(a[i]), int(b[i])) if b[i] else (int(a[i]),): int(total[i]) for i in order if total[i] > single}
        if max(out.values()) < room:  # three and more: fill what pairs leave, largest first
            for i in order:
                own, rest, left = [int(a[i])], room - int(a[i]), counts
                used = {int(a[i]): 1}
                while rest:
                    x = int(below[min(rest, own[-1])])
                    while x and left[x] <= used.get(x, 0):
                        x = int(below[x - 1])
                    if not x:
                        break
                    # Leave room for one more exact fit if there is one.
                    own.append(x)
                    used[x] = used.get(x, 0) + 1
                    rest -= x
                if sum(own) > single:
                    out[tuple(own)] = sum(own)
            small = a[a <= room]
            if len(small) and max(out.values()) < room:
                x, y = small[:, None], small[None, :]
                z = np.where(x + y < room, room - x - y, 0)
                exact = np.argwhere((z > 0) & there[np.minimum(z, room)] & (x >= y) & (y >= z))[:64]
                for i, j in exact.tolist():
                    trio = (int(small[i]), int(small[j]), int(z[i, j]))
                    if all(counts[v] >= trio.count(v) for v in trio):
                        out[trio] = room
                        break
    return sorted(out, key=lambda p: (-out[p], len(p)))[:most]


def every_filling(counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """All fillings of ``room`` to which no piece can be added, least waste first."""
    lengths = [int(s) for s in np.flatnonzero(counts[: room + 1])[::-1] if s]
    out: list[tuple[int, ...]] = []

    def grow(i: int, left: int, own: tuple[int, ...], skipped: int) -> None:
        # ``skipped``: the least length of which a piece was left out though there was one more.
        if i == len(lengths):
            if left < skipped:
                out.append(own)
            return
        s = lengths[i]
        for k in range(min(left // s, int(counts[s])), -1, -1):
            grow(i + 1, left - k * s, own + (s,) * k, min(skipped, s) if k < counts[s] else skipped)

    grow(0, room, (), room + 1)
    return sorted(out, key=lambda p: (-sum(p), len(p)))


def pack_counts(counts: np.ndarray, size: int, nodes: int | None = NODES, exact: bool = False) -> tuple[list[Pattern], int]:
    """Sequences for ``counts[length]`` pieces of every length: [(repeats, lengths)], and the lower bound.

    The incumbent is best fit decreasing. Bin completion then takes the largest length left, tries its undominated fillings
    in order of waste, repeats the chosen sequence as long as the counts allow, and gives up a branch once its waste leaves
    no chance to beat the incumbent. The search ends at the lower bound or after ``nodes`` nodes (None: no limit).

    By default at most six fillings of a sequence are tried, and a sequence is repeated as often as can be, so a
    result above the lower bound need not be the best there is. ``exact`` tries every filling and repeats none, without a limit
    of nodes: the result is the best, in a time that can grow exponentially with the number of pieces.
    """
    nodes = math.inf if exact or nodes is None else nodes
    bound = least_bins(counts, size)
    best = best_fit(counts, size)
    n_best = sum(n for n, _ in best)
    left = counts.astype(np.int64).copy()
    bins, rest = 0, int((counts * np.arange(size + 1)).sum())
    path: list[Pattern] = []

    def children() -> Iterator[tuple[int, ...]]:
        s = int(np.flatnonzero(left)[-1])
        left[s] -= 1
        own = every_filling(left, size - s) if exact else fillings(left, size - s)
        left[s] += 1
        return iter([(s, *f) for f in own])

    def put(times: int, p: tuple[int, ...]) -> None:
        nonlocal bins, rest
        for v in p:
            left[v] -= times
        bins += times
        rest -= times * sum(p)

    frames, visited = [children()] if rest else [], 0
    while frames and visited < nodes and n_best > bound:
        p = next(frames[-1], None)
        if p is None:
            frames.pop()
            if path:
                times, p = path.pop()
                put(-times, p)
            continue
        times = 1 if exact else min(int(left[v]) // p.count(v) for v in set(p))
        put(times, p)
        path.append((times, p))
        visited += 1
        if rest and bins + -(-rest // size) < n_best:
            frames.append(children())
            continue
        if not rest and bins < n_best:
            best, n_best = list(path), bins
        times, p = path.pop()
        put(-times, p)
    if frames and path and n_best > bound:  # out of nodes on the way down: best fit ends this branch
        tail = best_fit(left, size)
        if bins + sum(n for n, _ in tail) < n_best:
            best = [*path, *tail]
    return best, bound


def deal(plan: list[Pattern], size: int) -> dict[str, np.ndarray]:
    """The plan by length: from rank ``start`` on, ``per`` pieces of ``length`` in each of the sequences from ``seq`` on, at ``offset``."""
    rows, taken, seq = [], {}, 0
    for times, p in plan:
        offset = 0
        for v in sorted(set(p), reverse=True):
            per = p.count(v)
            start = taken.get(v, 0)
            rows.append((v, start, per, seq, offset))
            taken[v] = start + per * times
            offset += per * v
        seq += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (cols[0] << 44) + cols[1], "start": cols[1], "per": cols[2], "seq": cols[3], "offset": cols[4]}


def pack(cut: DataFrame, size: int = 2048, id_col: str = "doc_id", nodes: int | None = NODES, exact: bool = False) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (see ``pieces``); within a sequence offsets have no gaps.

    Ranks within a length are counted in salted groups, so that a length which many copies share is no single task.
    Equal rows are interchangeable. An empty table gives an empty result. ``nodes`` and ``exact`` as for ``pack_counts``.
    """
    spark = cut.sparkSession
    cut = materialise(cut, "pieces")
    found = cut.groupBy("length").count().collect()
    counts = np.zeros(size + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    plan, _ = pack_counts(counts, size, nodes, exact) if counts.any() else ([], 0)
    held = spark.sparkContext.broadcast(deal(plan, size))
    salts = int(max(32, counts.max() // GROUP))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.row_number().over(own) - 1).select(*cut.columns, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = held.value
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy()
            i = np.searchsorted(d["key"], (length << 44) + rank, "right") - 1
            k = rank - d["start"][i]
            seq, offset = d["seq"][i] + k // d["per"][i], d["offset"][i] + k % d["per"][i] * length
            keep = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(seq), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def public_paths() -> tuple[str, str]:
    """Places of the rank file and the json file of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
