"""Filling fixed-capacity containers by multiway Karmarkar-Karp differencing.

Texts longer than the capacity are divided into full containers and a rest; whole texts and
rests are items. Items are spread at random over blocks of a fixed total size, and each
block is divided into k windows: partial partitions are merged two at a time, the largest
imbalances first, the sums of one in rising and of the other in falling order, until one
near-equal partition is left. k is the least number that could do, and rises while a window
is over capacity; a partition whose windows over capacity hand items on to others is taken
where it needs fewer windows. Windows that stay poorly filled are emptied and their items packed again in
a second round, so blocks waste next to nothing at their edges.

Cases: null texts are no items; empty texts have size 0 and take no space; equal texts,
repeated rows and ties are items of their own; a capacity that is null or not positive has
no containers; an empty table gives none.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textverk.session import stored

WINDOWS = 96  # windows of a block, about
ITEMS = 50_000  # items of a block, about, at most
GOOD = 0.97  # share of the capacity from which a window is kept in the first round


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers in k groups of near-equal sums (largest differencing method)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    heap: list[tuple] = []
    groups: list[tuple[np.ndarray, list]] = []
    # k items at a time start as one partition: k equal-ranked items never meet anyway
    for at in range(0, len(order), k):
        part = order[at : at + k]
        sums = np.zeros(k, dtype=np.int64)
        sums[k - len(part) :] = [sizes[i] for i in reversed(part)]
        sets: list = [None] * (k - len(part)) + [(i,) for i in reversed(part)]
        groups.append((sums, sets))
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), len(groups) - 1))
    while len(heap) > 1:
        a, b = (groups[heapq.heappop(heap)[1]] for _ in range(2))
        sums = a[0] + b[0][::-1]
        sets = [(x, y) if x is not None and y is not None else x if y is None else y for x, y in zip(a[1], reversed(b[1]), strict=True)]
        o = np.argsort(sums, kind="stable")
        groups.append((sums[o], [sets[i] for i in o.tolist()]))
        heapq.heappush(heap, (-int(groups[-1][0][-1] - groups[-1][0][0]), len(groups) - 1))
    if not heap:
        return [[] for _ in range(k)]
    return [_flat(x) for x in groups[heap[0][1]][1]]


def _flat(x) -> list[int]:
    out, todo = [], [x]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo.extend(t)
        elif t is not None:
            out.append(t)
    return out


MORE = 0.03  # share of windows by which the number rises before a mended partition is taken


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of item numbers, none over the capacity; every size is at most the capacity.

    Differencing divides the items into k windows, the least number that could do; while one is
    over capacity it is run again with one window more. Where items are large beside the
    capacity near-equal windows waste space, so the first partition is mended too, and taken
    if it needs fewer windows.
    """
    if not sizes:
        return []
    least = max(1, -(-sum(sizes) // capacity))
    first = None
    for k in range(least, least + max(2, round(least * MORE)) + 1):
        groups = [g for g in difference(sizes, k) if g]
        first = first or [list(g) for g in groups]
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            if len(groups) == least:
                return groups
            mended = _mended(sizes, capacity, first)
            return mended if len(mended) < len(groups) else groups
    return _mended(sizes, capacity, first)


def _mended(sizes: list[int], capacity: int, groups: list[list[int]]) -> list[list[int]]:
    """The partition with its windows over capacity put right: each gives up the item that brings
    it nearest under it; items given up go where they fit best. Then the emptiest windows are
    given up and their items fill gaps of the others, alone or for a smaller item, and are
    packed last."""
    k = len(groups)
    sums = [sum(sizes[i] for i in g) for g in groups]
    loose: list[int] = []
    for g in range(k):
        while sums[g] > capacity:
            over = sums[g] - capacity
            i = min(groups[g], key=lambda i: (sizes[i] < over, abs(sizes[i] - over), i))
            groups[g].remove(i)
            sums[g] -= sizes[i]
            loose.append(i)
    _insert(groups, sums, loose, sizes, capacity)
    # the emptiest windows, a fifth of them at most, feed the gaps of the others
    order = sorted((g for g in range(len(groups)) if groups[g]), key=lambda g: sums[g])
    last = [g for g in order[: max(1, len(order) // 5)] if sums[g] < 0.97 * capacity] if len(order) > 1 else []
    pool = sorted(((sizes[i], i) for g in last for i in groups[g]))
    gone = set(last)
    for g in reversed(order):
        gap = capacity - sums[g]
        if g in gone or gap <= 0 or not pool:
            continue
        at = bisect.bisect_right(pool, (gap, 1 << 60)) - 1
        if at >= 0 and pool[at][0] > 0.5 * gap:
            size, i = pool.pop(at)
            groups[g].append(i)
            sums[g] += size
            gap -= size
        best = (0.01 * capacity, -1, -1)
        for i in groups[g]:
            at = bisect.bisect_right(pool, (gap + sizes[i], 1 << 60)) - 1
            if at >= 0 and pool[at][0] - sizes[i] > best[0]:
                best = (pool[at][0] - sizes[i], i, at)
        if best[1] >= 0:
            size, j = pool.pop(best[2])
            groups[g].remove(best[1])
            groups[g].append(j)
            sums[g] += size - sizes[best[1]]
            bisect.insort(pool, (sizes[best[1]], best[1]))
    kept = [groups[g] for g in order if g not in gone]
    sums = [sums[g] for g in order if g not in gone]
    _insert(kept, sums, [i for _, i in pool], sizes, capacity)
    return [g for g in kept if g]


def _insert(groups: list[list[int]], sums: list[int], loose: list[int], sizes: list[int], capacity: int) -> None:
    """Puts items, largest first, where the least room is left; opens windows for the rest."""
    room = sorted((capacity - s, g) for g, s in enumerate(sums))
    for i in sorted(loose, key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            groups.append([])
            sums.append(0)
            free, g = capacity, len(groups) - 1
        else:
            free, g = room.pop(at)
        groups[g].append(i)
        sums[g] += sizes[i]
        bisect.insort(room, (free - sizes[i], g))


PACKED = "spec_id int, capacity int, container string, rid long, piece int, doc_id long, token_from int, size int"


def _round(items: DataFrame, number: int) -> DataFrame:
    """Packs (spec_id, capacity, rid, doc_id, piece, token_from, size) in blocks."""
    totals = items.groupBy("spec_id").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    x = items.join(F.broadcast(totals), "spec_id")  # a row a spec
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / (F.col("capacity") * WINDOWS)), F.ceil(F.col("n") / ITEMS))  # items without size count too
    x = x.withColumn("block", F.pmod(F.xxhash64("rid", "piece", F.lit(number)), blocks)).select("spec_id", "block", "capacity", "rid", "doc_id", "piece", "token_from", "size")
    x = x.repartition("spec_id", "block").sortWithinPartitions("spec_id", "block", "rid", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
            spec, block, capacity = key
            out = [(spec, capacity, f"{spec}-{number}-{block}-{w}", rows[i][0], rows[i][2], rows[i][1], rows[i][3], rows[i][4]) for w, g in enumerate(pack([r[4] for r in rows], capacity)) for i in g]
            cols = list(zip(*out, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["spec_id", "capacity", "container", "rid", "piece", "doc_id", "token_from", "size"])

        key, rows = None, []
        for b in batches:
            for s, bl, c, *r in zip(*(b.column(k).to_pylist() for k in ("spec_id", "block", "capacity", "rid", "doc_id", "piece", "token_from", "size")), strict=True):
                if (s, bl, c) != key:
                    if rows:
                        yield done(key, rows)
                    key, rows = (s, bl, c), []
                rows.append(tuple(r))
        if rows:
            yield done(key, rows)

    return x.mapInArrow(run, PACKED)


def containers(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, capacity, container, doc_id, piece, token_from, size: where each part of each
    text lies. ``sizes`` has (doc_id, n_tokens)."""
    base = stored(sizes.select("doc_id", "n_tokens").withColumn("rid", F.monotonically_increasing_id()), "p8-sizes")
    spec = specs.filter(F.col("capacity_tokens") > 0).select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    x = base.crossJoin(F.broadcast(spec))  # the table of capacities is small and fixed
    n_full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("int")
    x = x.withColumn("n_full", n_full)
    full = x.filter("n_full > 0").select("spec_id", "capacity", "rid", "doc_id", F.explode(F.sequence(F.lit(1), "n_full")).alias("piece"))
    full = full.select("spec_id", "capacity", F.concat_ws("-", "spec_id", F.lit("full"), "rid", "piece").alias("container"), "rid", "piece", "doc_id", ((F.col("piece") - 1) * F.col("capacity")).alias("token_from"), F.col("capacity").alias("size"))
    rest = x.select("spec_id", "capacity", "rid", "doc_id", (F.col("n_full") + 1).alias("piece"), (F.col("n_full") * F.col("capacity")).alias("token_from"), (F.col("n_tokens") - F.col("n_full") * F.col("capacity")).alias("size"))
    rest = rest.filter("size > 0 OR piece = 1")
    first = stored(_round(rest, 1), "p8-first")
    fill = first.groupBy("container").agg(F.sum("size").alias("filled"))
    poor = first.join(fill, "container").withColumn("poor", F.col("filled") < F.col("capacity") * GOOD)
    poor = stored(poor.drop("filled"), "p8-graded")
    again = _round(poor.filter("poor").select("spec_id", "capacity", "rid", "doc_id", "piece", "token_from", "size"), 2)
    cols = ["spec_id", "capacity", "container", "doc_id", "piece", "token_from", "size"]
    return full.select(cols).unionByName(poor.filter("NOT poor").select(cols)).unionByName(again.select(cols))


def report(placed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, share of the space that is used, and divided texts."""
    per = placed.groupBy("spec_id", "capacity", "container").agg(F.sum("size").alias("filled"))
    a = per.groupBy("spec_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"))
    return a.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
