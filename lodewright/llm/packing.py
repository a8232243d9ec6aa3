"""Problem 8: filling containers of fixed capacity by Karmarkar-Karp differencing.

Texts longer than the capacity are cut into full pieces, each a full container, and a rest. All other
texts and the rests are items. Items are dealt by hash into blocks of a bounded number of tokens
and items; within a block multiway largest differencing merges partial partitions, putting the
largest sums of one beside the smallest of the other, so the sums come out near equal. The number of
containers is a lower bound; items of more than half the capacity, which can share none, are apart from
the start. Where sums exceed the capacity, a repair follows: containers that are full stay, the items of
the others move to where they fit best, the largest first, and the number rises as it must.

Near-equal sums are what containers need while items are small beside the capacity. Where most are
near half of it, few sums come out both full and within the capacity, and the repair places most items.
The waste of blocks is that of the last fraction of a container each, so it shrinks as blocks grow.

Defined results: texts of no tokens (null, empty) take no space, they get container null and piece
0. Repeated rows are items of their own, and are dealt to different blocks. Capacities below 1 or null are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right, insort
from itertools import accumulate, count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.llm.common import reliable

CONTAINERS_A_BLOCK = 6_000
ITEMS_A_BLOCK = 20_000
SLACKS = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02)  # parts of the capacity that a container which stays in the repair may lack
_BLOCK_BITS = 20  # container id = block << 20 | number in block


def differencing(sizes: list[int], k: int, apart: tuple[int, ...] = ()) -> list[list[int]]:
    """Partition item numbers into ``k`` near-equal bins (largest differencing method).

    A partial partition is held as its non-empty bins, largest first (sums negative, for sorting). ``apart``: at most
    ``k`` items that begin as one partition, each in a bin of its own.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    tie, own = count(), set(apart)
    heap = [(-s, next(tie), [(-s, i)]) for i, s in enumerate(sizes) if i not in own]
    if own:
        big = sorted((-sizes[i], i) for i in own)
        heap.append((big[0][0] - (big[-1][0] if len(big) == k else 0), next(tie), big))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        # b turned round lies against a: bins that meet an empty one just move over, of the others the
        # smallest of a's lot meets the largest of b's.
        over = max(0, len(a) + len(b) - k)
        if not over and a[-1][0] <= b[0][0]:
            a += b
        elif len(b) == 1:
            if over:
                s, n = a.pop()
                b = [(s + b[0][0], (n, b[0][1]))]
            insort(a, b[0], key=_sum)
        else:
            met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]))] if over else []
            a = a[: len(a) - over] + b[: len(b) - over] + met
            a.sort(key=_sum)
        heapq.heappush(heap, (a[0][0] - (a[-1][0] if len(a) == k else 0), next(tie), a))
    bins: list[list[int]] = []
    for _, node in heap[0][2]:
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        bins.append(items)
    return bins


def _sum(part: tuple) -> int:
    return part[0]


def least_bins(sizes: list[int], capacity: int) -> int:
    """Lower bound on containers: items of more than half the capacity share none, and what fits beside them is bounded (for every size below half)."""
    s = sorted(sizes)
    upto = list(accumulate(s, initial=0))
    half = bisect_right(s, capacity // 2)
    best = math.ceil(upto[-1] / capacity)
    for a in dict.fromkeys([0, *s[:half]]):
        low, high = bisect_left(s, a), max(half, bisect_right(s, capacity - a))
        room = (high - half) * capacity - (upto[high] - upto[half])
        best = max(best, len(s) - half + max(0, math.ceil((upto[half] - upto[low] - room) / capacity)))
    return best


def best_fit(sizes: list[int], capacity: int, items: list[int], bins: list[list[int]]) -> list[list[int]]:
    """The bins with ``items`` added, the largest first, each where it leaves the least room; new bins where none has room."""
    made = [list(b) for b in bins]
    room = sorted((capacity - sum(sizes[i] for i in b), j) for j, b in enumerate(made))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, j = room.pop(at)
        else:
            left, j = capacity, len(made)
            made.append([])
        made[j].append(i)
        insort(room, (left - sizes[i], j))
    return made


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, none above ``capacity``: differencing into the least number of bins, then the repair."""
    if not sizes:
        return []
    parts = differencing(sizes, least_bins(sizes, capacity), tuple(i for i, s in enumerate(sizes) if 2 * s > capacity))
    sums = [sum(sizes[i] for i in p) for p in parts]
    if max(sums) <= capacity:
        return parts
    tried = []
    for slack in SLACKS:
        stays = [(1 - slack) * capacity <= s <= capacity for s in sums]
        loose = [i for p, c in zip(parts, stays) if not c for i in p]
        tried.append(best_fit(sizes, capacity, loose, [p for p, c in zip(parts, stays) if c]))
    return min(tried, key=len)


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity, block = int(pdf["n_ctx"].iat[0]), int(pdf["block"].iat[0])
    # An order of its own, so that a task that runs again deals the same bins.
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    sizes = pdf["n_tokens"].tolist()
    number, used = [0] * len(sizes), [0] * len(sizes)
    for j, items in enumerate(fill(sizes, capacity)):
        total = sum(sizes[i] for i in items)
        for i in items:
            number[i], used[i] = j, total
    pdf["container_id"] = [(block << _BLOCK_BITS) | j for j in number]
    pdf["container_used"] = used
    return pdf[["n_ctx", "doc_id", "piece", "start", "n_tokens", "container_id", "container_used"]]


def pack(sizes: DataFrame, capacities: list[int], *, containers_a_block: int = CONTAINERS_A_BLOCK) -> DataFrame:
    """Containers of the rows of ``sizes`` (``doc_id, n_tokens``) for each capacity.

    Returns ``n_ctx, doc_id, piece, start, n_tokens, container_id, container_used, container_waste``.
    Full pieces and items are numbered apart (full pieces have negative container ids), per capacity.
    """
    caps = sorted({int(c) for c in capacities if c and c > 0})
    spark = sizes.sparkSession
    if not caps:
        return spark.createDataFrame([], "n_ctx int, doc_id bigint, piece bigint, start bigint, n_tokens bigint, container_id bigint, container_used bigint, container_waste bigint")
    sizes = reliable(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    each = F.explode(F.array(*[F.lit(c) for c in caps])).alias("n_ctx")
    # Numbered over checkpointed rows, so the same again if a task is repeated; repeated rows get different numbers.
    sized = sizes.withColumn("_row", F.monotonically_increasing_id()).select("doc_id", "n_tokens", "_row", each)
    rest = sized.withColumn("rest", F.col("n_tokens") % F.col("n_ctx"))
    totals = {r["n_ctx"]: r for r in rest.where("rest > 0").groupBy("n_ctx").agg(F.sum("rest").alias("t"), F.count("*").alias("n")).collect()}  # one row a capacity
    blocks = F.lit(1)
    for c in caps:
        if c in totals:
            need = max(totals[c]["t"] / (c * containers_a_block), totals[c]["n"] / ITEMS_A_BLOCK)
            blocks = F.when(F.col("n_ctx") == c, F.lit(max(1, round(need)))).otherwise(blocks)
    whole = F.col("n_tokens").cast("bigint")
    items = rest.where("rest > 0").select(
        "n_ctx", F.col("doc_id").cast("string").alias("doc_id"), F.floor(whole / F.col("n_ctx")).alias("piece"), (whole - F.col("rest")).alias("start"), F.col("rest").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "n_tokens", "_row"), blocks).alias("block"),
    )
    packed = items.groupBy("n_ctx", "block").applyInPandas(
        _pack_block, "n_ctx int, doc_id string, piece bigint, start bigint, n_tokens bigint, container_id bigint, container_used bigint"
    )
    packed = packed.withColumn("doc_id", F.col("doc_id").cast("bigint"))  # as text within, for null ids
    full = sized.where("n_tokens >= n_ctx").select("n_ctx", "doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(1), F.floor(whole / F.col("n_ctx")))).alias("piece", "_k"))
    full = full.select(
        "n_ctx", "doc_id", F.col("piece").cast("bigint").alias("piece"), (F.col("piece").cast("bigint") * F.col("n_ctx")).alias("start"), F.col("n_ctx").cast("bigint").alias("n_tokens"),
        (-F.monotonically_increasing_id() - 1).alias("container_id"), F.col("n_ctx").cast("bigint").alias("container_used"),
    )
    none = F.lit(None).cast("bigint")
    empty = sized.where("n_tokens = 0").select("n_ctx", "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"), "n_tokens", none.alias("container_id"), none.alias("container_used"))
    return packed.unionByName(full).unionByName(empty).withColumn("container_waste", F.col("n_ctx") - F.col("container_used"))


def packing_report(packed: DataFrame) -> DataFrame:
    """One row a capacity: containers, tokens, unused space and the least possible containers."""
    bins = packed.where("container_id is not null").groupBy("n_ctx", "container_id").agg(F.sum("n_tokens").alias("used"))
    per = bins.groupBy("n_ctx").agg(F.count("*").alias("n_containers"), F.sum("used").alias("packed_tokens"), F.max("used").alias("fullest"))
    return per.select(
        "n_ctx", "n_containers", "packed_tokens", "fullest", F.ceil(F.col("packed_tokens") / F.col("n_ctx")).alias("least_containers"),
        (F.col("n_containers") * F.col("n_ctx") - F.col("packed_tokens")).alias("waste_tokens"),
        F.round(1 - F.col("packed_tokens") / (F.col("n_containers") * F.col("n_ctx")), 6).alias("waste_ratio"),
    )
