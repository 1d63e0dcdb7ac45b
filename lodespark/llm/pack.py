"""Filling containers of fixed capacity with items of varying length.

Items of one length are interchangeable, so a class of items is solved on its histogram of lengths, which
has at most ``capacity`` rows whatever the number of items. The solver hashes complements: for the gap left
by the largest item it looks up single lengths, then pairs, then triples of lengths that sum to exactly the gap, and
uses the found pattern as often as the counts allow. If no combination fits exactly, the largest item that fits
goes in (best fit) and the search repeats for the smaller gap. Every pattern uses up at least one length, so
there are few patterns. Items then get their container from their number among the items of their
length, which is counted in hash buckets so that no length has to pass through one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.session import cut_lineage

BUCKETS = 64


class _Histogram:
    """Counts by length, with a hashed index of the sums of two available lengths."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, c in counts.items():
            self.n[length] += c
        self.reindex()

    def reindex(self) -> None:
        have = self.n > 0
        have[0] = False
        self.pair = np.zeros(len(self.n), bool)
        for x in np.flatnonzero(have):
            self.pair[x:] |= have[: len(self.n) - x]

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] > 0 else None

    def two(self, gap: int, taken: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """The pair with the largest first length that sums to the gap."""
        if gap < 2 or not self.pair[gap]:
            return None
        left = self.n.copy() if taken else self.n
        for t in taken:
            left[t] -= 1
        x = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
        ok = (left[x] > 0) & (left[gap - x] > 0) & ((x != gap - x) | (left[x] > 1))
        hit = int(np.argmax(ok)) if len(ok) else 0
        return (int(x[hit]), int(gap - x[hit])) if len(ok) and ok[hit] else None

    def three(self, gap: int) -> tuple[int, ...] | None:
        if gap < 3:
            return None
        x = np.arange(gap - 2, 0, -1)
        for v in x[(self.n[x] > 0) & self.pair[gap - x]]:
            found = self.two(gap - int(v), (int(v),))
            if found:
                return (int(v), *found)
        return None

    def fill(self, gap: int) -> tuple[tuple[int, ...], bool]:
        """Lengths for a gap, and whether they fill it."""
        for f in (self.single, self.two, self.three):
            found = f(gap)
            if found:
                return found, True
        fits = np.flatnonzero(self.n[1 : gap + 1])
        return ((int(fits[-1]) + 1,), False) if len(fits) else ((), True)


def pack_histogram(capacity: int, counts: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Patterns (number of items by length in one container) and how many containers use each.

    All lengths must lie between 1 and the capacity.
    """
    h, out, since = _Histogram(capacity, counts), [], 0
    while True:
        have = np.flatnonzero(h.n)
        if not len(have):
            return out
        pattern, gap = {int(have[-1]): 1}, capacity - int(have[-1])
        h.n[have[-1]] -= 1
        closed = False
        while gap and not closed:
            found, closed = h.fill(gap)
            for x in found:
                pattern[x] = pattern.get(x, 0) + 1
                h.n[x] -= 1
                gap -= x
        times = 1 + min(int(h.n[x]) // m for x, m in pattern.items())
        for x, m in pattern.items():
            h.n[x] -= m * (times - 1)
        out.append((pattern, times))
        since += 1
        if since == 32:
            h.reindex()
            since = 0


def _solve(group: pd.DataFrame) -> pd.DataFrame:
    capacity = int(group["capacity"].iloc[0])
    rows, used, first = [], {}, 0
    for pattern, times in pack_histogram(capacity, dict(zip(group["piece_length"].tolist(), group["c"].tolist()))):
        for length, each in pattern.items():
            start = used.get(length, 0)
            used[length] = start + each * times
            rows.append((group["work_class"].iloc[0], length, start, start + each * times, each, first))
        first += times
    return pd.DataFrame(rows, columns=["work_class", "piece_length", "from_rank", "to_rank", "each", "first_container"])


def batch_items(batches: DataFrame) -> DataFrame:
    """``batch_id, work_class, item_idx, length`` of every item; the length leaves out trailing pad tokens.

    A batch that is delivered twice counts once. A null ``pad_token_id`` pads nothing; a null inner list
    has the recorded length, or 0. Batches with a null id or no items give no rows.
    """
    pad = F.col("pad_token_id")

    def true_length(x, i):
        solid = F.transform(F.reverse(x), lambda v: F.coalesce(v != pad, F.lit(True)))
        at = F.array_position(solid, True)
        trimmed = F.when(at == 0, F.lit(0)).otherwise((F.size(x) - at + 1).cast("int"))
        recorded = F.coalesce(F.get(F.col("lengths"), i), F.lit(0))
        return F.when(x.isNull(), recorded).when(F.size(x) == 0, F.lit(0)).when(F.coalesce(F.get(x, F.size(x) - 1) != pad, F.lit(True)), F.size(x)).otherwise(trimmed)

    rows = batches.filter("batch_id is not null").select("batch_id", "created_at", "work_class", F.transform("token_ids", true_length).alias("sizes"))
    once = rows.groupBy("batch_id").agg(F.min(F.struct("created_at", "work_class", "sizes")).alias("x"))
    return once.select("batch_id", "x.work_class", F.posexplode("x.sizes").alias("item_idx", "length"))


def pack_items(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """The container of every item or piece.

    ``items``: ``batch_id, item_idx, work_class, length``; ``budgets``: ``work_class, max_batch_tokens``, one row a class.
    Result: ``batch_id, item_idx, work_class, piece_no, piece_start, piece_length, container_no`` (containers are numbered from 0 in
    each class). An item above the capacity is cut into pieces of the capacity and a rest; no other item
    is cut. Items of length 0 take no space and lie in container 0. Items of a null or unknown class, or one without a
    positive capacity, come out whole with a null container. Empty tables give empty results.
    """
    caps = budgets.filter("work_class is not null and max_batch_tokens > 0").groupBy("work_class").agg(F.max("max_batch_tokens").alias("capacity"))
    items = items.select("batch_id", "item_idx", "work_class", "length").join(caps, "work_class", "left")
    cut = F.when((F.col("capacity").isNull()) | (F.col("length") == 0), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), ((F.col("length") - 1) / F.col("capacity")).cast("int"))
    )
    pieces = items.select("*", F.explode(cut).alias("piece_no")).select(
        "batch_id", "item_idx", "work_class", "capacity", "piece_no",
        F.coalesce(F.col("piece_no") * F.col("capacity"), F.lit(0)).alias("piece_start"),
        F.coalesce(F.least("capacity", F.col("length") - F.col("piece_no") * F.col("capacity")), F.col("length")).alias("piece_length"),
    )
    pieces = cut_lineage(pieces.withColumn("bucket", F.pmod(F.xxhash64("batch_id", "item_idx", "piece_no"), F.lit(BUCKETS)).cast("int")))
    filled = pieces.filter("capacity is not null and piece_length > 0")
    counts = cut_lineage(filled.groupBy("work_class", "capacity", "piece_length", "bucket").agg(F.count(F.lit(1)).alias("c")))
    before = Window.partitionBy("work_class", "piece_length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = counts.groupBy("work_class", "capacity", "piece_length").agg(F.sum("c").alias("c"))
    runs = hist.groupBy("work_class").applyInPandas(
        _solve, "work_class string, piece_length int, from_rank long, to_rank long, each int, first_container long"
    )
    # Each bucket holds the items of ranks ``offset`` to ``offset + c - 1`` of its length, and gets only the runs that these meet: no item
    # looks through all runs of its length, and the runs of a bucket go where its items are numbered, by the same key.
    spans = counts.select("work_class", "piece_length", "bucket", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    meets = (F.col("from_rank") < F.col("offset") + F.col("c")) & (F.col("to_rank") > F.col("offset"))
    spans = spans.join(runs, ["work_class", "piece_length"]).filter(meets)
    spans = spans.groupBy("work_class", "piece_length", "bucket", "offset").agg(F.sort_array(F.collect_list(F.struct("from_rank", "to_rank", "each", "first_container"))).alias("runs"))
    own = Window.partitionBy("work_class", "piece_length", "bucket").orderBy("batch_id", "item_idx", "piece_no")
    ranked = filled.withColumn("nth", F.row_number().over(own) - 1).join(spans, ["work_class", "piece_length", "bucket"]).withColumn("rank", F.col("offset") + F.col("nth"))
    run = F.filter("runs", lambda r: (r["from_rank"] <= F.col("rank")) & (F.col("rank") < r["to_rank"]))[0]
    out = ["batch_id", "item_idx", "work_class", "piece_no", "piece_start", "piece_length"]
    placed = ranked.withColumn("r", run).select(*out, (F.col("r.first_container") + F.floor((F.col("rank") - F.col("r.from_rank")) / F.col("r.each"))).alias("container_no"))
    rest = pieces.filter("capacity is null or piece_length = 0").select(*out, F.when(F.col("capacity").isNotNull(), F.lit(0)).cast("long").alias("container_no"))
    return placed.unionByName(rest)


def container_fills(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``work_class, container_no, capacity, n_pieces, fill, unused`` of every container."""
    caps = budgets.filter("work_class is not null and max_batch_tokens > 0").groupBy("work_class").agg(F.max("max_batch_tokens").alias("capacity"))
    fills = packed.filter("container_no is not null").groupBy("work_class", "container_no").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("piece_length").alias("fill"))
    return fills.join(caps, "work_class").select("work_class", "container_no", "capacity", "n_pieces", "fill", (F.col("capacity") - F.col("fill")).alias("unused"))
