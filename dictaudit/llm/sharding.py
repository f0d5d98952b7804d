"""Shards of near equal bytes: minimax contiguous partition of atomic groups (operator 5).

Rows with equal texts form a group that is never split. Groups are ordered by the SHA-256 of their
text; shards are contiguous stretches of that order. The capacity is the smallest one with which
the ordered groups fit: a binary search over capacities, each checked greedily.

The order is not collected: it is summed into cells of equal hash prefixes, 4096 cells at first. A
capacity is bounded from below by cutting cells anywhere and from above by never cutting them; the
few cells in which the lower bound's cuts fall are summed again with a longer prefix, until both
bounds meet, which is the exact smallest capacity over single groups. The driver holds a few
thousand cells however many rows there are.

Defined cases: a null text has no bytes and belongs to the group of the empty text; size is bytes
plus one; repeated rows are placed one by one (same shard, own slots); an empty table gives an empty
result; other columns are ignored. Slots of a shard count from 0 in the order of (bucket, id).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dictaudit.session import materialize

PREFIX_STEP = 3  # hexadecimal digits a cell is refined by: 4096 parts
ROWS_PER_BUCKET = 20_000


class Cells:
    """Ordered cells: hash prefix, bytes, groups and largest group of each."""

    def __init__(self, rows):
        rows = sorted(rows)
        self.prefix = [r[0] for r in rows]
        self.bytes, self.groups, self.largest = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        self.ends = np.concatenate([[0], np.cumsum(self.bytes)])

    def replaced(self, refined: dict[str, list]) -> Cells:
        kept = [(p, b, g, m) for p, b, g, m in zip(self.prefix, self.bytes.tolist(), self.groups.tolist(),
                                                    self.largest.tolist()) if p not in refined]
        return Cells(kept + [r for rows in refined.values() for r in rows])

    def greedy(self, capacity: int, shards: int, divisible: bool) -> tuple[bool, list[int], set[int]]:
        """Fill shard after shard. Returns whether all fits, the cuts (cell numbers) and the cells
        that were cut inside."""
        total, at, cuts, inside = int(self.ends[-1]), 0, [], set()
        for _ in range(shards):
            to = at + capacity
            k = int(np.searchsorted(self.ends, to, side="right")) - 1  # cells that fit whole
            if k >= len(self.bytes):
                return True, cuts, inside
            if divisible and self.groups[k] > 1:
                if self.ends[k] < to:
                    inside.add(k)
                at = to
            else:
                at = int(self.ends[k])
            cuts.append(k)
        return at >= total, cuts, inside

    def smallest(self, shards: int, divisible: bool) -> int:
        total = int(self.ends[-1])
        whole = self.largest if divisible else self.bytes
        lo = max(int(whole.max(initial=0)), -(-total // shards))
        hi = max(total, lo)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.greedy(mid, shards, divisible)[0]:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def cut_near_equal(self, capacity: int, shards: int) -> list[int]:
        """Cuts within the capacity, each as near to its share of the total as the capacity allows."""
        n, total = len(self.bytes), int(self.ends[-1])
        late, at = [], 0  # latest cuts: filled from the left
        for _ in range(shards - 1):
            at = max(int(np.searchsorted(self.ends, self.ends[at] + capacity, side="right")) - 1, at)
            late.append(min(at, n))
        early, at = [], n  # earliest cuts: what follows must fit
        for _ in range(shards - 1):
            at = int(np.searchsorted(self.ends, self.ends[at] - capacity, side="left"))
            early.append(at)
        early.reverse()
        cuts, before = [], 0
        for j in range(shards - 1):
            # within reach of the cut before, and so that the rest still fits
            reach = int(np.searchsorted(self.ends, self.ends[before] + capacity, side="right")) - 1
            low, high = max(before, early[j]), min(late[j], reach)
            want = total * (j + 1) / shards
            k = int(np.searchsorted(self.ends, want))
            k = min((c for c in (k - 1, k) if 0 <= c <= n), key=lambda c: abs(self.ends[c] - want), default=0)
            before = min(max(k, low), high)
            cuts.append(before)
        return cuts


def _summed(groups: DataFrame, length: int, within: list[str] | None = None) -> list[tuple]:
    if within is not None:
        groups = groups.where(F.substring("key", 1, len(within[0])).isin(within))
    return [tuple(r) for r in groups.groupBy(F.substring("key", 1, length).alias("prefix")).agg(
        F.sum("bytes"), F.count("*"), F.max("bytes")).collect()]


def shard_bounds(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Smallest keys of shards 1.. and the smallest capacity, over rows (key, bytes) of groups."""
    cells = Cells(_summed(groups, PREFIX_STEP))
    if not len(cells.bytes):
        return [], 0
    while (capacity := cells.smallest(shards, True)) < cells.smallest(shards, False):
        cut = [cells.prefix[k] for k in cells.greedy(capacity, shards, True)[2]]
        refined: dict[str, list] = {p: [] for p in cut}
        for length in {len(p) for p in cut}:
            same = [p for p in cut if len(p) == length]
            for row in _summed(groups, length + PREFIX_STEP, same):
                refined[row[0][:length]].append(row)
        cells = cells.replaced(refined)
    cuts = cells.cut_near_equal(capacity, shards)
    return [cells.prefix[k] if k < len(cells.prefix) else "g" for k in cuts], capacity


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, size, text_crc32, shard and slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key")), "shard-rows")
    # a group of copies is summed before the shuffle
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    bounds, _ = shard_bounds(groups, shards)
    number = sum(((F.col("key") >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    n_rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(4, -(-n_rows // (ROWS_PER_BUCKET * shards)))
    placed = rows.select("doc_id", "size", "text_crc32", number.alias("shard"),
                         F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    cells = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return (placed.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
            .join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).alias("slot")))
