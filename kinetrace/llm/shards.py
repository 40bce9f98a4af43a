"""Sharding: the minimax contiguous partition of ordered groups of equal texts, by bytes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stash, table

#: Bits of the key in the first summary, and bits more in each finer one.
FIRST_BITS, MORE_BITS = 12, 8


class Summary:
    """Consecutive segments of the ordered groups: (bits, prefix of the key, bytes, groups), in key order.

    A segment of one group is atomic.  Larger segments are only known by their sums.
    """

    def __init__(self, segments: list[tuple[int, int, int, int]]):
        self.segments = sorted(segments, key=lambda s: s[1] << (64 - s[0]))
        self.ends = [0, *accumulate(s[2] for s in self.segments)]
        self.total = self.ends[-1]

    def low(self, i: int) -> int:
        bits, prefix, _, _ = self.segments[i]
        return prefix << (64 - bits)

    def atomic(self, i: int) -> bool:
        return self.segments[i][3] == 1 or self.segments[i][0] == 64

    def fits(self, capacity: int, shards: int, start: int = 0) -> bool:
        """Whether a greedy fill of whole segments needs at most so many shards."""
        n = len(self.segments)
        for _ in range(shards):
            if start >= n:
                return True
            end = bisect_right(self.ends, self.ends[start] + capacity) - 1
            if end <= start:
                return False
            start = end
        return start >= n

    def fluid(self, capacity: int, shards: int) -> tuple[bool, list[int]]:
        """The same where segments of several groups may be cut at any byte; also the places in bytes of the cuts."""
        at, cuts = 0, []
        for _ in range(shards):
            if at >= self.total:
                break
            to = at + capacity
            if to < self.total:
                i = bisect_right(self.ends, to) - 1
                if self.atomic(i):
                    to = self.ends[i]
            if to <= at:
                return False, cuts
            at = to
            cuts.append(at)
        return at >= self.total, cuts

    def atomic_cuts(self, capacity: int, shards: int) -> list[int]:
        at, cuts = 0, []
        for _ in range(shards):
            end = bisect_right(self.ends, self.ends[at] + capacity) - 1
            at = max(end, at)
            cuts.append(self.ends[at])
        return cuts

    def least(self, feasible, low: int) -> int:
        high = self.total
        while low < high:
            mid = (low + high) // 2
            if feasible(mid):
                high = mid
            else:
                low = mid + 1
        return low

    def unclear(self, shards: int) -> tuple[list[int], int]:
        """The segments to look into before the smallest capacity is known, and that capacity if there are none."""
        if not self.segments:
            return [], 0
        floor = max([s[2] for i, s in enumerate(self.segments) if self.atomic(i)], default=0)
        low = self.least(lambda c: self.fluid(c, shards)[0], floor)
        high = self.least(lambda c: self.fits(c, shards), max(s[2] for s in self.segments))
        first, last = self.atomic_cuts(low, shards), self.fluid(high, shards)[1]
        found: set[int] = set()
        for k in range(min(len(first), len(last))):
            i, j = bisect_right(self.ends, first[k]) - 1, bisect_left(self.ends, last[k])
            found.update(x for x in range(max(i, 0), min(j + 1, len(self.segments))) if not self.atomic(x))
        return sorted(found), high

    def level_cuts(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Cuts as level as the capacity allows (segment indices), and the segments to look into for better ones.

        Each shard takes the group boundary nearest to an equal share of what is left, if it
        keeps to the capacity and leaves the rest feasible; else all that the capacity holds.
        """
        n, at, cuts, look = len(self.segments), 0, [], []
        for k in range(shards - 1):
            if at >= n:
                break
            share = (self.total - self.ends[at]) / (shards - k)
            goal = self.ends[at] + min(capacity, share)
            i = min(max(bisect_right(self.ends, goal) - 1, at), n - 1)
            if not self.atomic(i) and self.ends[i] < goal:
                look.append(i)
            near = sorted({i, i + 1}, key=lambda e: abs(self.ends[e] - goal))
            full = max(bisect_right(self.ends, self.ends[at] + capacity) - 1, at + 1)
            at = next((e for e in near if e > at and self.ends[e] - self.ends[at] <= capacity and self.fits(capacity, shards - k - 1, e)), full)
            cuts.append(at)
        return cuts, look


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the first keys of shards 1 to shards - 1 (some may be missing at the end).

    groups: (k, bytes), one row per group.  The driver gets sums over key ranges, at
    most 4096 at first, then only finer sums of those ranges in which a cut may fall.
    """

    def sums(df: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        got = df.groupBy(F.shiftright("k", 64 - bits).alias("p")).agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return [(bits, r.p, r.s, r.n) for r in got]

    at = Summary(sums(groups, FIRST_BITS))
    while True:
        look, capacity = at.unclear(shards)
        cuts: list[int] = []
        if not look:
            cuts, look = at.level_cuts(capacity, shards)
        if not look:
            return capacity, [at.low(c) for c in cuts if c < len(at.segments)]
        fine: list[tuple[int, int, int, int]] = []
        for bits in {at.segments[i][0] for i in look}:
            own = [at.segments[i][1] for i in look if at.segments[i][0] == bits]
            fine += sums(groups.where(F.shiftright("k", 64 - bits).isin(own)), min(64, bits + MORE_BITS))
        at = Summary([s for i, s in enumerate(at.segments) if i not in set(look)] + fine)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: law ``bytes``, groups of equal texts kept together.

    Groups are ordered by a 64-bit hash of their text (equal hashes count as one group).
    A null text has no bytes, the checksum 0, and lies with the empty ones.  Repeated rows
    are placed each, and rows of one group, id and size in any order.  Columns other than doc_id and
    text are left out.  An empty table gives no rows.  Only DataFrame functions are used.
    """
    base = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"))
    base = stash(base, "sizes")
    groups = stash(base.groupBy("k").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    _, cuts = plan_cuts(groups, shards)
    shard = sum([(F.col("k") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    placed = numbered(base.withColumn("shard", shard), ["shard"], ["doc_id", "k", "size"], total, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by bytes. See shard_documents for odd rows."""
    return shard_documents(table(spark, sf_dir, "documents"))
