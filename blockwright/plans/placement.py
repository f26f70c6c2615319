"""Placement of block ranges on logical ranks, as column expressions.

``blocks`` ids 0..N-1 are cut into one range per rank; the first ``N mod p``
ranges hold one block more.  Replica ``j`` of range ``k`` lies on rank
``(k + s j) mod p`` with ``s = p div r``.  Nothing here touches data: every
operator is a closed form over ids, so it runs inside the scan's codegen.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.functions.scalars import div


class DataLossError(RuntimeError):
    """Some block range has no alive replica left."""


@dataclass(frozen=True)
class Placement:
    blocks: int
    ranks: int
    replicas: int

    def __post_init__(self):
        if self.blocks < 1 or self.replicas < 1:
            raise ValueError("blocks and replicas must be positive")
        if self.replicas > self.ranks:
            raise ValueError("more replicas than ranks")
        if self.blocks < self.ranks:
            raise ValueError("fewer blocks than ranks")

    @property
    def per_range(self) -> int:
        return self.blocks // self.ranks

    @property
    def larger_ranges(self) -> int:
        return self.blocks % self.ranks

    @property
    def shift(self) -> int:
        return self.ranks // self.replicas

    def range_of(self, block: Column) -> Column:
        """The range of a block; an id outside 0..N-1 raises."""
        b, x = self.per_range, self.larger_ranges
        head = (b + 1) * x
        ok = (block >= 0) & (block < self.blocks)
        inside = F.when(block < head, div(block, b + 1)).otherwise(x + div(block - head, b)).cast("long")
        return F.when(ok, inside).when(block.isNotNull(), F.raise_error(F.lit("block id outside the store")).cast("long"))

    def start(self, k: Column) -> Column:
        b, x = self.per_range, self.larger_ranges
        return F.when(k < x, k * (b + 1)).otherwise(k * b + x).cast("long")

    def length(self, k: Column) -> Column:
        return F.when(k < self.larger_ranges, self.per_range + 1).otherwise(self.per_range).cast("long")

    def last(self, k: Column) -> Column:
        return self.start(k) + self.length(k) - 1

    def contains(self, k: Column, block: Column) -> Column:
        return block.between(self.start(k), self.last(k))

    def ranks_of(self, k: Column) -> Column:
        """Ranks of a range's replicas, in replica order."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.replicas - 1)), lambda j: F.pmod(k + j * self.shift, F.lit(self.ranks)).cast("int"))

    def alive_ranks_of(self, k: Column, dead: Iterable[int]) -> Column:
        gone = F.array(*(F.lit(int(d)) for d in dead)).cast("array<int>")
        return F.filter(self.ranks_of(k), lambda rank: ~F.array_contains(gone, rank))

    def is_stored_on(self, k: Column, rank: Column, dead: Iterable[int] = ()) -> Column:
        valid = (rank >= 0) & (rank < self.ranks)
        held = F.array_contains(self.alive_ranks_of(k, dead), rank.cast("int"))
        return F.when(valid, held).when(rank.isNotNull(), F.raise_error(F.lit("no such rank")).cast("boolean"))

    def serving_rank(self, k: Column, seed: Column, dead: Iterable[int] = (), hashed=None) -> Column:
        """An alive replica by hash of ``seed``: number ``h mod r`` of the alive
        ones, or ``h mod alive`` where fewer are left; null when none is."""
        alive = self.alive_ranks_of(k, dead)
        h = F.shiftrightunsigned(F.xxhash64(seed), 1) if hashed is None else hashed
        first = F.pmod(h, F.lit(self.replicas))
        place = F.when(first < F.size(alive), first).otherwise(F.pmod(h, F.greatest(F.size(alive), F.lit(1))))
        return F.when(F.size(alive) > 0, F.get(alive, place.cast("int")))

    def ranges(self, spark: SparkSession) -> DataFrame:
        """One row per range: range_id, start, length, last."""
        k = F.col("range_id")
        return spark.range(self.ranks).select(F.col("id").alias("range_id")).select("range_id", self.start(k).alias("start"), self.length(k).alias("length"), self.last(k).alias("last"))

    def replicas_table(self, spark: SparkSession) -> DataFrame:
        """One row per (range, replica number, rank)."""
        return self.ranges(spark).select("range_id", F.posexplode(self.ranks_of(F.col("range_id"))).alias("replica", "rank"))

    def lost_ranges(self, spark: SparkSession, dead: Iterable[int]) -> DataFrame:
        return self.ranges(spark).where(F.size(self.alive_ranks_of(F.col("range_id"), dead)) == 0)

    def check_no_loss(self, spark: SparkSession, dead: Iterable[int]) -> None:
        lost = [r[0] for r in self.lost_ranges(spark, dead).select("range_id").collect()]  # at most one row per rank
        if lost:
            raise DataLossError(f"ranges without an alive replica: {lost}")
