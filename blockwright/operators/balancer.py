"""Equal re-balancing of lost block ranges over the survivors."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ownership:
    """Who owns which ranges: ``table`` has round, seq, start, len, owner."""

    table: DataFrame
    alive: tuple[int, ...]
    round: int = 0

    @staticmethod
    def of(ranges: DataFrame, ranks: int) -> Ownership:
        """From (start, len, owner), which must be in owner order by start."""
        numbered = ranges.withColumn("seq", F.row_number().over(Window.orderBy("owner", "start")))
        return Ownership(numbered.select(F.lit(0).alias("round"), "seq", "start", "len", "owner"), tuple(range(ranks)))

    def plan(self, dead: Iterable[int]) -> DataFrame:
        """Pieces (start, len, dest, at) that give the ranges of ``dead`` to the
        survivors: the lost ranges, laid end to end, are cut into one slice
        per survivor; sizes differ by one at most and no piece spans two ranges."""
        dead = [int(d) for d in dead]
        spark = self.table.sparkSession
        survivors = [r for r in self.alive if r not in dead]
        empty = spark.createDataFrame([], "start long, len long, dest int, at long")
        if not dead:
            return empty
        if not survivors:
            raise ValueError("no rank is alive")
        place = F.array_position(F.array(*map(F.lit, dead)), F.col("owner"))
        before = Window.orderBy("round", "place", "seq").rowsBetween(Window.unboundedPreceding, -1)
        lost = self.table.where(F.col("owner").isin(dead)).withColumn("place", place)
        lost = lost.select("start", "len", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("at"))
        n, a = F.col("total"), len(survivors)
        total = lost.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
        seats = spark.createDataFrame([(i, r) for i, r in enumerate(survivors)], "i long, dest int").crossJoin(F.broadcast(total))
        base, extra = F.floor(n / a), F.pmod(n, F.lit(a))
        low = F.col("i") * base + F.least("i", extra)
        seats = seats.select("dest", low.alias("low"), (low + base + (F.col("i") < extra).cast("long")).alias("high"))
        met = lost.join(F.broadcast(seats), (F.col("at") < F.col("high")) & (F.col("at") + F.col("len") > F.col("low")))
        first = F.greatest("at", "low")
        size = F.least(F.col("at") + F.col("len"), F.col("high")) - first
        return met.select((F.col("start") + first - F.col("at")).alias("start"), size.alias("len"), "dest", first.alias("at")).where("len > 0")

    def settled(self) -> Ownership:
        """The same with its table computed: a row per range and piece of one, so it
        grows with ranks and failures, not with blocks."""
        rows = self.table.collect()
        return Ownership(self.table.sparkSession.createDataFrame(rows, self.table.schema), self.alive, self.round)

    def settled_plan(self, dead: Iterable[int]) -> DataFrame:
        """The plan, computed once: at most a piece per lost range and survivor."""
        found = self.plan(dead)
        return found.sparkSession.createDataFrame(found.collect(), found.schema)

    def plan_for(self, dead: Iterable[int], rank: int) -> DataFrame:
        return self.plan(dead).where(F.col("dest") == rank).select("start", "len")

    def commit(self, dead: Iterable[int]) -> Ownership:
        """The ownership after the plan took effect; planning alone changes nothing."""
        dead = [d for d in dead if d in self.alive]
        if not dead:
            return self
        new = self.plan(dead)
        seq = F.row_number().over(Window.orderBy("at"))
        rows = new.select(F.lit(self.round + 1).alias("round"), seq.alias("seq"), "start", "len", F.col("dest").alias("owner"))
        return Ownership(self.table.unionByName(rows), tuple(r for r in self.alive if r not in dead), self.round + 1)


def contiguous(spark: SparkSession, blocks: int, ranks: int) -> DataFrame:
    """start, len, owner of ranks that own consecutive ranges."""
    from blockwright.plans.placement import Placement

    return Placement(blocks, ranks, 1).ranges(spark).select("start", F.col("length").alias("len"), F.col("range_id").cast("int").alias("owner"))
