"""Rank bookkeeping: who is alive, under which number."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def current_ranks(spark: SparkSession, ranks: int, dead: Iterable[int]) -> DataFrame:
    """original_rank -> current_rank; null for dead ranks."""
    gone = [int(d) for d in dead]
    every = spark.range(ranks).select(F.col("id").cast("int").alias("original_rank"))
    alive = ~F.col("original_rank").isin(gone) if gone else F.lit(True)
    return every.withColumn("current_rank", F.when(alive, F.sum(alive.cast("int")).over(Window.orderBy("original_rank")) - 1).cast("int"))


@dataclass(frozen=True)
class Ranks:
    """Original size, survivors, and the survivors when last asked."""

    size: int
    alive: tuple[int, ...]
    seen: tuple[int, ...]

    @staticmethod
    def of(size: int) -> Ranks:
        everyone = tuple(range(size))
        return Ranks(size, everyone, everyone)

    def fail(self, dead: Iterable[int]) -> Ranks:
        gone = set(dead)
        return Ranks(self.size, tuple(r for r in self.alive if r not in gone), self.seen)

    def died_since_last_call(self) -> tuple[tuple[int, ...], Ranks]:
        died = tuple(r for r in self.seen if r not in self.alive)
        return died, Ranks(self.size, self.alive, self.alive)

    def current(self, original: int) -> int | None:
        return self.alive.index(original) if original in self.alive else None

    def original(self, current: int) -> int:
        return self.alive[current]

    def only_alive(self, ranks: Iterable[int]) -> list[int]:
        return [r for r in ranks if r in self.alive]

    @property
    def failures(self) -> int:
        return self.size - len(self.alive)

    def rebase(self) -> Ranks:
        return Ranks.of(len(self.alive))


def only_alive(rows: DataFrame, column: str, dead: Iterable[int]) -> DataFrame:
    gone = [int(d) for d in dead]
    return rows.where(~F.col(column).isin(gone)) if gone else rows


def died_between(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after, before.columns, "left_anti")
