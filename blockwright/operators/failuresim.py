"""Failure simulation in closed form: no loop over failures.

Per repetition ranks (or groups of ranks) die in a hashed order.  A range is
lost when the last of its replicas dies, data is lost with the first lost
range: the maximum of death times over replicas, the minimum over ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRIME = 1_000_003


def draw(*parts: Column) -> Column:
    """A reproducible pseudo-random whole number below PRIME, by arithmetic."""
    h = F.lit(12345).cast("long")
    for p in parts:
        h = F.pmod((h + p.cast("long") + 1) * F.lit(48271), F.lit(PRIME))
        h = F.pmod(h * h + h * 7 + 11, F.lit(PRIME))
    return h


def per_iteration(rate: float, iterations: int) -> float:
    """The failure probability per iteration that gives ``rate`` in all."""
    if not 0 <= rate < 1 or iterations < 1:
        raise ValueError("rate in [0, 1), at least one iteration")
    return 1 - (1 - rate) ** (1 / iterations)


def bernoulli_failures(spark: SparkSession, ranks: int, iterations: int, probability: float) -> DataFrame:
    """iteration, rank of each first failure of a rank."""
    both = spark.range(iterations).select(F.col("id").alias("iteration")).crossJoin(spark.range(ranks).select(F.col("id").alias("rank")))
    hit = both.where(draw(F.col("iteration"), F.col("rank")) < int(probability * PRIME))
    return hit.groupBy("rank").agg(F.min("iteration").alias("iteration"))


def fail_exactly(spark: SparkSession, ranks: int, m: int, seed: int = 0) -> DataFrame:
    every = spark.range(ranks).select(F.col("id").alias("rank"))
    return every.orderBy(draw(F.lit(seed), F.col("rank")), "rank").limit(m)


def failures_until_loss(spark: SparkSession, ranks: int, replicas: int, repetitions: int, group: int = 1) -> DataFrame:
    """repetition, failures: failed ranks when data is lost; ``group``
    consecutive ranks (a node, a rack) die at once."""
    groups = -(-ranks // group)
    dead = spark.range(repetitions).select(F.col("id").alias("repetition")).crossJoin(spark.range(groups).select(F.col("id").alias("g")))
    order = Window.partitionBy("repetition").orderBy(draw(F.col("repetition"), F.col("g")), "g")
    dead = dead.withColumn("time", F.row_number().over(order))
    copies = spark.range(ranks).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("j"))
    copies = copies.select("k", F.floor(F.pmod(F.col("k") + F.col("j") * (ranks // replicas), F.lit(ranks)) / group).alias("g"))
    lost = dead.join(copies, "g").groupBy("repetition", "k").agg(F.max("time").alias("time"))
    return lost.groupBy("repetition").agg(F.least(F.min("time") * group, F.lit(ranks)).alias("failures"))


def expected_failures(ranks: int, replicas: int) -> float:
    """Exact expectation.  Let every rank die at a uniform time: none of the g = p / r
    groups of ranks with the same ranges is lost by time u with probability
    (1 - u^r)^g, and integrating over u weighs each number of failures
    with 1 / (p + 1); the integral is a beta function."""
    if ranks % replicas:
        raise ValueError("replicas must divide ranks")
    groups, share = ranks // replicas, 1 / replicas
    return (ranks + 1) * math.exp(math.lgamma(1 + share) + math.lgamma(groups + 1) - math.lgamma(groups + 1 + share))


def approximate_failures(ranks: Column, replicas: Column) -> Column:
    """r^(1/r) / p^(1/r) * p."""
    return F.pow(replicas, 1 / replicas) / F.pow(ranks, 1 / replicas) * ranks
