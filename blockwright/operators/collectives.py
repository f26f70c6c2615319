"""Collective operations over a column that names the logical rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = {
    "max": F.max, "min": F.min, "sum": F.sum, "prod": F.product,
    "land": lambda c: F.bool_and(c.cast("boolean")), "lor": lambda c: F.bool_or(c.cast("boolean")),
    "band": F.bit_and, "bor": F.bit_or,
}
IDENTITY = {"sum": 0, "prod": 1, "land": True, "lor": False, "band": -1, "bor": 0}
#: Least and greatest value of a type: the identities of max and min.
LIMITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def identity(op: str, kind: str = "bigint") -> Column:
    if op in IDENTITY:
        return F.lit(IDENTITY[op])
    if kind in ("float", "double"):
        return F.lit(float("-inf" if op == "max" else "inf")).cast(kind)
    if kind not in LIMITS:
        return F.lit(None).cast(kind)
    most = 1 << (LIMITS[kind] - 1)
    return F.lit(-most if op == "max" else most - 1).cast(kind)


def reduce(op: str, value: Column, kind: str = "bigint") -> Column:
    """A reduction with its identity on empty input."""
    if op not in OPS:
        raise ValueError(f"no such reduction: {op}")
    return F.coalesce(OPS[op](value), identity(op, kind))


def allreduce(rows: DataFrame, **ops: tuple[str, str]) -> DataFrame:
    """One row; ``name=(op, column)``."""
    kinds = dict(rows.dtypes)
    return rows.agg(*(reduce(op, F.col(c), kinds[c]).alias(name) for name, (op, c) in ops.items()))


def allreduce_vector(rows: DataFrame, column: str, op: str = "sum") -> DataFrame:
    """Element-wise reduction of an array column: position, value."""
    parts = rows.select(F.posexplode(column).alias("position", "value"))
    return parts.groupBy("position").agg(reduce(op, F.col("value"), dict(parts.dtypes)["value"]).alias("value"))


def allgather(rows: DataFrame, rank: str, value: str) -> DataFrame:
    """One value per rank, in rank order (as many entries as ranks)."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v"))))
    return rows.agg(F.transform(pairs, lambda x: x["v"]).alias("gathered"))


def gatherv(rows: DataFrame, rank: str, position: str) -> DataFrame:
    """All rows in (rank, position) order: a distributed sort, not a collect."""
    return rows.orderBy(rank, position)


def exclusive_scan(per_rank: DataFrame, rank: str, value: str, name: str = "scan", op: str = "sum") -> DataFrame:
    """Reduction over lesser ranks, its identity on the first; takes one row per rank."""
    before = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return per_rank.withColumn(name, F.coalesce(OPS[op](F.col(value)).over(before), identity(op, dict(per_rank.dtypes)[value])))


def broadcast_value(ranks: DataFrame, rank: str, value: str, root: int) -> DataFrame:
    """Every rank with the value of ``root``, one row per rank."""
    one = ranks.where(F.col(rank) == root).select(F.col(value).alias("received")).limit(1)
    return ranks.select(rank).join(F.broadcast(one))


def alltoallv(sent: DataFrame, source: str, dest: str, position: str) -> DataFrame:
    """What each rank gets, in the order of source and position: ``at`` counts from 0."""
    order = Window.partitionBy(dest).orderBy(source, position)
    return sent.withColumn("at", (F.row_number().over(order) - 1).cast("long"))
