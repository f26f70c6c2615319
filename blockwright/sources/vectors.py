"""A flat vector as a table of padded blocks, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_blocks(values: DataFrame, size: int, pad=0) -> DataFrame:
    """(id, value) -> (block_id, elems of ``size``, true length)."""
    if size < 1:
        raise ValueError("block size must be positive")
    pairs = F.array_sort(F.collect_list(F.struct("id", "value")))
    blocks = values.groupBy(F.floor(F.col("id") / size).cast("long").alias("block_id")).agg(pairs.alias("p"))
    elems = F.transform("p", lambda x: x["value"])
    return blocks.select("block_id", F.concat(elems, F.array_repeat(F.lit(pad), F.lit(size) - F.size("p"))).alias("elems"), F.size("p").cast("long").alias("length"))


def from_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """Back to (id, value); padding goes by the stored length, so trailing
    values equal to the pad survive."""
    flat = blocks.select("block_id", "length", F.posexplode("elems").alias("at", "value")).where("at < length")
    return flat.select((F.col("block_id") * size + F.col("at")).alias("id"), "value")
