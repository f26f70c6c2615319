"""Dense block ids without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def with_block_ids(rows: DataFrame, keys: list[str], name: str = "block_id", buckets: int = BUCKETS) -> DataFrame:
    """Number the rows 0..N-1 in key order, nulls first; the first key is a whole number.

    The key space is cut twice: at quantiles, so that skewed keys spread, and
    each part into equal widths.  Rows are numbered inside a bucket
    and shifted by the counts of those before (at most ``buckets`` squared)."""
    first = F.col(keys[0]).cast("long")
    shares = [i / buckets for i in range(buckets + 1)]
    found = rows.agg(F.percentile_approx(first, shares, 100 * buckets).alias("cuts")).head()["cuts"] or [0]
    cuts = sorted(set(found))

    def part(low: int, high: int):
        """The last cut that is not above the key, by halving."""
        if high - low == 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(first < cuts[middle], part(low, middle)).otherwise(part(middle, high))

    ends = [*cuts[1:], cuts[-1] + 1]
    lows, widths = (F.array(*map(F.lit, values)).cast("array<long>") for values in (cuts, [max(1, -(-(e - c) // buckets)) for c, e in zip(cuts, ends, strict=True)]))
    dealt = rows.withColumn("_part", part(0, len(cuts)))
    step = F.floor((first - F.get(lows, F.col("_part"))) / F.get(widths, F.col("_part")))
    inside = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), step)).cast("int")
    dealt = dealt.withColumn("_bucket", F.when(first.isNull(), -1).otherwise(F.col("_part") * buckets + inside)).drop("_part")
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)) - 1
    return dealt.withColumn("_inside", number).join(F.broadcast(offsets), "_bucket").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_bucket", "_inside", "_offset")
