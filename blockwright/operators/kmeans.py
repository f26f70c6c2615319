"""k-means over (point_id, v array<double>), aware of failed ranks.

The k x d centers are the only thing on the driver.  An iteration is one pass:
tasks assign their points with one vectorised distance kernel per Arrow batch
and emit k partial sums, which are added by (center, dimension); no point is
shuffled.  Ties go to the lowest center; an empty center stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwright.operators.versioned import TwoPhase

Centers = list[list[float]]


def check(centers: Centers, points: int | None = None) -> None:
    if not centers or not centers[0]:
        raise ValueError("centers need at least one dimension")
    if len({len(c) for c in centers}) != 1:
        raise ValueError("centers differ in dimension")
    if points is not None and (points == 0 or len(centers) > points):
        raise ValueError("more centers than points")


def centers_from_flat(values: list[float], dimensions: int) -> Centers:
    if dimensions < 1 or len(values) % dimensions:
        raise ValueError("length is no multiple of the dimensions")
    return [list(map(float, values[i : i + dimensions])) for i in range(0, len(values), dimensions)]


def pick_centers(points: DataFrame, k: int, seed: int = 0) -> Centers:
    """k different points, by hash of id and seed, from the whole data."""
    if k < 1:
        raise ValueError("k must be positive")
    rows = points.orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(k).select("v").collect()
    if len(rows) < k:
        raise ValueError("more centers than points")
    return [list(map(float, r[0])) for r in rows]


def _matrix(column: pa.Array, width: int):
    """An array column as a matrix, without a value ever becoming a Python object."""
    import numpy as np

    if column.null_count or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("points and centers differ in dimension")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def assign(points: DataFrame, centers: Centers) -> DataFrame:
    """point_id, cid."""
    check(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = np.array(centers)
        for batch in batches:
            x = _matrix(batch.column("v"), c.shape[1])
            best = np.stack([((x - one) ** 2).sum(axis=1) for one in c]).argmin(axis=0) if len(x) else np.zeros(0)
            yield pa.record_batch([batch.column("point_id"), pa.array(best.astype(np.int32))], names=["point_id", "cid"])

    return points.select("point_id", "v").mapInArrow(run, "point_id long, cid int")


def partial_sums(points: DataFrame, centers: Centers) -> DataFrame:
    """cid, n, sums: one row per center and Arrow batch."""
    check(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = np.array(centers)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), c.shape[1])
            best = np.stack([((x - one) ** 2).sum(axis=1) for one in c]).argmin(axis=0)
            used = np.unique(best)
            sums = [x[best == k].sum(axis=0).tolist() for k in used]
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(np.bincount(best)[used].astype(np.int64)), pa.array(sums, pa.list_(pa.float64()))], names=["cid", "n", "sums"])

    return points.select("v").mapInArrow(run, "cid int, n long, sums array<double>")


def update(parts: DataFrame, centers: Centers) -> tuple[Centers, list[int]]:
    """New centers and how many points each has; k x d values reach the driver."""
    added = parts.select("cid", "n", F.posexplode("sums").alias("d", "s")).groupBy("cid", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    new, counts = [list(c) for c in centers], [0] * len(centers)
    for r in added.collect():
        new[r["cid"]][r["d"]] = r["s"] / r["n"]
        counts[r["cid"]] = r["n"]
    return new, counts


def iterate(points: DataFrame, centers: Centers, iterations: int) -> Centers:
    """A fixed number of iterations; points are kept in memory between them."""
    kept = points.select("v").persist(StorageLevel.MEMORY_AND_DISK) if iterations > 1 else points
    for _ in range(iterations):
        centers, _ = update(partial_sums(kept, centers), centers)
    if kept is not points:
        kept.unpersist()
    return centers


def iterate_with_failures(store, ownership, centers: Centers, iterations: int, failures: dict[int, list[int]]):
    """Iterations over a block store whose blocks are points (block_id, v).

    Each rank works on its own points; the work set, not the store, is what an
    iteration reads.  ``failures``: iteration -> ranks that die in it.  Their part of the
    work set is gone for good: the iteration is rolled back, the lost ranges are re-balanced over the
    survivors and pulled from replicas, the survivors keep them, and the iteration runs again.
    Returns centers, store and ownership."""
    state: TwoPhase = TwoPhase(centers)
    state.commit()
    spark, owner = store.blocks.sparkSession, F.col("owner")
    work = store.blocks.select("block_id", "v", store.placement.range_of(F.col("block_id")).cast("int").alias("owner"))
    held = [work := work.persist(StorageLevel.MEMORY_AND_DISK)]
    for i in range(iterations):
        if dead := failures.get(i):
            state.rollback()
            store = store.fail(dead)
            store.placement.check_no_loss(spark, store.dead)
            plan = ownership.settled_plan(dead)
            pulled = store.pull(plan.select("start", "len", "dest")).select("block_id", "v", F.col("dest").cast("int").alias("owner"))
            # what a survivor got stays in its memory; the rest is not read again from anywhere
            held.append(pulled := pulled.persist(StorageLevel.MEMORY_AND_DISK))
            work = work.where(~owner.isin([int(d) for d in dead])).unionByName(pulled)
            ownership = ownership.commit(dead).settled()
        state.active = update(partial_sums(work, state.active), state.active)[0]
        state.commit()
    for frame in held:
        frame.unpersist()
    return state.committed, store, ownership


def as_frame(spark: SparkSession, centers: Centers) -> DataFrame:
    return spark.createDataFrame([(i, d, float(x)) for i, c in enumerate(centers) for d, x in enumerate(c)], "cid int, dim int, value double")
