"""PageRank over (src, dst) edges; multi-edges count, dangling mass is dropped
and the final vector is divided by its sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.operators.versioned import TwoPhase
from blockwright.plans.session import checkpoint

#: So many pieces of the work set, one more with each failure, are written as one.
PARTS = 8


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def _merged(edges: DataFrame, *more: str) -> DataFrame:
    """Parallel edges as one with their number m."""
    return checkpoint(edges.groupBy("src", "dst", *more).agg(F.count(F.lit(1)).alias("m")))


def _degrees(merged: DataFrame) -> DataFrame:
    return checkpoint(merged.groupBy(F.col("src").alias("_v")).agg(F.sum("m").alias("degree")))


def _step(merged: DataFrame, degrees: DataFrame, vertices: DataFrame, pr: DataFrame, n: int, damping: float) -> DataFrame:
    """What an edge carries is worked out per vertex, so edges meet one small table and keep whole numbers only."""
    shares = pr.join(degrees, pr["v"] == degrees["_v"]).select("_v", (F.col("pr") / F.col("degree")).alias("share"))
    sent = merged.join(shares, merged["src"] == shares["_v"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("m")).alias("t"))
    return vertices.join(sent, vertices["v"] == sent["dst"], "left").select("v", (F.lit((1 - damping) / n) + damping * F.coalesce("t", F.lit(0.0))).alias("pr"))


def _divided(pr: DataFrame) -> DataFrame:
    total = pr.agg(F.sum("pr").alias("total"))
    return pr.crossJoin(F.broadcast(total)).select("v", (F.col("pr") / F.col("total")).alias("pr"))


def pagerank_with_failures(store, ownership, vertices: DataFrame, iterations: int, failures: dict[int, list[int]], damping: float = 0.85) -> DataFrame:
    """PageRank over a block store of edges (block_id, src, dst).

    Each rank works on its own edges.  ``failures``: iteration -> ranks that die
    in it; their edges are gone, the ranks of the last committed iteration come back, the
    lost edges are re-balanced and pulled from replicas, and the iteration runs again.
    Parallel edges are merged per rank, so a failure costs what was lost: the
    survivors' edges are neither merged nor written again."""
    spark, n = vertices.sparkSession, vertices.count()
    work = store.blocks.select("src", "dst", store.placement.range_of(F.col("block_id")).cast("int").alias("owner"))
    work = _merged(work, "owner")
    degrees, parts = _degrees(work), 1
    state: TwoPhase = TwoPhase(vertices.select("v", F.lit(1.0 / n).alias("pr")))
    for i in range(iterations):
        if dead := failures.get(i):
            state.rollback()
            store = store.fail(dead)
            store.placement.check_no_loss(spark, store.dead)
            pulled = store.pull(ownership.settled_plan(dead).select("start", "len", "dest")).select("src", "dst", F.col("dest").cast("int").alias("owner"))
            work = work.where(~F.col("owner").isin([int(d) for d in dead])).unionByName(_merged(pulled, "owner"))
            parts += 1
            if parts % PARTS == 0:
                work = checkpoint(work)
            ownership = ownership.commit(dead).settled()
            degrees = _degrees(work)
        state.active = checkpoint(_step(work, degrees, vertices, state.active, n, damping))
        state.commit()
    return _divided(state.committed)


def pagerank(edges: DataFrame, vertices: DataFrame, iterations: int = 100, damping: float = 0.85, every: int = 5) -> DataFrame:
    """v, pr for every vertex (column v).

    Parallel edges are merged into one first, so an iteration
    moves one row per different edge; the lineage is cut ``every`` iterations."""
    n = vertices.count()
    if n == 0:
        return vertices.select("v", F.lit(None).cast("double").alias("pr"))
    merged = _merged(edges)
    degrees = _degrees(merged)
    pr = vertices.select("v", F.lit(1.0 / n).alias("pr"))
    for i in range(1, iterations + 1):
        pr = _step(merged, degrees, vertices, pr, n, damping)
        if i % every == 0 and i < iterations:
            pr = checkpoint(pr)
    return _divided(pr)


def actual_pagerank(stored, teleport: float, damping: float):
    return F.lit(teleport) + damping * stored


def l2_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    d = F.col("a.pr") - F.col("b.pr")
    return a.alias("a").join(b.alias("b"), "v").agg(F.sqrt(F.sum(d * d)).alias("l2"))


def top(pr: DataFrame, k: int = 20) -> DataFrame:
    return pr.orderBy(F.desc("pr"), "v").limit(k)
