"""The replicated block store: submit, fail, pull, push.

A store is a description: blocks (a DataFrame with ``block_id``), a placement,
a permutation of ids and the set of failed ranks.  Failing ranks gives a new
store.  Replicas are rows (range, rank, block), produced by exploding the rank
list after projection; a pull routes ranges, not blocks: requests are cut at
run and range borders with ``sequence`` and met with the store by an equi-join
on pieces of the id space, and the requested interval of ids is pushed to the
scan.  ``stored`` writes the blocks once, by range and in id order, so that
later pulls read what they ask for.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.functions.permutation import Identity
from blockwright.functions.scalars import div
from blockwright.plans.placement import Placement

#: Blocks of a range that one task writes.
SLICE = 1 << 19
#: Rows of a task that looks for runs, and bits of the ids of a stretch.
RUN_ROWS, STRETCH = 1 << 18, 20


@dataclass(frozen=True)
class BlockStore:
    blocks: DataFrame
    placement: Placement
    permutation: object = None
    dead: frozenset = frozenset()

    @property
    def order(self):
        return self.permutation or Identity(self.placement.blocks)

    def fail(self, ranks: Iterable[int]) -> BlockStore:
        return replace(self, dead=self.dead | {int(r) for r in ranks})

    @property
    def alive(self) -> list[int]:
        return [r for r in range(self.placement.ranks) if r not in self.dead]

    def stored(self, path: str) -> BlockStore:
        """The same store with its blocks written by range and in the order of ids; one
        task writes a slice of a range, so tasks get more and not larger as the store grows."""
        p, k = self.placement, F.col("range_id")
        slices = -(-(p.per_range + 1) // SLICE)
        seat = k * slices + div(F.col("internal_id") - p.start(k), SLICE)
        cut = self.placed().repartitionById(p.ranks * slices, F.coalesce(seat, F.lit(0)).cast("int"))
        cut.sortWithinPartitions("range_id", "block_id").write.partitionBy("range_id").parquet(path)
        schema = self.placed().schema
        return replace(self, blocks=self.blocks.sparkSession.read.schema(schema).parquet(path))

    def placed(self) -> DataFrame:
        """Blocks with their internal id and range."""
        if {"internal_id", "range_id"} <= set(self.blocks.columns):
            return self.blocks
        inner = self.blocks.withColumn("internal_id", self.order.apply(F.col("block_id")))
        return inner.withColumn("range_id", self.placement.range_of(F.col("internal_id")))

    def replicas(self) -> DataFrame:
        """One row per stored copy on an alive rank."""
        ranks = self.placement.alive_ranks_of(F.col("range_id"), self.dead)
        return self.placed().withColumn("rank", F.explode(ranks))

    def stored_counts(self) -> DataFrame:
        """Blocks per alive rank.  Counted per range first: the copies need not be made."""
        per_range = self.placed().groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))
        return per_range.withColumn("rank", F.explode(self.placement.alive_ranks_of(F.col("range_id"), self.dead))).groupBy("rank").agg(F.sum("n").alias("n_blocks"))

    def range_registry(self) -> DataFrame:
        return self.placement.replicas_table(self.blocks.sparkSession).where(~F.col("rank").isin(*self.dead) if self.dead else F.lit(True)).groupBy("rank").agg(F.count("range_id").alias("n_ranges"))

    def lost_ranges(self) -> DataFrame:
        return self.placement.lost_ranges(self.blocks.sparkSession, self.dead)

    def route(self, requests: DataFrame, hashed: Column | None = None) -> DataFrame:
        """Cut requests (start, len, dest) at the borders of runs and ranges and
        choose who serves each piece: dest itself if it holds a copy."""
        p, order = self.placement, self.order
        run = getattr(order, "effective", None)
        pieces = requests.where("len > 0")
        if run:  # consecutive ids stay consecutive inside a run only
            cut = F.sequence(div(F.col("start"), run), div(F.col("start") + F.col("len") - 1, run))
            pieces = pieces.select("dest", F.explode(cut).alias("run"), "start", F.col("start").alias("s"), (F.col("start") + F.col("len")).alias("e"))
            pieces = pieces.select("dest", F.greatest(F.col("s"), F.col("run") * run).alias("start"), F.least(F.col("e"), (F.col("run") + 1) * run).alias("end"))
            pieces = pieces.select("dest", "start", (F.col("end") - F.col("start")).alias("len"))
        elif not isinstance(order, Identity):  # every id may go elsewhere
            pieces = pieces.select("dest", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("start")).withColumn("len", F.lit(1).cast("long"))
        inner = pieces.withColumn("istart", order.apply(F.col("start")))
        first, last = p.range_of(F.col("istart")), p.range_of(F.col("istart") + F.col("len") - 1)
        split = inner.withColumn("range_id", F.explode(F.sequence(first, last)))
        s = F.greatest(F.col("istart"), p.start(F.col("range_id")))
        e = F.least(F.col("istart") + F.col("len"), p.last(F.col("range_id")) + 1)
        out = split.select("dest", "range_id", (F.col("start") + s - F.col("istart")).alias("start"), s.alias("internal_start"), (e - s).alias("len"))
        own = F.array_contains(p.alive_ranks_of(F.col("range_id"), self.dead), F.col("dest").cast("int"))
        served = p.serving_rank(F.col("range_id"), F.col("dest"), self.dead, hashed)
        lost = F.raise_error(F.concat(F.lit("no alive replica of range "), F.col("range_id").cast("string"))).cast("int")
        return out.withColumn("serving", F.coalesce(F.when(own, F.col("dest").cast("int")), served, lost))

    @property
    def piece(self) -> int:
        """Consecutive internal ids that are met together."""
        order = self.order
        return getattr(order, "effective", 4096 if isinstance(order, Identity) else 1)

    def pull(self, requests: DataFrame) -> DataFrame:
        """Blocks for each request row: dest, serving and the block's columns.
        Requests are cut at pieces of the internal id space, never into ids."""
        asked = requests.where("len > 0").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("len")).alias("high")).head()
        size, low, high = self.piece, asked["low"], asked["high"]
        routed = self.route(requests).select("dest", "serving", "internal_start", (F.col("internal_start") + F.col("len")).alias("internal_end"))
        cut = F.sequence(div(F.col("internal_start"), size), div(F.col("internal_end") - 1, size))
        wanted = routed.withColumn("_piece", F.explode(cut))
        inside = self.placed().where(F.col("block_id").between(low, high - 1) if low is not None else F.lit(False))
        met = inside.withColumn("_piece", div(F.col("internal_id"), size)).join(wanted, "_piece")
        return met.where("internal_id >= internal_start AND internal_id < internal_end").drop("_piece", "internal_start", "internal_end")

    def push(self, addressed: DataFrame, original_ranks: bool = True) -> DataFrame:
        """Same plan as pull; with current ranks the targets are translated first."""
        if original_ranks:
            return self.pull(addressed)
        from blockwright.operators.ranks import current_ranks

        names = current_ranks(self.blocks.sparkSession, self.placement.ranks, self.dead).select("original_rank", F.col("current_rank").alias("dest"))
        return self.pull(addressed.join(F.broadcast(names), "dest").select("start", "len", F.col("original_rank").alias("dest")))

    def scan(self, start: int, length: int) -> DataFrame:
        """Blocks of a range of ids in order; a missing id raises."""
        found = self.blocks.where(F.col("block_id").between(start, start + length - 1))
        seen = found.agg(F.countDistinct("block_id")).head()[0]
        if seen != max(0, length):
            raise LookupError(f"{max(0, length) - seen} of the ids {start} to {start + length - 1} are not stored")
        return found.orderBy("block_id")

    def overwrite(self, newer: DataFrame) -> BlockStore:
        """Later writes of an id replace earlier ones."""
        kept = self.blocks.join(newer.select("block_id"), "block_id", "left_anti")
        return replace(self, blocks=kept.unionByName(newer))

    def split_over_replicas(self, requests: DataFrame) -> DataFrame:
        """Cut each (range_id, start, len) evenly over its alive replicas."""
        alive = F.array_sort(self.placement.alive_ranks_of(F.col("range_id"), self.dead))
        n = F.size("alive")
        rows = requests.withColumn("alive", alive).select("*", n.alias("a"), F.posexplode("alive").alias("i", "serving"))
        base, extra = div(F.col("len"), F.col("a")), F.pmod("len", F.col("a"))
        start = F.col("start") + F.col("i") * base + F.least(F.col("i"), extra)
        return rows.select("range_id", "serving", start.alias("start"), (base + (F.col("i") < extra).cast("int")).alias("len")).where("len > 0")


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """Pre-serialised ranges (begin, end, payloads) as one row per block."""
    return ranges.select("begin", F.posexplode("payloads").alias("offset", "payload")).select((F.col("begin") + F.col("offset")).alias("block_id"), "payload")


def _joined(runs: DataFrame, group: str, *more: str) -> DataFrame:
    """Runs that meet or overlap as one, per group: one sort, and each row sees its neighbours only."""
    w = Window.partitionBy(group, *more).orderBy("first_id")
    first, last = F.col("first_id"), F.col("last_id")

    def apart(low: Column, high: Column) -> Column:
        return F.when(high > low, high - 1 > low)  # no overflow at either end of the type

    opens = F.lag(F.lit(1)).over(w).isNull() | apart(F.lag(last).over(w), first)
    closes = F.lead(F.lit(1)).over(w).isNull() | apart(last, F.lead(first).over(w))
    ends = runs.select("*", F.coalesce(opens, F.lit(False)).alias("_opens"), F.coalesce(closes, F.lit(False)).alias("_closes")).where("_opens OR _closes")
    end = F.when(F.col("_closes"), last).otherwise(F.lead(last).over(w))
    return ends.withColumn("_last", end).where("_opens").select(group, "first_id", F.col("_last").alias("last_id"))


def id_runs(rows: DataFrame, group: str, id_: str = "block_id") -> DataFrame:
    """Runs of consecutive ids per group: first and last.  Rows may repeat; a null id is a run of its own.

    Rows are dealt by group and stretch of the id space to as many tasks as their number
    asks for, so a task's share grows neither with the rows nor with the largest
    group; only runs that touch the border of a stretch meet again."""
    tasks = max(1, -(-rows.count() // RUN_ROWS))
    ids = rows.select(group, F.col(id_).alias("first_id"), F.col(id_).alias("last_id"))
    dealt = ids.withColumn("_stretch", F.shiftright("first_id", STRETCH)).repartition(tasks, group, "_stretch")
    inside, mask = _joined(dealt, group, "_stretch"), F.lit((1 << STRETCH) - 1)
    touches = F.coalesce((F.col("first_id").bitwiseAND(mask) == 0) | (F.col("last_id").bitwiseAND(mask) == mask), F.lit(False))
    return inside.where(~touches).unionByName(_joined(inside.where(touches).repartition(tasks, group), group))
