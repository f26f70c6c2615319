"""Sharding by a hierarchical weighted hash tree.

A row descends region -> rack -> shard.  At every level each child draws an
exponential variate ``-ln(u) / weight`` from a hash of (key, child) and the
smallest draw wins, so a child gets rows in proportion to its weight.  A draw
depends on the key, the child and the child's weight alone: when a weight
rises, a row either stays or moves into that child, and no row moves between
other children.  New capacity that enters as a region of its own therefore
only takes rows into itself, and a changed weight inside a region moves rows
inside that region plus those that its new total attracts.  A tree with fewer
shards than its base keeps the base's places and weights: a row that lands on
an absent shard draws anew, and after ``ATTEMPTS`` draws chooses among the
present shards by one flat draw.  So a shard that fills a place, too, only takes rows into itself.

Only built-in column functions are used.  The slot numbers need no task that
sees a whole shard: rows are dealt over ``buckets`` hash buckets per shard,
numbered inside a bucket, and shifted by the bucket's offset, which comes from
a table of shards x buckets counts (its size is fixed by the parameters).

Edge cases: a null key is a key like any other; null text has size 1 and the
checksum of no bytes (0); repeated rows get a slot each; an empty table gives
no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    """A leaf: its number, the path to it, and its share."""

    number: int
    region: str
    rack: str
    weight: float = 1.0
    present: bool = True


ATTEMPTS = 3


def topology(shards: int, base: int = 8) -> list[Shard]:
    """``base`` places in regions of two racks of two, of which the first
    ``shards`` are filled; later shards are regions."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    return [Shard(s, f"r{s // 4}", f"r{s // 4}k{s // 2 % 2}", present=s < shards) if s < base else Shard(s, f"x{s}", f"x{s}k0") for s in range(max(shards, base))]


def _draw(key: Column, child: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(weight)


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What the child with the least draw holds; ties go to the first child."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, name, weight).alias("draw"), F.lit(i).alias("i"), then.alias("then")) for i, (name, weight, then) in enumerate(children)]
    return F.least(*draws)["then"]


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The shard number of a key, by descent through the tree."""
    if any(not s.weight > 0 for s in shards):
        raise ValueError("weights must be positive")

    def level(leaves: list[Shard], path: tuple[str, ...], attempt: str) -> list[tuple[str, float, Column]]:
        if not path:
            return [(f"{attempt}shard:{s.number}", s.weight, F.lit(s.number if s.present else None).cast("int")) for s in leaves]
        groups: dict[str, list[Shard]] = {}
        for s in leaves:
            groups.setdefault(getattr(s, path[0]), []).append(s)
        return [(f"{attempt}{path[0]}:{name}", sum(s.weight for s in own), _pick(key, level(own, path[1:], attempt))) for name, own in groups.items()]

    present = [s for s in shards if s.present]
    if len(present) == len(shards):
        return _pick(key, level(shards, ("region", "rack"), ""))
    draws = [_pick(key, level(shards, ("region", "rack"), f"{t}:" if t else "")) for t in range(ATTEMPTS)]
    return F.coalesce(*draws, _pick(key, level(present, (), "flat:")))


def assign(rows: DataFrame, key: str, shards: list[Shard], grown: list[Shard] | None = None) -> DataFrame:
    """Add ``shard`` and, for a grown tree, ``grown_shard``."""
    out = rows.withColumn("shard", shard_of(F.col(key), shards))
    return out.withColumn("grown_shard", shard_of(F.col(key), grown) if grown else F.lit(None).cast("int"))


def with_slots(rows: DataFrame, order: list[str], buckets: int = 1024) -> DataFrame:
    """Add ``slot``: gapless from 0 within each ``shard``."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_rank", F.row_number().over(within))
    # shards x buckets rows at most, whatever the input
    joined = numbered.join(F.broadcast(offsets), ["shard", "_bucket"])
    return joined.withColumn("slot", F.col("_offset") + F.col("_rank") - 1).drop("_bucket", "_rank", "_offset")


def shard_documents(docs: DataFrame, shards: int = 8, buckets: int = 1024) -> DataFrame:
    """Shard, slot and the shard in a tree of one more, per document."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = docs.select("doc_id", (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign(narrow, "doc_id", topology(shards), topology(shards + 1))
    out = with_slots(placed, ["doc_id", "text_crc32", "size"], buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def balance(placed: DataFrame) -> DataFrame:
    """Rows, bytes and arrivals of each shard; one row per shard."""
    moved = (F.col("shard") != F.col("grown_shard")).cast("long")
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), F.sum(moved).alias("n_moved"))
