"""URL rules by a sort-merge range join.

A host is written with its labels reversed, each followed by a dot, so that a
host and all its subdomains share a prefix: a rule's host is the interval
[key, key + the largest code point).  Pages and rules are laid out on the same
ordered key space.  Sampled splitters cut it into ranges; a page goes to the
one range that holds its key, a rule to each range that its interval meets.
Inside a range, pages and rules are swept in key order with a stack of the
rules whose interval is open: intervals of prefixes nest, so the stack is the
chain of rule hosts above the page's host.  Of the open rules whose path is a
prefix of the page's path, the longest (host and path together, then the longer
host, then the first in order) wins.

The page key ends with path and id, so splitters also cut inside one host that
holds a large share of the pages.  Nothing is broadcast: the rules travel
through the same shuffle, each to the ranges that it meets.

Edge cases: a null url or one without ``://`` has empty host and path and gets
the default verdict; repeated pages give a row each; without rules or pages the
result is the default verdict or empty; a rule given twice counts once, and of
contradicting ones ``block`` wins; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.llm import _text
from blockwright.llm._session import ship

TOP = "\U0010ffff"
#: Sampled rows per range, to place the splitters.
SAMPLE_PER_RANGE = 40
#: So the sample has a bound, whatever the cluster.
MOST_RANGES = 8192


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``a.b.org`` -> ``org.b.a.``; an empty host stays empty."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(".")))


def _splitters(keys: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` keys from a sample of about ``SAMPLE_PER_RANGE`` for
    each range; tasks send the sample and no more."""
    total = keys.count()
    share = min(1.0, ranges * SAMPLE_PER_RANGE / max(1, total))
    draw = F.shiftrightunsigned(F.xxhash64("_sort"), 11) / F.lit(float(2**53))
    found = sorted(r[0] for r in keys.select("_sort").where(draw < share).distinct().collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Verdicts of the pages, which arrive with the rules in order of range, key
    and kind; only the stack of open rules is held."""
    current = None
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    for batch in batches:
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        for number, kind, key, page, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("_range", "_kind", "_key", "page_id", "host", "path", "verdict")), strict=True):
            if number != current:
                current, stack = number, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((host, path, verdict))
                continue
            best = None
            for _, active in stack:
                for rule_host, rule_path, rule_verdict in active:
                    if path.startswith(rule_path):
                        rank = (len(rule_host) + len(rule_path), len(rule_host), rule_verdict)
                        if best is None or rank > best[0]:
                            best = rank, rule_host + rule_path
            ids.append(page)
            hosts.append(host)
            paths.append(path)
            rules.append(best[1] if best else None)
            verdicts.append(best[0][2] if best else default)
        yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in (hosts, paths, rules, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, ranges: int | None = None, default: str = "allow") -> DataFrame:
    """Verdict per page; ``rules`` has host, path and verdict."""
    spark = ship(pages.sparkSession)
    ranges = ranges or min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    url = F.col("url")
    keyed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = keyed.withColumn("_key", reversed_host(F.col("host")))
    spread = F.hex(F.xxhash64("page_id"))
    keyed = keyed.withColumn("_sort", F.concat(F.col("_key"), F.lit("\x00"), F.col("path"), F.lit("\x00"), spread))
    cuts = _splitters(keyed, ranges)
    size = len(cuts) + 1

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, k) for k in keys], dtype="int32")

    clean = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    opened = clean.withColumn("_key", reversed_host(F.col("host")))
    met = F.explode(F.sequence(range_of("_key"), range_of(F.concat("_key", F.lit(TOP)))))
    columns = ["_range", "_kind", "_sort", "_key", "page_id", "host", "path", "verdict"]
    starts = opened.withColumn("_range", met).withColumns({"_kind": F.lit(0), "_sort": F.col("_key"), "page_id": F.lit(None).cast("long")}).select(columns)
    rows = keyed.withColumns({"_range": range_of("_sort"), "_kind": F.lit(1), "verdict": F.lit(None).cast("string")}).select(columns)
    dealt = starts.unionByName(rows).repartition(size, "_range").sortWithinPartitions("_range", "_sort", "_kind")
    return dealt.mapInArrow(_text.frees(functools.partial(_sweep, default=default)), "page_id long, host string, path string, rule string, verdict string")
