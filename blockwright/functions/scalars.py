"""Scalar helpers as column expressions."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division, exact for all 64 bits."""
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


LIMITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def in_range(value: Column, kind: str) -> Column:
    """Whether a whole number fits a signed type."""
    bits = LIMITS[kind] - 1
    return value.between(F.lit(-(1 << bits)), F.lit((1 << bits) - 1))


def throwing_cast(value: Column, kind: str) -> Column:
    return F.when(in_range(value, kind), value.cast(kind)).when(value.isNotNull(), F.raise_error(F.lit(f"out of range for {kind}")).cast(kind))


def num_bits(value: Column) -> Column:
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value)))


def most_significant_bit(value: Column) -> Column:
    """Index of the highest set bit; 0 for 0."""
    return F.length(F.bin(value)) - 1


def left_half(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(value, bits // 2)


def right_half(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << (bits // 2)) - 1))


def combine_halves(left: Column, right: Column, bits: int) -> Column:
    return F.shiftleft(left, bits // 2).bitwiseOR(right)


def djb2(text: Column) -> Column:
    """32-bit string hash (h = 33 h + byte from 5381) of the UTF-8 bytes."""
    digits = F.hex(F.encode(text, "UTF-8"))
    size = F.length(digits)
    places = F.when(size > 0, F.sequence(F.lit(1), size - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(5381).cast("long"), lambda h, i: (h * 33 + F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))


BYTE_UNITS = ("KiB", "MiB", "GiB", "TiB")


def human_bytes(size: Column, largest: str = "TiB") -> Column:
    """One decimal, rounded half up in whole numbers; no unit above ``largest``."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, name in enumerate(BYTE_UNITS[: BYTE_UNITS.index(largest) + 1], 1):
        unit = 1024**power
        tenths = div(size * 20 + unit, 2 * unit)
        out = F.when(size >= unit, F.concat(div(tenths, 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(f" {name}"))).otherwise(out)
    return out


class Timers:
    """Named durations in seconds, kept on the driver."""

    def __init__(self):
        self.total: dict[str, float] = {}
        self._open: dict[str, float] = {}

    def start(self, name: str) -> None:
        if name in self._open:
            raise ValueError(f"{name} is running")
        self._open[name] = time.perf_counter()

    def stop(self, name: str) -> float:
        took = time.perf_counter() - self._open.pop(name)
        self.add(name, took)
        return took

    def add(self, name: str, seconds: float) -> None:
        self.total[name] = self.total.get(name, 0.0) + seconds

    @contextmanager
    def scope(self, name: str):
        self.start(name)
        try:
            yield self
        finally:
            self.stop(name)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.total.items()), "timer string, seconds double")
