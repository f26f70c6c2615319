"""Bijections of 0..n-1 as column expressions, each with its inverse.

A permutation works on the next power of two (or four) and walks its cycle until
it is back in range.  The first step is a plain expression; what is still
outside goes on in folds of growing length, since a fold can't stop early: nearly
all rows take none or the shortest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockwright.functions.scalars import div

WALK = 256


def _walk(step, n: int, value: Column) -> Column:
    lost = F.raise_error(F.lit(f"no id in range after {WALK} steps")).cast("long")

    def fold(start: Column, done: int, steps: int) -> Column:
        steps = min(steps, WALK - done)
        go_on = lambda x: F.when(x < n, x).otherwise(fold(x, done + steps, 4 * steps) if done + steps < WALK else lost)
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda x, _: F.when(x < n, x).otherwise(step(x)), go_on)

    once = step(value)
    found = F.when(once < n, once).otherwise(fold(once, 0, 3))
    ok = (value >= 0) & (value < n)
    return F.when(ok, found).when(value.isNotNull(), F.raise_error(F.lit("id outside the permutation")).cast("long"))


@dataclass(frozen=True)
class Identity:
    n: int

    def apply(self, value: Column) -> Column:
        return value

    def invert(self, value: Column) -> Column:
        return value


@dataclass(frozen=True)
class Congruential:
    """x -> 5 x + 1 modulo a power of two above every id, walked into range."""

    n: int

    def __post_init__(self):
        if not 0 < self.n < 1 << 58:
            raise ValueError("between 1 and 2^58 ids")

    @property
    def modulus(self) -> int:
        return 1 << max(2, (self.n - 1).bit_length())

    def apply(self, value: Column) -> Column:
        return _walk(lambda x: (x * 5 + 1).bitwiseAND(F.lit(self.modulus - 1)), self.n, value.cast("long"))

    def invert(self, value: Column) -> Column:
        m = self.modulus

        def back(x: Column) -> Column:
            # the multiple of five among x-1, x-1+m, ... x-1+4m, divided
            y = F.pmod(x - 1, F.lit(m))
            j = F.pmod(-y * pow(m, -1, 5), F.lit(5))
            return div(y + j * m, 5)

        return _walk(back, self.n, value.cast("long"))


@dataclass(frozen=True)
class Feistel:
    """Four balanced Feistel rounds with keyed 64-bit hashes, or with another
    round function ``mix`` of half a value and key."""

    n: int
    seed: int = 0
    mix: object = None

    @property
    def half(self) -> int:
        return max(1, ((self.n - 1).bit_length() + 1) // 2)

    def _rounds(self, value: Column, order) -> Column:
        mask, half = (1 << self.half) - 1, self.half
        left, right = F.shiftright(value, half), value.bitwiseAND(F.lit(mask))
        keys = F.array(*(F.lit(self.seed * 4 + i).cast("long") for i in order))
        swap = F.struct(left.alias("a"), right.alias("b"))
        mixed = F.aggregate(keys, swap, lambda s, key: F.struct(s["b"].alias("a"), s["a"].bitwiseXOR((self.mix or F.xxhash64)(s["b"], key).bitwiseAND(F.lit(mask))).alias("b")))
        return F.shiftleft(mixed["b"], half).bitwiseOR(mixed["a"])

    def apply(self, value: Column) -> Column:
        return _walk(lambda x: self._rounds(x, range(4)), self.n, value.cast("long"))

    def invert(self, value: Column) -> Column:
        return _walk(lambda x: self._rounds(x, range(3, -1, -1)), self.n, value.cast("long"))


@dataclass(frozen=True)
class Ranges:
    """Permutes whole runs of ``length`` ids; a shorter last run stays."""

    n: int
    length: int
    kind: type = Congruential

    @property
    def effective(self) -> int:
        return max(1, min(self.length, self.n - 1))

    @property
    def inner(self):
        return self.kind(self.n // self.effective)

    def _moved(self, value: Column, move) -> Column:
        size = self.effective
        number = div(value, size)
        return F.when(number < self.n // size, move(number) * size + F.pmod(value, F.lit(size))).otherwise(value).cast("long")

    def apply(self, value: Column) -> Column:
        # outside whole runs the inner permutation must not see the number
        return self._moved(value, lambda k: self.inner.apply(F.least(k, F.lit(self.n // self.effective - 1))))

    def invert(self, value: Column) -> Column:
        return self._moved(value, lambda k: self.inner.invert(F.least(k, F.lit(self.n // self.effective - 1))))

    def last_of_run(self, value: Column) -> Column:
        size = self.effective
        return F.least(div(value, size) * size + (size - 1), F.lit(self.n - 1)).cast("long")
