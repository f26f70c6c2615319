"""Exact near-duplicate join on word shingles by adaptive multi-match prefixes.

A text's set are the distinct windows of five words (ASCII lower-cased); two
texts link when ``100 * intersection >= 75 * union``.

1. *Classes.*  Texts with equal word sequences are one class, so copies are
   handled once, wherever they are.  A class is known by 64 of the 128 bits of
   its key; should two classes agree in these, all keys are drawn anew.
2. *Order.*  Shingles are ordered from rare to frequent.  Their frequencies are
   counted over all texts, exactly, in a shuffle of packed shingles; the most
   frequent ones, at most ``TABLE`` of them, are sent to the tasks, all others
   count as rare.  The order steers cost only, never the result.
3. *Prefixes.*  If sets are similar, their prefixes of
   ``n - ceil(0.75 n) + m`` rarest shingles share at least ``m``.  Each class
   takes the level ``m`` (1 to 4) with the least estimated cost: shingles to
   ship plus candidates expected, where candidates are at most the frequencies
   in the prefix divided by ``m``.  A pair needs as many shared prefix shingles
   as the smaller of its two levels.
4. *Candidates.*  Prefix shingles travel packed, per task and bucket, with their
   places in the order of the set, which bound the intersection from above.  A
   bucket emits the pairs that sizes and places permit of each shingle with at
   most ``SMALL`` classes.  Shingles with more (or that are known to be hot)
   become rows of their own: classes are first tried against a few
   pivots per shingle and what links is merged; then blocks of ``BLOCK`` classes
   are compared by bitmaps, first for the closest pair of each two components,
   which are merged if it links, and last for all pairs
   that are still in different components.  So a group of
   thousands of near copies costs about its size, and no pair is skipped.
5. *Verification.*  Parity bitmaps bound the symmetric difference from below
   and so discard pairs exactly; for the rest the sets are rebuilt from the
   texts and intersected.
6. *Components* by contraction; copies rejoin through their class.

Sets are compared by 64-bit hashes of their shingles.

Edge cases: null, empty and wordless texts have an empty set and link with
nothing; fewer than five words are one shingle; repeated rows, rows that repeat
an id with another text, null ids and ties give a row each; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import _graph, _text
from blockwright.llm._session import checkpoint, release, ship

WIDTH = 5
PERCENT = 75
LEVELS = 4
SMALL = 64
#: Shingles of at least 2^HOT texts never meet in a bucket.
HOT = 11
BLOCK = 512
PIVOTS = 6
PIVOT_TOKENS = 2
#: Most entries of the table of frequent shingles, and their least frequency.
TABLE = 1 << 19
LEAST = 16
#: Shingles that a task counts together, and pairs that it adds up together.
TOGETHER = 1 << 20
#: Cost of a candidate, in prefix shingles shipped.
CANDIDATE_COST = 8.0
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _places(size: int) -> np.ndarray:
    return _text.mix(np.arange(1, size + 1, dtype=np.uint64) * _GOLDEN)


def class_key(words: np.ndarray, seed: int = 0, bits: int = 64) -> tuple[int, int]:
    """Two keys of a word sequence, of ``bits`` and 64 bits; the first depends on the seed."""
    size = 1024
    while size < words.size:
        size *= 2
    terms = _text.mix(words ^ _places(size)[: words.size])
    other = (terms ^ (terms >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total, check = (np.array([t.sum(dtype=np.uint64)]) + np.uint64(words.size) for t in (terms, other ^ (other >> np.uint64(32))))
    total, check = _text.mix(total + np.uint64(seed) * _text.mix(check)), _text.mix(check)
    return int(total.view(np.int64)[0]) >> (64 - bits), int(check.view(np.int64)[0])


def needed(size: np.ndarray | int):
    return -(-PERCENT * size // 100)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2n or more cells (a power of two)."""
    cells = 64
    while cells < 2 * shingles.size and cells < 1 << 20:
        cells *= 2
    odd = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def difference_bounds(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower bounds of the symmetric differences of the pairs (i, j) of bitmaps;
    of two sizes the larger is folded."""
    width = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits)) // 8
    place, folded = np.zeros(width.size, dtype=np.int64), {}
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        place[own] = np.arange(own.size)
        rows = np.frombuffer(b"".join(bits[k] for k in own), dtype=np.uint64).reshape(-1, w)
        folded[w, w] = rows
        while w > 1:
            w //= 2
            rows = rows[:, :w] ^ rows[:, w:]
            folded[int(width[own[0]]), w] = rows
    out = np.zeros(i.size, dtype=np.int64)
    kind = width[i] * (1 << 32) + width[j]
    for k in np.unique(kind).tolist():
        x, y = k >> 32, k & 0xFFFFFFFF
        w = min(x, y)
        some, step = np.flatnonzero(kind == k), max(1, (1 << 21) // w)
        for at in range(0, some.size, step):
            few = some[at : at + step]
            out[few] = np.bitwise_count(folded[x, w][place[i[few]]] ^ folded[y, w][place[j[few]]]).sum(axis=1)
    return out


def may_link(size_a: np.ndarray, size_b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether a symmetric difference of at least ``bound`` still permits a link:
    100 (s - d) / 2 >= 75 (s + d) / 2, with s the sum of the sizes."""
    return (100 + PERCENT) * bound <= (100 - PERCENT) * (size_a + size_b)


def may_meet(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that share the shingle at places i and j of
    their orders can link: before it they share at most min(i, j) shingles, and
    after it at most what the shorter rest holds."""
    shared = np.minimum(i, j) + 1 + np.minimum(n - 1 - i, m - 1 - j)
    return (100 + PERCENT) * shared >= PERCENT * (n + m)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return bool(both) and 100 * both >= PERCENT * (a.size + b.size - both)


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, packed: all low bytes, then all next ones."""
    data = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(data, codec="zstd", asbytes=True)


def _numbers(packed: bytes, count: int) -> np.ndarray:
    data = pa.decompress(packed, decompressed_size=4 * count, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


_INFO = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("bucket", pa.int32()), ("size", pa.int32()), ("low", pa.binary()), ("counts", pa.binary())])
_INFO_DDL = "doc_id long, key long, check long, n long, bits binary, bucket int, size int, low binary, counts binary"


def _parcels(tokens: list[np.ndarray], power: int) -> pa.RecordBatch:
    """Shingles and their counts, packed into a row per bucket; a bucket holds the
    shingles with the same ``power`` leading bits."""
    code, count = np.unique(np.concatenate(tokens) >> np.uint64(32 - power), return_counts=True)
    bucket = (code >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange((1 << power) + 1))
    used = np.flatnonzero(np.diff(edges))
    low = code & np.uint64(0xFFFFFFFF)
    parts = [slice(edges[b], edges[b + 1]) for b in used]
    n, none = len(parts), pa.nulls(len(parts))
    columns = [*(none.cast(f.type) for f in _INFO), pa.array(used, pa.int32()), pa.array([p.stop - p.start for p in parts], pa.int32())]
    columns += [pa.array([_planes(np.diff(low[p], prepend=np.uint64(0))) for p in parts], pa.binary()), pa.array([_planes(count[p]) for p in parts], pa.binary())]
    return pa.record_batch([*columns[:5], *columns[9:]], schema=_INFO) if n else pa.record_batch([pa.array([], f.type) for f in _INFO], schema=_INFO)


def _describe(power: int, seed: int, key_bits: int):
    """A row per text (class, set size, bitmap) and rows of packed shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in _text.small(batches):
            texts = _text.utf8(batch.column("text"))
            keys, checks, sizes, bits = [], [], [], []
            for first, last in _text.blocks(texts):
                words = _text.Words(texts[first:last], lower=True)
                for i in range(last - first):
                    own = words.hash[words.of(i)]
                    s = _text.shingles(own, WIDTH)
                    key, check = class_key(own, seed, key_bits) if s.size else (None, None)
                    keys.append(key)
                    checks.append(check)
                    sizes.append(s.size)
                    bits.append(bitmap(s) if s.size else None)
                    if s.size and (key, check) not in seen:
                        seen.add((key, check))
                        held.append(s)
                        size += s.size
                if size >= TOGETHER:
                    yield _parcels(held, power)
                    held, size, seen = [], 0, set()
            n = pa.nulls(len(texts))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (keys, checks, sizes)), pa.array(bits, pa.binary())]
            yield pa.record_batch([*columns, *(n.cast(f.type) for f in list(_INFO)[5:])], schema=_INFO)
        if held:
            yield _parcels(held, power)

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact counts of the frequent shingles; buckets arrive one after another."""

    def close(bucket: int, parts: list) -> pa.RecordBatch:
        low, count = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(low, kind="stable")
        low, count = low[order], count[order]
        edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        total = np.add.reduceat(count, edge)
        some = total >= LEAST
        code = (low[edge][some].astype(np.uint64) | np.uint64(bucket << 32)).view(np.int64)
        return pa.record_batch([pa.array(code, pa.int64()), pa.array(np.log2(total[some]).astype(np.int32), pa.int32())], names=["code", "level"])

    current, parts = None, []
    for batch in batches:
        for bucket, size, low, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if parts and bucket != current:
                yield close(current, parts)
                parts = []
            current = bucket
            parts.append((np.cumsum(_numbers(low, size), dtype=np.uint64).astype(np.uint32), _numbers(counts, size).astype(np.int64)))
    if parts:
        yield close(current, parts)


class Order:
    """The logarithms of the frequencies of the most frequent shingles."""

    def __init__(self, code: np.ndarray, level: np.ndarray, power: int):
        order = np.argsort(code)
        self.code, self.level, self.power = code[order], level[order].astype(np.int8), power

    def levels(self, shingles: np.ndarray) -> np.ndarray:
        """0 for the rare; ``shingles`` ascend."""
        if not self.code.size:
            return np.zeros(shingles.size, dtype=np.int8)
        code = shingles >> np.uint64(32 - self.power)
        at = np.minimum(np.searchsorted(self.code, code), self.code.size - 1)
        return np.where(self.code[at] == code, self.level[at], 0)


def frequent(described: DataFrame, power: int, partitions: int) -> Order:
    """The table of frequent shingles, of at most ``TABLE`` entries."""
    parts = described.where("bucket IS NOT NULL").select("bucket", "size", "low", "counts")
    counted = checkpoint(parts.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_text.frees(_tally), "code long, level int"))
    least, total = 64, 0
    for level, n in sorted(map(tuple, counted.groupBy("level").count().collect()), reverse=True):  # a row per power of two
        if (total := total + n) > TABLE:
            break
        least = level
    found = counted.where(F.col("level") >= least).toArrow()
    return Order(found.column("code").to_numpy().view(np.uint64), found.column("level").to_numpy(), power)


def prefix(s: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set, the logarithms of its frequencies, and its level."""
    f = order.levels(s)
    by = np.argsort(f, kind="stable")
    s, f = s[by], f[by]
    base = s.size - int(needed(s.size))
    top = min(LEVELS, s.size - base)
    spent = np.cumsum(np.exp2(f[: base + top].astype(np.float64)) - 1)
    cost = [base + m + CANDIDATE_COST * spent[base + m - 1] / m for m in range(1, top + 1)]
    level = int(np.argmin(cost)) + 1
    return s[: base + level], f[: base + level], level


_PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("traits", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("places", pa.binary()), ("token", pa.int64()), ("key", pa.int64()), ("trait", pa.int64()), ("place", pa.int64())])
_PACKED = "bucket int, keys binary, traits binary, counts binary, tokens binary, places binary, token long, key long, trait long, place long"
_PAIRS_SCHEMA = pa.schema([(n, pa.int64()) for n in ("a", "b", "shared", "need", "token", "key", "trait", "place")])
_PAIRS = "a long, b long, shared long, need long, token long, key long, trait long, place long"


def _pack(order, buckets: int, seed: int, key_bits: int, hottest: int):
    """Prefix shingles of a batch: a packed row per bucket, a row per hot one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text.utf8(batch.column("text"))
            keys, traits, parts, places, seen = [], [], [], [], set()
            hot: list[list[np.ndarray]] = [[], [], [], []]
            for first, last in _text.blocks(texts):
                words = _text.Words(texts[first:last], lower=True)
                for i in range(last - first):
                    own = words.hash[words.of(i)]
                    if not own.size or (key := class_key(own, seed, key_bits)) in seen:
                        continue
                    seen.add(key)
                    whole = _text.shingles(own, WIDTH)
                    s, f, level = prefix(whole, order.value)
                    trait, at = whole.size * 8 + level, np.arange(s.size)
                    if f[-1] >= hottest:  # the most frequent are at the end
                        known = f >= hottest
                        for column, value in zip(hot, (s[known].view(np.int64), np.full(known.sum(), key[0]), np.full(known.sum(), trait), at[known]), strict=True):
                            column.append(value)
                        s, at = s[~known], at[~known]
                    keys.append(key[0])
                    traits.append(trait)
                    parts.append(s)
                    places.append(at)
            if parts:
                token, place = np.concatenate(parts), np.concatenate(places)
                owner = np.repeat(np.arange(len(parts)), [p.size for p in parts])
                bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
                key_of, trait_of = np.array(keys, dtype=np.int64), np.array(traits, dtype=np.int64)
                out: list[list] = [[] for _ in range(6)]
                for b in np.flatnonzero(np.diff(edges)):
                    at = by[edges[b] : edges[b + 1]]
                    who, count = np.unique(owner[at], return_counts=True)
                    row = (b, key_of[who].tobytes(), trait_of[who].tobytes(), _planes(count), token[at].tobytes(), _planes(place[at]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                none = pa.nulls(len(out[0]))
                yield pa.record_batch([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:]), *(none.cast(pa.int64()) for _ in range(4))], schema=_PACKED_SCHEMA)
            if hot[0]:
                token, key, trait, place = map(np.concatenate, hot)
                none = pa.nulls(token.size)
                bucket = (_text.mix((token ^ key).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)  # any: these rows only pass
                yield pa.record_batch([pa.array(bucket), *(none.cast(pa.binary()) for _ in range(5)), *(pa.array(x, pa.int64()) for x in (token, key, trait, place))], schema=_PACKED_SCHEMA)

    return run


def _summed(low: np.ndarray, high: np.ndarray, shared: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per pair."""
    order = np.lexsort((high, low))
    low, high, shared, need = low[order], high[order], shared[order], need[order]
    edge = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))) if low.size else np.zeros(0, np.int64)
    return low[edge], high[edge], np.add.reduceat(shared, edge) if edge.size else shared, need[edge]


def _pairs_of(token: np.ndarray, key: np.ndarray, trait: np.ndarray, place: np.ndarray, small: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The pairs of a bucket that can link, with shared counts, and its large groups."""
    order = np.lexsort((key, trait >> 3, token))
    token, key, trait, place = token[order], key[order], trait[order], place[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])))  # a class comes from several tasks
    token, key, trait, place = token[new], key[new], trait[new], place[new]
    edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
    group = np.repeat(np.diff(edge), np.diff(edge))
    large = group > small
    big = token[large], key[large], trait[large], place[large]
    some = (group > 1) & ~large
    token, key, trait, place = token[some], key[some], trait[some], place[some]
    size, level = trait >> 3, trait & 7
    found: list[tuple] = []
    for step in range(1, min(small, token.size)):
        i = np.flatnonzero(token[step:] == token[:-step])
        if not i.size:
            break
        j = i + step
        ok = (100 * size[i] >= PERCENT * size[j]) & may_meet(size[i], place[i], size[j], place[j])
        i, j = i[ok], j[ok]
        found.append((np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), np.ones(i.size, np.int64), np.minimum(level[i], level[j])))
    none = np.zeros(0, dtype=np.int64)
    return _summed(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else (none,) * 4, big


def _rows(pairs: tuple[np.ndarray, ...] | None, groups: tuple | None) -> pa.RecordBatch:
    n = len((pairs or groups)[0])
    none = [pa.nulls(n).cast(pa.int64()) for _ in range(4)]
    own = [pa.array(x, pa.int64()) for x in (pairs or groups)]
    return pa.record_batch(own + none if pairs else none + own, schema=_PAIRS_SCHEMA)


def _join_buckets(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of the packed rows of each bucket; large groups as rows.
    Buckets arrive one after another; one is held at a time."""

    def close(parts: list) -> Iterator[pa.RecordBatch]:
        token, key, trait, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        pairs, (t, k, r, p) = _pairs_of(token, key, trait, place, small)
        yield _rows(pairs, None)
        yield _rows(None, (t.view(np.int64), k, r, p))

    current, parts = None, []
    for batch in batches:
        hot = batch.filter(pa.compute.is_valid(batch.column("token")))
        if hot.num_rows:
            yield _rows(None, tuple(hot.column(c) for c in ("token", "key", "trait", "place")))
        for b, keys, traits, counts, tokens, places in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if keys is None:
                continue
            if parts and b != current:
                yield from close(parts)
                parts = []
            current = b
            key, token = np.frombuffer(keys, dtype=np.int64), np.frombuffer(tokens, dtype=np.uint64)
            count = _numbers(counts, key.size)
            parts.append((token, np.repeat(key, count), np.repeat(np.frombuffer(traits, dtype=np.int64), count), _numbers(places, token.size).astype(np.int64)))
    if parts:
        yield from close(parts)


def _across(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of each shingle's two blocks that can link and whose labels differ;
    with ``best`` only the closest pair of each two labels, as far as the bitmaps tell.
    Rows (token, low, high, own, key, trait, place, label, bits) arrive sorted."""
    found: list[np.ndarray] = []
    size = 0

    def close(rows: np.ndarray, bits: list[bytes]) -> np.ndarray:
        _, low, high = rows[0, :3]
        first, second = np.flatnonzero(rows[:, 3] == low), np.flatnonzero(rows[:, 3] == high)
        i, j = np.nonzero(rows[first, 7][:, None] != rows[second, 7][None, :])
        if low == high:
            i, j = i[i < j], j[i < j]
        i, j = first[i], second[j]
        n, m = rows[i, 5] >> 3, rows[j, 5] >> 3
        ok = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & may_meet(n, rows[i, 6], m, rows[j, 6])
        i, j, n, m = i[ok], j[ok], n[ok], m[ok]
        bound = difference_bounds(bits, i, j)
        ok = may_link(n, m, bound)
        i, j, bound = i[ok], j[ok], bound[ok]
        swap = rows[i, 7] > rows[j, 7]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return np.stack((rows[i, 7], rows[j, 7], bound, rows[i, 4], rows[j, 4]), axis=1)

    def fewest() -> np.ndarray:
        pairs = np.concatenate(found)
        if not best:
            return np.unique(pairs, axis=0)
        pairs = pairs[np.lexsort(pairs.T[::-1])]
        return pairs[np.concatenate(([True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)))] if pairs.size else pairs

    def flush(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ascontiguousarray(c), pa.int64()) for c in pairs.T], names=["x", "y", "bound", "a", "b"])

    rest, rest_bits = np.zeros((0, 8), dtype=np.int64), []
    for batch in batches:
        rows = np.concatenate((rest, np.stack([batch.column(i).to_numpy() for i in range(8)], axis=1)))
        bits = rest_bits + batch.column(8).to_pylist()
        edge = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))) if len(rows) else np.zeros(0, np.int64)
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            found.append(close(rows[x:y], bits[x:y]))
            size += len(found[-1])
            if size >= TOGETHER // 2:
                found = [fewest()]
                size = len(found[0])
                if size >= TOGETHER // 4:
                    yield flush(found[0])
                    found, size = [], 0
        last = int(edge[-1]) if edge.size else 0
        rest, rest_bits = rows[last:], bits[last:]
    if len(rest):
        found.append(close(rest, rest_bits))
    if found:
        yield flush(fewest())


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        bits, at = batch.column("bits_a").to_pylist() + batch.column("bits_b").to_pylist(), np.arange(na.size)
        ok = pa.array(may_link(na, nb, difference_bounds(bits, at, at + na.size)), pa.bool_())
        yield pa.record_batch([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])


def _squeeze(seed: int, key_bits: int):
    """Packed texts of the rows whose class is ``wanted`` (null: any class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.small(batches):
            texts, wanted = _text.utf8(batch.column("text")), batch.column("wanted").to_pylist()
            keys, packed = [], []
            for first, last in _text.blocks(texts):
                words = _text.Words(texts[first:last], lower=True)
                for i in range(last - first):
                    own = words.hash[words.of(i)]
                    if own.size and wanted[first + i] in (None, key := class_key(own, seed, key_bits)[0]):
                        keys.append(key)
                        packed.append(zlib.compress(texts[first + i], 1))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["key", "packed"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sets(packed: list[bytes]) -> Iterator[np.ndarray]:
        texts = [zlib.decompress(p) for p in packed]
        for first, last in _text.blocks(texts):
            words = _text.Words(texts[first:last], lower=True)
            for i in range(last - first):
                yield _text.shingles(words.hash[words.of(i)], WIDTH)

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            x, y = part.column("packed_a").to_pylist(), part.column("packed_b").to_pylist()
            ok = pa.array([links(s, t) for s, t in zip(sets(x), sets(y), strict=True)], pa.bool_())
            yield pa.record_batch([part.column("a").filter(ok), part.column("b").filter(ok)], names=["a", "b"])


class Join:
    """One join over ``docs`` (doc_id, text).  Groups of a shingle with more than
    ``small`` classes and shingles of at least ``2^hottest`` texts go by rows."""

    def __init__(self, docs: DataFrame, small: int = SMALL, hottest: int = HOT, key_bits: int = 64):
        self.small, self.hottest, self.key_bits = small, hottest, key_bits
        self.docs = docs.select("doc_id", "text")
        self.spark = ship(docs.sparkSession)
        self.parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        #: Buckets of shingles: a few per partition, so that one held at a time is small.
        self.power = min(24, (4 * self.parts - 1).bit_length())
        self.seed = 0
        while True:
            described = checkpoint(self.docs.mapInArrow(_text.frees(_describe(self.power, self.seed, key_bits)), _INFO_DDL))
            grouped = described.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("bits").alias("bits"), (F.min("check") != F.max("check")).alias("torn"))
            self.classes = checkpoint(grouped)
            if self.classes.where("torn").isEmpty():
                break
            self.seed += 1  # two classes agree in 64 bits
        self.rows = checkpoint(described.where("bucket IS NULL").select("doc_id", "key", "n"))
        self.order = frequent(described, self.power, self.parts)

    def candidates(self) -> DataFrame:
        """Pair rows (a, b, shared, need) and rows of large groups (token, key, trait, place)."""
        buckets = 1 << self.power
        order = self.spark.sparkContext.broadcast(self.order)
        packed = self.docs.mapInArrow(_text.frees(_pack(order, buckets, self.seed, self.key_bits, self.hottest)), _PACKED)
        return checkpoint(packed.repartition(self.parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_text.frees(functools.partial(_join_buckets, small=self.small)), _PAIRS))

    def screened(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the bitmaps permit to link."""
        side = lambda c: self.classes.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"))
        return checkpoint(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_text.frees(_screen), "a long, b long"))

    def texts_of(self, keys: DataFrame) -> DataFrame:
        """Packed texts of classes, one each: the only time that texts move."""
        reps = self.classes.select(F.col("key").alias("wanted"), F.col("rep").alias("doc_id")).join(keys.distinct().withColumnRenamed("key", "wanted"), "wanted", "left_semi")
        known = self.docs.join(reps, "doc_id").select("text", "wanted").mapInArrow(_text.frees(_squeeze(self.seed, self.key_bits)), "key long, packed binary")
        # classes of which no row has an id are found by their texts
        nameless = reps.where("doc_id IS NULL").select(F.col("wanted").alias("key"))
        lost = self.docs.where("doc_id IS NULL").select("text", F.lit(None).cast("long").alias("wanted")).mapInArrow(_text.frees(_squeeze(self.seed, self.key_bits)), "key long, packed binary")
        return checkpoint(known.union(lost.join(nameless, "key", "left_semi")).dropDuplicates(["key"]))

    @staticmethod
    def verified(screened: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        side = lambda c: texts.select(F.col("key").alias(c), F.col("packed").alias(f"packed_{c}"))
        return checkpoint(screened.join(side("a"), "a").join(side("b"), "b").mapInArrow(_text.frees(_verify), "a long, b long"))

    def links(self) -> DataFrame:
        """Links (a, b) between classes that give the true components: every
        link between classes is there or both ends are joined by others."""
        found = self.candidates()
        pairs = found.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
        pairs = checkpoint(pairs)
        first = self.screened(pairs.where("shared >= need").select("a", "b"))
        hot = checkpoint(found.where("token IS NOT NULL").select("token", "key", "trait", "place").distinct())
        texts = self.texts_of(first.select(F.col("a").alias("key")).union(first.select("b")).union(hot.select("key")))
        release(self.spark)
        edges = self.verified(first, texts)
        release(self.spark)
        for tried in (self._against_pivots, functools.partial(self._across, best=True), functools.partial(self._across, best=False)):
            label = _graph.components(edges)
            at = hot.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
            counted = at.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
            several = counted.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("of_main"), F.sum("c").alias("members"))
            open_ = several.where("of_main < members").select("token", "main", "of_main", (F.col("members") - F.col("of_main")).alias("others"))
            at = checkpoint(at.join(open_, "token"))
            if at.isEmpty():
                break
            edges = checkpoint(edges.union(self.verified(tried(at), texts)).distinct())
            release(self.spark)
        return edges

    @staticmethod
    def _compatible(x: str, y: str):
        p, q = F.shiftright(x, 3), F.shiftright(y, 3)
        return (100 * F.least(p, q)) >= PERCENT * F.greatest(p, q)

    def _against_pivots(self, at: DataFrame) -> DataFrame:
        """Members of each large group against a few of its members: those before
        whose shingle the fewest rarer ones stand, as they are next to the common
        text, one of each ``PIVOTS`` parts of the group."""
        # a few shingles of each class will do here: the last round covers the rest
        few = at.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("token")), 1, PIVOT_TOKENS).alias("t")).select("key", F.explode("t").alias("token"))
        at = at.join(few, ["key", "token"], "left_semi")
        part = F.pmod(F.xxhash64("key"), F.lit(PIVOTS))
        member = lambda i: F.min(F.when(part == i, F.struct("place", "key", "trait", "label")))
        pivots = at.groupBy("token").agg(F.array(*(member(i) for i in range(PIVOTS))).alias("p")).select("token", F.explode(F.array_compact("p")).alias("p"))
        pivots = pivots.select("token", F.col("p.key").alias("other"), F.col("p.trait").alias("other_trait"), F.col("p.label").alias("other_label"))
        met = at.join(pivots, "token").where((F.col("label") != F.col("other_label")) & self._compatible("trait", "other_trait"))
        return self.screened(met.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct())

    def _across(self, at: DataFrame, best: bool) -> DataFrame:
        """All pairs of large groups that are still apart and that the bitmaps permit
        to link; with ``best`` one pair of each two components.  The members of a
        group's main component and the others are dealt into blocks of about
        ``BLOCK`` classes.  Each block of others meets each block, in a place of
        its own, so no task gets a whole group, and what is merged costs a row."""
        blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
        at = at.join(self.classes.select("key", "bits"), "key").withColumns({"n1": blocks("of_main"), "n2": blocks("others"), "is_main": F.col("label") == F.col("main")})
        own = F.when(F.col("is_main"), F.pmod(F.xxhash64("key"), "n1")).otherwise(F.col("n1") + F.pmod(F.xxhash64("key"), "n2"))
        meets = F.sequence(F.when(F.col("is_main"), F.col("n1")).otherwise(0), F.col("n1") + F.col("n2") - 1)
        dealt = at.withColumn("own", own.cast("long")).select("*", F.explode(meets).alias("with"))
        columns = ["token", F.least("own", "with").cast("long").alias("low"), F.greatest("own", "with").cast("long").alias("high"), "own", "key", "trait", "place", "label", "bits"]
        dealt = dealt.select(*columns).repartition(self.parts, "token", "low", "high").sortWithinPartitions("token", "low", "high")
        met = dealt.mapInArrow(_text.frees(functools.partial(_across, best=best)), "x long, y long, bound long, a long, b long")
        if not best:
            return met.select("a", "b").distinct()
        return met.groupBy("x", "y").agg(F.min(F.struct("bound", "a", "b")).alias("p")).select("p.a", "p.b")

    def membership(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row of the input."""
        label = _graph.components(self.links())
        reps = self.classes.select("key", "rep").join(label.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
        lowest = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
        by_class = reps.join(lowest, "label").select("key", "component_id")
        out = self.rows.join(by_class, "key", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return Join(docs).membership()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each component.

    Of rows that repeat the id, all stay or all go."""
    kept = checkpoint(components(docs).where("doc_id = component_id OR doc_id IS NULL").select("doc_id").distinct())
    release(docs.sparkSession)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
