"""Removal of repeated passages with a distributed, sparse suffix array.

A byte goes if a string of ``length`` bytes (100) that covers it also starts
earlier: in a smaller id, or further left in the same text.  Strings are those
of the input, and every copy but the first is removed.

1. *Anchors.*  Each window of 100 bytes has an anchor: the leftmost smallest
   36-byte gram in it, by hash.  Equal windows have equal anchors, so only
   suffixes at anchors (about one byte in 33) are considered.
2. *Pruning.*  Anchor hashes meet in buckets; anchors that occur once anywhere
   can't be in a repeated window and are dropped.
3. *Range partition.*  The surviving suffixes, with the bytes of their windows,
   go to buckets by their leading bytes, cut at sampled splitters.  Before
   that a task keeps only the first of suffixes with equal context, so a
   passage with any number of copies sends one suffix per batch of texts.
4. *Local sort.*  A task holds one bucket at a time and sorts its suffixes by
   multikey quicksort, eight bytes at a time.  Of equal
   contexts all but the first occurrence are repeats.  Where an anchor has
   different contexts, the suffixes at every window start are sorted the same
   way, and all but the first of each group are repeats.  Equal leading bytes
   never lie in two buckets, so neighbours across a boundary differ.
5. The repeated windows return to their text, which loses the bytes they cover.

Edge cases: a null text is empty; texts under 100 bytes lose nothing; a repeated
row (same id and text) is the same document as its twin and is treated alike;
rows with one id and different texts are ordered by a hash of the text; a null
id is smaller than all others; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import _text
from blockwright.llm._session import quoted, ship

#: Bytes of a long text that are looked at together.
PIECE = 1 << 22
GRAM = 36
LEAD = 24
#: Suffixes that are sorted without parting them first.
DIRECT = 1024
SAMPLE_TEXTS = 1500
SAMPLE_KEYS = 20_000
_POSITION = np.uint64((1 << 28) - 1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes at each place (shorter at the end: undefined)."""
    size, h = 1, _text._BYTE[data]
    left, out, done = width, None, 0
    power = _BASE
    while left:
        if left & 1:
            if out is None:
                out, done = h.copy(), size
            else:
                shifted = np.zeros_like(out)
                shifted[: out.size - size] = out[size:]
                out = h * np.uint64(pow(_BASE, done, 1 << 64)) + shifted
                done += size
        left >>= 1
        if left:
            doubled = h * np.uint64(power)
            doubled[: h.size - size] += h[size:]
            h, size, power = doubled, size * 2, power * power % (1 << 64)
    return _text.mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each place on (fewer at the end)."""
    out, size = values.copy(), 1
    while size < width:
        step = min(size, width - size)
        out[: out.size - step] = np.minimum(out[: out.size - step], out[step:])
        size += step
    return out


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with windows: its index, and for each of its anchors the
    place, the first and last window start, and the gram hash.  Long texts are
    cut into pieces that overlap so that each window is whole in one."""
    for first, last in _text.blocks(texts):
        if last - first > 1 or len(texts[first]) <= PIECE + length:
            yield from _block_anchors(texts, first, last, length)
            continue
        found: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(texts[first]) - length + 1, PIECE):
            for _, place, low, high, gram in _block_anchors([texts[first][at : at + PIECE + length - 1]], 0, 1, length):
                if found[0] and found[0][-1][-1] == place[0] + at:  # one anchor on both sides of the cut
                    found[2][-1][-1] = high[0] + at
                    place, low, high, gram = place[1:], low[1:], high[1:], gram[1:]
                for column, value in zip(found, (place + at, low + at, high + at, gram), strict=True):
                    if value.size:
                        column.append(value)
        yield first, *map(np.concatenate, found)


def _block_anchors(texts: list[bytes], first: int, last: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    some = texts[first:last]
    data = np.frombuffer(b"".join(some), dtype=np.uint8)
    if data.size < length:
        return
    sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
    start = np.concatenate(([0], np.cumsum(sizes)))
    h = gram_hashes(data, GRAM)
    packed = (h & ~_POSITION) | np.arange(data.size, dtype=np.uint64)
    place = (sliding_min(packed, length - GRAM + 1) & _POSITION).astype(np.int64)
    for i in np.flatnonzero(sizes >= length):
        at = place[start[i] : start[i + 1] - length + 1]
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        own = at[edge]
        yield first + i, own - start[i], edge, np.concatenate((edge[1:], [at.size])) - 1, h[own]


def multikey_order(data: np.ndarray, starts: np.ndarray, size: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``size`` bytes, within given groups, by multikey
    quicksort: suffixes of more than ``DIRECT`` are parted by eight bytes into
    lesser, equal and greater ones than a pivot, of which the equal go on
    with the next eight; smaller parts are sorted directly, all of them at once.

    Returns the order and, along it, the number of the class of equal suffixes.
    ``data`` must reach 8 bytes past the last byte compared."""
    words = np.ndarray((data.size - 7,), dtype=">u8", buffer=data.tobytes(), strides=(1,))
    m = starts.size
    if not m:
        return np.arange(0), np.zeros(0, dtype=np.int64)
    order, edge = np.arange(m), np.zeros(m, dtype=bool)
    edge[0] = True
    if group is not None:
        order = np.argsort(group, kind="stable")
        edge[1:] = group[order][1:] != group[order][:-1]

    def digit(own: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Eight bytes of each suffix, fewer at the end."""
        return words[starts[own] + at].astype(np.uint64) >> (8 * np.maximum(0, 8 - size + at)).astype(np.uint64)

    done = np.zeros(m, dtype=np.int64)  # bytes by which a suffix is known to be in order
    cuts = np.append(np.flatnonzero(edge), m)
    parts = [(int(b), int(e), 0) for b, e in zip(cuts[:-1], cuts[1:], strict=True) if e - b > DIRECT]
    while parts:
        b, e, at = parts.pop()
        if e - b <= DIRECT or at >= size:
            done[b:e] = at
            continue
        own = order[b:e]
        key = digit(own, np.int64(at))
        pivot = np.sort(key[[0, key.size // 2, -1]])[1]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[b:e] = np.concatenate((own[less], own[same], own[more]))
        low, high = b + int(less.sum()), e - int(more.sum())
        edge[low] = True
        if high < e:
            edge[high] = True
        parts += [(x, y, z) for x, y, z in ((b, low, at), (low, high, at + 8), (high, e, at)) if y > x]
    while True:
        label = np.cumsum(edge) - 1
        tied = np.flatnonzero((np.bincount(label)[label] > 1) & (done < size))
        if not tied.size:
            return order, label
        own = order[tied]
        key = digit(own, done[tied])
        rank = np.lexsort((key, label[tied]))
        order[tied], key = own[rank], key[rank]
        edge[tied[1:]] |= (key[1:] != key[:-1]) & (label[tied[1:]] == label[tied[:-1]])
        done[tied] += 8


def runs(places: np.ndarray) -> np.ndarray:
    """First and last of each run of consecutive numbers in a sorted array."""
    edge = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1] + 1, [True])))
    return np.stack([places[edge[:-1]], places[edge[1:] - 1]], axis=1)


_PARCELS = "part int, ds binary, hs binary, sizes binary, data binary"


def parcels(d: np.ndarray, h: np.ndarray, payload: list[bytes], parts: int) -> pa.RecordBatch:
    """Payloads of many texts, packed into a row per part of the texts."""
    part = (_text.mix(d.view(np.uint64) ^ _text.mix(h.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    columns: list[list] = [[], [], [], [], []]
    for k in np.flatnonzero(np.diff(edges)):
        at = order[edges[k] : edges[k + 1]]
        own = [payload[i] for i in at]
        values = (k, d[at].tobytes(), h[at].tobytes(), np.fromiter(map(len, own), dtype=np.uint32, count=len(own)).tobytes(), b"".join(own))
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    return pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "ds", "hs", "sizes", "data"])


def _unpack(name: str):
    """One row per text from the parcels of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for ds, hs, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("ds", "hs", "sizes", "data")), strict=True):
                end = np.cumsum(np.frombuffer(sizes, dtype=np.uint32)).tolist()
                start = 0
                for d, h, stop in zip(np.frombuffer(ds, dtype=np.int64).tolist(), np.frombuffer(hs, dtype=np.int64).tolist(), end, strict=True):
                    held.setdefault((d, h), []).append(data[start:stop])
                    start = stop
        keys = list(held)
        for at in range(0, len(keys), 2000):
            some = keys[at : at + 2000]
            yield pa.record_batch([pa.array([k[0] for k in some], pa.int64()), pa.array([k[1] for k in some], pa.int64()), pa.array([b"".join(held.pop(k)) for k in some], pa.binary())], names=["d", "h", name])

    return run


def _by_text(packed: DataFrame, name: str, parts: int) -> DataFrame:
    return packed.repartition(parts, "part").mapInArrow(_text.frees(_unpack(name)), f"d long, h long, {name} binary")


def _hash_anchors(length: int, buckets: int):
    names = ["bucket", "ds", "hs", "counts", "hashes", "ordinals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in _text.utf8(batch.column("text"))]
            d, h = batch.column("d").to_numpy(), batch.column("h").to_numpy()
            owner, ordinal, hashes = [], [], []
            for i, place, _, _, gram in anchors(texts, length):
                owner.append(np.full(place.size, i))
                ordinal.append(np.arange(place.size, dtype=np.uint32))
                hashes.append(gram)
            if not owner:
                continue
            owner, ordinal, hashes = map(np.concatenate, (owner, ordinal, hashes))
            bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            columns: list[list] = [[] for _ in names]
            for b in np.flatnonzero(np.diff(edges)):
                at = order[edges[b] : edges[b + 1]]
                who, count = np.unique(owner[at], return_counts=True)
                values = (b, d[who].tobytes(), h[who].tobytes(), count.astype(np.uint32).tobytes(), hashes[at].astype(np.uint32).tobytes(), ordinal[at].tobytes())
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

    return run


def _repeated(parts: int):
    """Per text, the ordinals of its anchors whose hash occurs twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []  # buckets arrive one after another
        for batch in batches:
            for b, *blobs in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and b != current:
                    if (found := _repeated_in(held))[2]:
                        yield parcels(*found, parts)
                    held = []
                current = b
                held.append(blobs)
        if held and (found := _repeated_in(held))[2]:
            yield parcels(*found, parts)

    return run


def _repeated_in(blobs: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    d, h = (np.concatenate([np.frombuffer(x[i], dtype=np.int64) for x in blobs]) for i in (0, 1))
    count, hashes, ordinal = (np.concatenate([np.frombuffer(x[i], dtype=np.uint32) for x in blobs]) for i in (2, 3, 4))
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    twin = np.zeros(s.size, dtype=bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    keep = np.zeros(s.size, dtype=bool)
    keep[order] = twin
    owner = np.repeat(np.arange(d.size), count)[keep]
    ordinal = ordinal[keep]
    if not owner.size:
        return d[:0], h[:0], []
    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
    who = owner[edge[:-1]]
    packed = [ordinal[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
    return d[who], h[who], packed


_SUFFIXES = "bucket int, d long, h long, spans binary, packed binary"


def _send_suffixes(length: int, splitters: list[bytes]):
    """Contexts of repeated anchors, packed per bucket; windows that a task
    already knows to be repeats as spans of their text."""
    cuts = np.array(splitters, dtype=f"S{LEAD}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in _text.utf8(batch.column("text"))]
            d, h = batch.column("d").to_pylist(), batch.column("h").to_pylist()
            wanted = batch.column("ordinals").to_pylist()
            best: dict[bytes, tuple[int, int, int, int]] = {}
            known: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for i, place, low, high, _ in anchors(texts, length):
                mine = np.unique(np.frombuffer(wanted[i], dtype=np.uint32))
                text = texts[i]
                for p, s, e in zip(place[mine].tolist(), low[mine].tolist(), high[mine].tolist(), strict=True):
                    context = text[s : e + length]
                    me = (d[i], h[i], s, p - s)
                    old = best.get(context)
                    if old is None:
                        best[context] = me
                    elif old[:3] != me[:3]:
                        first, later = (old, me) if old < me else (me, old)
                        best[context] = first
                        known.setdefault(later[:2], []).append((later[2], later[2] + e - s))
            rows: list[tuple] = [(i & 0x7FFF, *who, np.array(spans, dtype=np.int64).tobytes(), None) for i, (who, spans) in enumerate(known.items())]
            if best:
                contexts = list(best)
                lead = np.array([c[best[c][3] : best[c][3] + LEAD] for c in contexts], dtype=f"S{LEAD}")
                bucket = np.searchsorted(cuts, lead, side="right")
                order = np.argsort(lead, kind="stable")  # neighbours in a parcel are alike, which packs well
                edges = np.searchsorted(bucket[order], np.arange(cuts.size + 2))
                for b in np.flatnonzero(np.diff(edges)):
                    own = [contexts[j] for j in order[edges[b] : edges[b + 1]]]
                    traits = np.array([(*best[c], len(c)) for c in own], dtype=np.int64)
                    rows.append((b, None, None, None, zlib.compress(np.int64(len(own)).tobytes() + traits.tobytes() + b"".join(own), 1)))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "d", "h", "spans", "packed"])

    return run


def repeats_of(traits: np.ndarray, data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated windows among the contexts of a bucket: index of the context
    and window start inside it.  ``traits``: id, hash, start, anchor, size."""
    buffer = np.frombuffer(data + bytes(16), dtype=np.uint8)
    size = traits[:, 4]
    base = np.concatenate(([0], np.cumsum(size)))[:-1]
    # a repeated row sends the same contexts from each of its batches: one occurrence
    by = np.lexsort((traits[:, 2], traits[:, 1], traits[:, 0]))
    who = traits[by, :3]
    only = np.sort(by[np.concatenate(([True], (who[1:] != who[:-1]).any(axis=1)))])
    traits, size, base = traits[only], size[only], base[only]
    m = only.size
    # texts in their order: the occurrence of lesser rank is the first
    rank = np.empty(m, dtype=np.int64)
    rank[np.lexsort((traits[:, 2], traits[:, 1], traits[:, 0]))] = np.arange(m)
    # equal contexts, several texts: all but the first repeat whole
    order, label = _equal_contexts(buffer, base, size)
    first = np.full(label[-1] + 1, m, dtype=np.int64)
    np.minimum.at(first, label, rank[order])
    lead = rank[order] == first[label]
    whole = order[~lead]
    out_context = [np.repeat(whole, size[whole] - length + 1)]
    out_start = [_ranges(size[whole] - length + 1)]
    left = order[lead]
    # anchors that still have different contexts: sort the suffix of every window
    order, label = multikey_order(buffer, base[left] + traits[left, 3], GRAM)
    several = left[order][np.bincount(label)[label] > 1]
    count = size[several] - length + 1
    owner = np.repeat(several, count)
    offset = _ranges(count)
    order, label = multikey_order(buffer, base[owner] + offset, length)
    if label.size:
        n = np.bincount(label)
        tied = n[label] > 1
        order, label = order[tied], label[tied]
        where = owner[order]
        place = traits[where, 2] + offset[order]
        again = np.lexsort((place, traits[where, 1], traits[where, 0], label))
        order, label = order[again], label[again]
        where, place = owner[order], traits[owner[order], 2] + offset[order]
        same = np.zeros(order.size, dtype=bool)  # the first of a class, or the very same window in another context
        if order.size:
            head = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
            of = np.repeat(head, np.diff(np.concatenate((head, [order.size]))))
            t = traits[where]
            same = (place == place[of]) & (t[:, 0] == t[of, 0]) & (t[:, 1] == t[of, 1])
        out_context.append(where[~same])
        out_start.append(offset[order][~same])
    return only[np.concatenate(out_context)], np.concatenate(out_start)


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in turn."""
    total = int(counts.sum())
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(total) - np.repeat(begin, counts)


def _equal_contexts(buffer: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and classes of contexts that are equal as a whole."""
    orders, labels, top = [], [], 0
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        order, label = multikey_order(buffer, base[own], int(n))
        orders.append(own[order])
        labels.append(label + top)
        top += int(label[-1]) + 1
    return np.concatenate(orders), np.concatenate(labels)


def _sort_buckets(length: int, parts: int):
    def close(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        traits, data = [], []
        for packed in held:
            blob = zlib.decompress(packed)
            n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
            traits.append(np.frombuffer(blob, dtype=np.int64, count=5 * n, offset=8).reshape(n, 5))
            data.append(blob[8 + 40 * n :])
        traits = np.concatenate(traits)
        context, start = repeats_of(traits, b"".join(data), length)
        if not context.size:
            return
        d, h, place = traits[context, 0], traits[context, 1], traits[context, 2] + start
        order = np.lexsort((place, h, d))
        d, h, place = d[order], h[order], place[order]
        edge = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]), [True])))
        packed = [runs(place[x:y]).tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
        yield parcels(d[edge[:-1]], h[edge[:-1]], packed, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []  # buckets arrive one after another
        for batch in batches:
            spans = batch.filter(pa.compute.is_valid(batch.column("spans")))
            if spans.num_rows:
                yield parcels(spans.column("d").to_numpy(), spans.column("h").to_numpy(), spans.column("spans").to_pylist(), parts)
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if packed is None:
                    continue
                if held and b != current:
                    yield from close(held)
                    held = []
                current = b
                held.append(packed)
        if held:
            yield from close(held)

    return run


def covered(spans: bytes | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges [first, end) that the windows of all spans cover."""
    if not spans:
        return []
    found = np.frombuffer(spans, dtype=np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0], kind="stable")]
    out: list[tuple[int, int]] = []
    for first, last in found.tolist():
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last + length)
        else:
            out.append((first, last + length))
    return out


def cut(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for first, end in ranges:
        kept.append(text[at:first])
        at = end
    kept.append(text[at:])
    return b"".join(kept)


def _sampled_leads(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.small(batches):
            texts = [t or b"" for t in _text.utf8(batch.column("text"))]
            leads = [texts[i][p : p + LEAD] for i, place, *_ in anchors(texts, length) for p in place[::4].tolist()]
            yield pa.record_batch([pa.array(leads, pa.binary())], names=["lead"])

    return run


def _splitters(docs: DataFrame, length: int, ranges: int) -> list[bytes]:
    """Cuts between ranges from the anchors of a bounded sample of texts."""
    total = max(1, docs.count())
    draw = F.pmod(F.xxhash64("d", "h", F.lit("splitters")), F.lit(1 << 30))
    some = docs.where(draw < int(min(1.0, SAMPLE_TEXTS / total) * (1 << 30)))
    leads = some.select("text").mapInArrow(_text.frees(_sampled_leads(length)), "lead binary")
    found = sorted(bytes(r[0]) for r in leads.orderBy(F.xxhash64("lead")).limit(SAMPLE_KEYS).collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` plus d, h and ``spans``: packed first and last starts of repeated
    windows (null: none)."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    parts = int(ship(docs.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    marked = docs.withColumns({"d": F.coalesce(F.col("doc_id"), F.lit(-(2**63))), "h": F.xxhash64("text")})
    narrow = marked.select("d", "h", "text")
    buckets = 2 * parts
    hashed = narrow.mapInArrow(_text.frees(_hash_anchors(length, buckets)), "bucket int, ds binary, hs binary, counts binary, hashes binary, ordinals binary")
    wanted = _by_text(hashed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_text.frees(_repeated(parts)), _PARCELS), "ordinals", parts)
    splitters = _splitters(narrow, length, 2 * parts)
    # both joins take the same columns, so that Spark shuffles the texts once
    suffixes = marked.join(wanted, ["d", "h"]).mapInArrow(_text.frees(_send_suffixes(length, splitters)), _SUFFIXES)
    sorted_ = suffixes.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_text.frees(_sort_buckets(length, parts)), _PARCELS)
    return marked.join(_by_text(sorted_, "spans", parts), ["d", "h"], "left")


def digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """Sizes and digest of what is left of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.small(batches):
            rows = []
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), _text.utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                ranges, text = covered(spans, length), text or b""
                rows.append((doc, len(text), sum(e - s for s, e in ranges), len(ranges), hashlib.sha256(cut(text, ranges)).hexdigest()))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    found = repeated_spans(docs.select("doc_id", "text"), length)
    return found.select("doc_id", "text", "spans").mapInArrow(_text.frees(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``.  A character of which
    only part was repeated goes as a whole; a null text stays null."""
    # other columns wait inside a struct, so that none clashes with those used here
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(quoted(c)) for c in other)).alias("_other"))
    schema = held.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.small(batches):
            texts = [None if t is None else cut(t, covered(s, length)).decode("utf-8", "ignore") for t, s in zip(_text.utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("_other")], names=["doc_id", "text", "_other"])

    found = repeated_spans(held, length).select("doc_id", "text", "_other", "spans")
    out = found.mapInArrow(_text.frees(run), schema)
    return out.select(*(c if c in ("doc_id", "text") else F.col("_other")[c].alias(c) for c in docs.columns))
