"""Vectorised byte-level text primitives shared by the operators.

Texts are handled as UTF-8 bytes in bounded blocks: a block holds whole texts,
about ``BLOCK_BYTES`` of them, or one text alone if it is longer.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
#: Space and U+0009 to U+000D separate words.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_LETTER = _BYTE[LOWER]
_PLACE = _rng.integers(1, 2**64 - 1, 4096, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def place_factor(place: np.ndarray) -> np.ndarray:
    """An odd factor for each place in a word, without a period."""
    out = _PLACE[np.minimum(place, _PLACE.size - 1)]
    far = np.flatnonzero(place >= _PLACE.size)
    if far.size:
        out[far] = mix(place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return out


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as bytes; a null stays None."""
    return column.cast(pa.binary()).to_pylist()


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that little is held as Python objects."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)


def _give_back() -> None:
    """Free memory goes back to the system, where it can be told so."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frees(run: Callable) -> Callable:
    """The same task on Arrow batches; what it used does not stay with its worker,
    which waits for other tasks beside the workers of later stages."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return freed


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Index ranges of the texts that make up each block."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of a block of texts.

    ``starts``/``ends``: byte offsets in ``data``; ``first``: for each text the
    index of its first word, with the word count at the end; ``hash``: 64 bits
    of each word, of its ASCII-lower-cased bytes if ``lower``.
    """

    def __init__(self, texts: list[bytes | None], lower: bool):
        self.data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes + 1)))
        inside = ~WHITE[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside.size and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.text_start)
        letters = self.data[inside]
        lengths = self.ends - self.starts
        at = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        place = np.arange(letters.size, dtype=np.int64) - np.repeat(at, lengths)
        terms = (_LETTER if lower else _BYTE)[letters] * place_factor(place)
        self.hash = mix(np.add.reduceat(terms, at)) if at.size else np.zeros(0, dtype=np.uint64)

    def of(self, text: int) -> slice:
        return slice(self.first[text], self.first[text + 1])


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every window of ``width`` consecutive hashes."""
    n = hashes.size - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(out)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The sorted set of word-window hashes of one text; a shorter text is one
    window as a whole, and a text without words has none."""
    if not words.size:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(rolled(words, min(width, words.size)))
