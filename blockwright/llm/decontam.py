"""Benchmark decontamination by template windows.

A text becomes a template: punctuation goes, words are lower-cased (ASCII), and
numbers, names (capitalised inside a sentence; several in a row are one) and units become typed
placeholders.  A capitalised word that opens a sentence may be a name or not, so
a text has two templates, one with such words as names and one without.  Windows of ``width`` template tokens are hashed and looked up
among the windows of the benchmark items; an item of fewer tokens is one window
as a whole.  A hit is then aligned: the words behind the placeholders must
agree one to one (equal slots of the item are equal in the document, different
ones differ), so a question with new numbers or names is caught, while a chance
meeting of placeholders is not.  Template windows with fewer than
``least_words`` words that are no placeholders are not used.  Beside the
templates all windows of all items are looked up by their bare words, which
must agree one by one; so a copy is found however many numbers and names it
holds, and whatever stands before it.  A pair of windows that meets both ways
counts once: ``n_windows`` are the words of the
document where a window of the item begins, ``n_verbatim`` those where one is equal word by word.

The benchmark's windows are sent to the tasks in blocks of about ``BLOCK``
bytes of items, each block against all documents, so what is sent at once is bounded
whatever the size of the benchmark; the usual benchmark is one block.

Edge cases: a null or empty text, or one of punctuation alone, has no windows;
an item with fewer than ``least_words`` words is found by its bare words only,
if short wherever they stand in a row; repeated documents give their rows each,
repeated items count once per id; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import _text
from blockwright.llm._session import quoted, ship

WIDTH = 8
LEAST_WORDS = 4
BLOCK = 1_000_000
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ml l liter liters litre litres"
    " s sec second seconds min minute minutes h hour hours day days week weeks month months year years"
    " meter meters metre metres percent degree degrees dollar dollars euro euros cent cents usd eur mph kmh hz khz mhz kb mb gb tb w kw v"
).split()

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:"]] = True
#: Hashes of the placeholders.
NUMBER, NAME, UNIT, QUANTITY = (np.uint64(n) for n in (11, 22, 33, 44))


def _word_hashes(text: bytes) -> np.ndarray:
    return _text.Words([text], lower=True).hash


_UNIT_HASHES = np.unique(_word_hashes(" ".join(UNITS).encode()))


class Templates:
    """The templates of a block of texts: ``token`` (hash or placeholder),
    ``plain`` (hash of the bare words), ``word`` and ``last`` (its first and last
    word) and ``first`` per text.  ``bare_only``: every word as it is."""

    def __init__(self, texts: list[bytes | None]):
        self.words = w = _text.Words(texts, lower=True)
        self.bare_only = self._view(None)
        n = w.starts.size
        if not n:
            self.inside = self.opening = self.bare_only
            self.opens = np.zeros(0, dtype=bool)
            return
        data = w.data
        # words without punctuation, and their letters alone, hashed from bare copies
        bare = np.where(_PUNCTUATION[data], 0, data).astype(np.uint8)
        sizes = self._count(bare != 0, w)
        digits = self._count(_DIGIT[data], w)
        plain = self._hash(bare != 0, w, sizes)
        letters = self._hash((bare != 0) & ~_DIGIT[data], w, sizes - digits)
        before = np.concatenate(([-1], w.ends[:-1] - 1))
        opens = np.zeros(n, dtype=bool)
        opens[w.first[:-1][w.first[:-1] < n]] = True
        opens |= _STOP[data[np.maximum(before, 0)]]
        feeds = np.concatenate(([0], np.cumsum(data == 10)))
        opens |= feeds[w.starts] > feeds[np.maximum(before, 0)]
        lead = w.starts + np.minimum(self._count_lead(data, w), w.ends - w.starts - 1)
        second = np.minimum(lead + 1, data.size - 1)
        capital = _UPPER[data[lead]] & ~_UPPER[data[second]] & (sizes > 1) & (digits == 0)
        token = np.where((digits == 0) & np.isin(plain, _UNIT_HASHES), UNIT, plain)
        token = np.where((digits > 0) & (digits == sizes), NUMBER, token)
        token = np.where((digits > 0) & (digits < sizes) & np.isin(letters, _UNIT_HASHES), QUANTITY, token)
        self.kept = np.flatnonzero(sizes > 0)
        # a name goes on in the next word if nothing stands between the two
        self.apart = opens | _PUNCTUATION[data[w.starts]] | np.concatenate(([True], _PUNCTUATION[data[w.ends[:-1] - 1]]))
        self.bare_only = self._view(plain)
        self.inside = self._view(plain, np.where(capital & ~opens, NAME, token))
        self.opening = self._view(plain, np.where(capital, NAME, token))
        #: Words that only the second template takes for names.
        self.opens = capital & opens

    def _view(self, plain: np.ndarray | None, token: np.ndarray | None = None) -> View:
        w = self.words
        if plain is None:
            none = np.zeros(0, np.int64)
            return View(self, none.astype(np.uint64), none, none, np.zeros(w.first.size, np.int64))
        keep = self.kept
        if token is None:
            return View(self, plain[keep], keep, keep, np.searchsorted(keep, w.first))
        name = token[keep] == NAME
        goes_on = np.zeros(keep.size, dtype=bool)
        goes_on[1:] = name[1:] & name[:-1] & ~self.apart[keep[1:]] & (keep[1:] == keep[:-1] + 1)
        head = np.flatnonzero(~goes_on)
        tail = np.concatenate((head[1:], [keep.size])) - 1 if head.size else head
        return View(self, token[keep[head]], keep[head], keep[tail], np.searchsorted(keep[head], w.first))

    @staticmethod
    def _count(mask: np.ndarray, w: _text.Words) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[w.ends] - total[w.starts]

    @staticmethod
    def _count_lead(data: np.ndarray, w: _text.Words) -> np.ndarray:
        """Punctuation bytes that open each word."""
        solid = np.flatnonzero(~_PUNCTUATION[data])
        at = np.minimum(np.searchsorted(solid, w.starts), max(0, solid.size - 1))
        return np.maximum(solid[at] - w.starts, 0)

    @staticmethod
    def _hash(mask: np.ndarray, w: _text.Words, sizes: np.ndarray) -> np.ndarray:
        inside = mask.copy()
        inside[_text.WHITE[w.data]] = False
        letters = w.data[inside]
        at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        place = np.arange(letters.size) - np.repeat(at, sizes)
        terms = np.concatenate((_text._LETTER[letters] * _text.place_factor(place), np.zeros(1, np.uint64)))
        total = np.add.reduceat(terms, at)
        return np.where(sizes > 0, _text.mix(total), np.uint64(0))


class View:
    """One template of each text of a block."""

    def __init__(self, of: Templates, token: np.ndarray, word: np.ndarray, last: np.ndarray, first: np.ndarray):
        self.of, self.token, self.word, self.last, self.first = of, token, word, last, first

    def bare(self, j: int) -> bytes:
        words = self.of.words
        found = [words.data[words.starts[k] : words.ends[k]] for k in range(self.word[j], self.last[j] + 1)]
        return b" ".join(_text.LOWER[x[~_PUNCTUATION[x]]].tobytes() for x in found)

    def slots(self, start: int, width: int) -> list[tuple[int, bytes]]:
        """Placeholder type and bare words of each slot of a window."""
        kinds = enumerate(self.token[start : start + width].tolist(), start)
        return [(kind, self.bare(j)) for j, kind in kinds if kind in (11, 22, 33, 44)]

    def bare_words(self, start: int, width: int) -> bytes:
        """The bare words of a window, parted by spaces."""
        return b" ".join(self.bare(j) for j in range(start, start + width))

    def place(self, start: int, width: int) -> tuple[int, int]:
        """The first and the last word of a window."""
        return int(self.word[start]), int(self.last[start + width - 1])


def consistent(item: list[tuple[int, bytes]], doc: list[tuple[int, bytes]]) -> bool:
    """Whether slots correspond one to one, within each type."""
    there: dict = {}
    back: dict = {}
    return all(a[0] == b[0] and there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(item, doc, strict=True))


def _windows(token: np.ndarray, width: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of a template, and which have enough words."""
    hashes = _text.rolled(token, width)
    words = np.concatenate(([0], np.cumsum(token > QUANTITY)))
    return hashes, words[width:] - words[:-width] >= least_words if hashes.size else np.zeros(0, dtype=bool)


class Index:
    """Windows of benchmark items, by width: ``found`` by template, ``exact`` by bare words."""

    def __init__(self, items: list[tuple[int, bytes]], width: int, least_words: int):
        self.least_words = least_words
        self.found: dict[int, dict[int, list]] = {}
        self.exact: dict[int, dict[int, list]] = {}
        for item, text in items:
            template = Templates([text])
            plain = template.bare_only
            if not plain.token.size:
                continue
            seen = set()
            for view in (template.inside, template.opening):
                n = min(width, view.token.size)
                hashes, enough = _windows(view.token, n, least_words)
                for at in np.flatnonzero(enough).tolist():
                    entry = (int(hashes[at]), view.place(at, n))
                    if entry not in seen:
                        seen.add(entry)
                        self.found.setdefault(n, {}).setdefault(entry[0], []).append((item, entry[1], view.slots(at, n)))
            n = min(width, plain.token.size)
            for at, key in enumerate(_text.rolled(plain.token, n).tolist()):
                self.exact.setdefault(n, {}).setdefault(key, []).append((item, plain.place(at, n), plain.bare_words(at, n)))
        self.keys = {n: self._sorted(found) for n, found in self.found.items()}
        self.exact_keys = {n: self._sorted(found) for n, found in self.exact.items()}

    @staticmethod
    def _sorted(found: dict[int, list]) -> np.ndarray:
        return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))

    @staticmethod
    def _hits(t: View, n: int, keys: np.ndarray, hashes: np.ndarray, usable: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, start) of the usable windows whose hash is a key."""
        some = np.flatnonzero(usable)
        if not some.size:
            return
        at = np.minimum(np.searchsorted(keys, hashes[some]), keys.size - 1)
        for start in some[keys[at] == hashes[some]].tolist():
            text = int(np.searchsorted(t.first, start, side="right")) - 1
            if start + n <= t.first[text + 1]:  # else it reaches into the next text
                yield text, start

    def matches(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, windows, windows that are equal word by word)."""
        for first, last in _text.blocks(texts):
            t = Templates(texts[first:last])
            counts: dict[tuple[int, int], dict[int, bool]] = {}

            def add(text: int, item: int, start: int, equal: bool, counts=counts) -> None:
                starts = counts.setdefault((text, item), {})
                starts[start] = starts.get(start, False) or equal

            plain, met = t.bare_only, set()
            for n, exact in self.exact.items():
                hashes = _text.rolled(plain.token, n)
                for text, start in self._hits(plain, n, self.exact_keys[n], hashes, np.ones(hashes.size, dtype=bool)):
                    words = plain.bare_words(start, n)
                    for item, place, own in exact[int(hashes[start])]:
                        if own == words:
                            met.add((plain.place(start, n), item, place))
                            add(text, item, plain.place(start, n)[0], True)
            opened = np.concatenate(([0], np.cumsum(t.opens)))
            for view in (t.inside, t.opening):
                for n, found in self.found.items():
                    hashes, enough = _windows(view.token, n, self.least_words)
                    if view is t.opening and hashes.size:  # where no such word stands, it is the first template
                        enough = enough & (opened[view.last[n - 1 :] + 1] > opened[view.word[: hashes.size]])
                    for text, start in self._hits(view, n, self.keys[n], hashes, enough):
                        slots, here = view.slots(start, n), view.place(start, n)
                        for item, place, own in found[int(hashes[start])]:
                            if (here, item, place) not in met and consistent(own, slots):
                                met.add((here, item, place))
                                add(text, item, here[0], own == slots)
            for (text, item), starts in sorted(counts.items()):
                yield first + text, item, len(starts), sum(starts.values())


def indexes(benchmark: DataFrame, width: int, least_words: int) -> Iterator[bytes]:
    """Packed indexes of blocks of items, each of at most BLOCK windows."""
    block: list[tuple[int, bytes]] = []
    size = 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").distinct().toLocalIterator():
        text = r["text"].encode()
        if size and size + len(text) > BLOCK:
            yield pickle.dumps(Index(block, width, least_words))
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    yield pickle.dumps(Index(block, width, least_words))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, item_id, n_windows and n_verbatim of each contaminated pair."""
    context, out = ship(docs.sparkSession).sparkContext, None
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_verbatim", pa.int64())])
    for packed in indexes(benchmark, width, least_words):
        index = context.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            lookup = pickle.loads(index.value)
            for batch in _text.small(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], item, n, equal) for i, item, n, equal in lookup.matches(_text.utf8(batch.column("text")))]
                yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], schema=schema)

        part = docs.select("doc_id", "text").mapInArrow(_text.frees(run), "doc_id long, item_id long, n_windows long, n_verbatim long")
        out = part if out is None else out.union(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without a matching window, all columns kept.  The input's
    columns wait inside a struct, whatever their names."""
    context = ship(docs.sparkSession).sparkContext
    out = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), "text")
    schema = out.schema
    for packed in indexes(benchmark, width, least_words):
        index = context.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            lookup = pickle.loads(index.value)
            for batch in _text.small(batches):
                clean = np.ones(batch.num_rows, dtype=bool)
                for i, *_ in lookup.matches(_text.utf8(batch.column("text"))):
                    clean[i] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(_text.frees(run), schema)
    return out.select("row.*")


def report(found: DataFrame) -> DataFrame:
    """Documents and windows per benchmark item."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.sum("n_windows").alias("n_windows"))
