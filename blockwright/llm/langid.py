"""Language identification by prediction by partial matching.

For each language a context tree over all bytes (ASCII letters lower-cased)
holds the counts of every byte after every context of up to three bytes.  A byte that
a context has seen costs its share; else the escape (method C: as many escapes
as different bytes seen) is paid and the next shorter context is asked, with
the bytes seen before excluded.  Statistics are frozen after training, so the
cost of each (context, byte) is a constant; the trees are compiled into
tables, and the code length of a text is an exact sum of table entries, the
same as walking the trees.  The language with the shortest code wins, ties in
name order; the score is its share under equal priors.

The trees are fitted on a bounded sample: ``texts_per_language`` whole texts
of each language, taken by a hash of id and text from the training rows; rows
that agree in both count once.  Scoring covers whole texts.  The tables are sparse: an entry for each string of three
or four bytes seen in any language, and the escape of each context; only single
bytes of context have a full table.  So they are bounded by the sample.

Edge cases: ``und`` with score 0 for null or letterless texts, and for all
texts when nothing can be learned; a null language is never learned; repeated
rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import _text
from blockwright.llm._session import ship

ORDER = 3
_LETTER = regex.compile(r"\p{L}")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, texts_per_language: int) -> dict[str, list[bytes]]:
    """At most so many whole training texts per language, by hash of id and text."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("langid")), 11) / F.lit(float(2**53))
    limit = F.lit(0.0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1.0, texts_per_language / n))).otherwise(limit)
    out: dict[str, list] = {}
    chosen = rows.where(draw < limit).groupBy("lang", draw.alias("draw")).agg(F.first("text").alias("text"))
    for r in chosen.toLocalIterator():
        out.setdefault(r["lang"], []).append((r["draw"], r["text"].encode()))
    return {lang: [t for _, t in sorted(found)[:texts_per_language]] for lang, found in sorted(out.items())}


def _distribution(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of all symbols in each context (rows), given those of the
    next shorter context; symbols seen here are excluded there."""
    total = counts.sum(axis=1, keepdims=True)
    seen = counts > 0
    kinds = seen.sum(axis=1, keepdims=True)
    rest = np.where(seen, 0, lower)
    left = rest.sum(axis=1, keepdims=True)
    full = left <= 1e-300
    escape = np.where(full, 0, kinds / np.maximum(total + kinds, 1))
    own = counts * (1 - escape) / np.maximum(total, 1)
    return np.where(total == 0, lower, own + escape * rest / np.where(full, 1, left))


def _find(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of codes in a sorted table, its size where they are absent."""
    if not table.size:
        return np.zeros(codes.size, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, codes), table.size - 1)
    return np.where(table[at] == codes, at, table.size)


def _merged(gram: np.ndarray, count: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a shorter context and their counts."""
    short, at = np.unique(gram & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
    return short, np.bincount(at, weights=count, minlength=short.size)


class Level:
    """Probabilities after contexts of one length in one language, given those of
    the next shorter context: the share of each gram that was seen, and for
    each context the factor on the lower probability of all other bytes."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, lower):
        self.gram, self.lower = gram, lower
        self.context, at = np.unique(gram >> np.uint32(8), return_inverse=True)
        total, kinds = np.bincount(at, weights=count), np.bincount(at)
        kinds_left = np.where(kinds == 256, 0, kinds)  # no escape where all bytes were seen
        rest = np.maximum(1 - np.bincount(at, weights=lower(gram)), 1e-300)
        self.factor = np.where(kinds == 256, 1.0, kinds / (total + kinds) / rest) if gram.size else np.zeros(0)
        self.share = count / (total + kinds_left)[at]

    def escape(self, context: np.ndarray) -> np.ndarray:
        return np.append(self.factor, 1.0)[_find(self.context, context)]

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        at = _find(self.gram, gram)
        return np.where(at < self.gram.size, np.append(self.share, 0)[at], self.escape(gram >> np.uint32(8)) * self.lower(gram))


class Trees:
    """Compiled context trees: bits of each byte in each context, per language."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        self.symbol = _text.LOWER.astype(np.int64)
        self.size = a = 256
        self.pad = b" " * ORDER
        self.short = np.zeros((a * a, len(self.languages)), dtype=np.float32)
        levels: dict[int, list[Level]] = {2: [], 3: []}
        for k, lang in enumerate(self.languages):
            gram, count = np.unique(np.concatenate([self._codes(self.pad + t) for t in texts[lang]] or [np.zeros(0, np.uint32)]), return_counts=True)
            p = np.full((1, a), 1 / a)
            for order in range(2):
                tall = np.bincount(gram & np.uint32(a ** (order + 1) - 1), weights=count, minlength=a ** (order + 1)).reshape(-1, a)
                p = _distribution(tall, np.tile(p, (tall.shape[0] // p.shape[0], 1)))
            self.short[:, k] = -np.log2(p).reshape(-1)
            lower = functools.partial(lambda p, g: p[g & np.uint32(0xFFFF)], p.reshape(-1))
            for order in (2, 3):
                own = Level(*_merged(gram, count, order), lower)
                levels[order].append(own)
                lower = functools.partial(lambda level, mask, g: level(g & mask), own, np.uint32((1 << 8 * (order + 1)) - 1))
        #: By order: grams seen in any language and their bits, contexts and the
        #: bits of their escapes (a last row for unknown contexts).
        self.tables = {}
        for order, own in levels.items():
            gram = np.unique(np.concatenate([x.gram for x in own])) if own else np.zeros(0, np.uint32)
            context = np.unique(gram >> np.uint32(8))
            bits = np.zeros((gram.size, len(own)), dtype=np.float32)
            escape = np.zeros((context.size + 1, len(own)), dtype=np.float32)
            for k, level in enumerate(own):
                bits[:, k] = -np.log2(level(gram))
                escape[:-1, k] = -np.log2(level.escape(context))
            self.tables[order] = gram, bits, context, escape

    @staticmethod
    def _codes(padded: bytes) -> np.ndarray:
        """Each byte with the three before it, in one number."""
        s = _text.LOWER[np.frombuffer(padded, dtype=np.uint8)].astype(np.uint32)
        return (s[:-3] << np.uint32(24)) | (s[1:-2] << np.uint32(16)) | (s[2:-1] << np.uint32(8)) | s[3:]

    def _cost(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each code's last byte after the bytes before it."""
        if order == 1:
            return self.short[codes]
        gram, bits, context, escape = self.tables[order]
        at = _find(gram, codes)
        new = np.flatnonzero(at == gram.size)
        if new.size == codes.size:
            out = np.zeros((codes.size, len(self.languages)), dtype=np.float32)
        else:
            out = bits[np.minimum(at, gram.size - 1)]
        if new.size:
            rare = codes[new]
            out[new] = escape[_find(context, rare >> np.uint32(8))] + self._cost(rare & np.uint32((1 << 8 * order) - 1), order - 1)
        return out

    def bits(self, texts: list[bytes | None]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for first, last in _text.blocks(texts):
            some = [t or b"" for t in texts[first:last]]
            cost = self._cost(self._codes(self.pad + self.pad.join(some)))
            sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            start = np.concatenate(([0], np.cumsum(sizes + len(self.pad))))[:-1]
            edges = np.stack([start, start + sizes], axis=1).reshape(-1)
            full = np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)])
            sums = np.add.reduceat(full, np.minimum(edges, full.shape[0] - 1), axis=0, dtype=np.float64)[0::2]
            sums[sizes == 0] = 0
            out[first:last] = sums
        return out


def has_letter(text: bytes | None) -> bool:
    return bool(text) and _LETTER.search(text.decode("utf-8", "replace")) is not None


def choose(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = bits.argmin(axis=1)
    share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
    return best, share


@functools.lru_cache(maxsize=1)
def _loaded(packed: bytes) -> Trees:
    return pickle.loads(zlib.decompress(packed))


def predict(docs: DataFrame, texts_per_language: int = 400) -> DataFrame:
    """Predicted language and score of each document."""
    ship(docs.sparkSession)
    trees = Trees(sample(docs, texts_per_language))
    model = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(trees), 1))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _loaded(model.value)
        for batch in _text.small(batches):
            texts = _text.utf8(batch.column("text"))
            if trees.languages:
                best, share = choose(trees.bits(texts))
            known = [bool(trees.languages) and has_letter(t) for t in texts]
            names = [trees.languages[best[i]] if ok else "und" for i, ok in enumerate(known)]
            score = [min(1.0, float(share[i])) if ok else 0.0 for i, ok in enumerate(known)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_text.frees(run), "doc_id long, held_out boolean, lang_pred string, score double")
