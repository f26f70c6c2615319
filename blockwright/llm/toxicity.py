"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its different words (ASCII letters lower-cased), and the
first four, five and six bytes of longer words, so that one stem with many
endings is one term; each is hashed.  The score is
``sigmoid(bias + sum of weights + sum over pairs <v_i, v_j>)`` over the text's
known terms: the pair term sees combinations that single weights add up wrongly.
Pairs cost no more than terms: half of (sum v)^2 minus the sum of v^2.

The machine is fitted on a bounded sample of labelled rows outside the holdout:
``positives`` and ``negatives`` ids, by hash of the id, with one text each.  It
takes every term whose rate differs between the classes and every two
terms that go together in one class more than in the other, be their own
rates equal, both at the level ``LEVEL`` over all terms or pairs tested; pairs
are tested among terms common in both classes, where the test holds.  The bias is
then moved to the share of toxic rows among all training labels.  Scoring
covers whole texts.

Edge cases: a null or empty text has no terms and gets the score of the bias;
rows with a null label teach nothing, of repeated labels the larger counts; of
rows that repeat an id one text teaches; where nothing can be told apart, and so
with labels of one kind, every score is the share of toxic labels, and without labels 0; repeated rows give a row
each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import pickle
import statistics
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm import _text
from blockwright.llm._session import quoted, ship
from blockwright.llm.langid import held_out

PREFIXES = (4, 5, 6)
FACTORS = 8
THRESHOLD = 0.7
#: Chance that the screens take any term that tells nothing.
LEVEL = 0.05
#: Terms in this share of the rows of each class are tested in pairs.
COMMON = 0.1


def terms(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted hashed terms of each text."""
    out: list[np.ndarray] = []
    for first, last in _text.blocks(texts):
        words = _text.Words(texts[first:last], lower=True)
        length = words.ends - words.starts
        grams = [words.hash]
        h = np.zeros(words.starts.size, dtype=np.uint64)
        for j in range(max(PREFIXES)):
            at = np.minimum(words.starts + j, words.data.size - 1)
            h = h * np.uint64(0x100000001B3) + _text.LOWER[words.data[at]].astype(np.uint64) + np.uint64(1)
            if j + 1 in PREFIXES:
                grams.append(np.where(length > j + 1, _text.mix(h + np.uint64(j + 1)), words.hash))
        small = [(g >> np.uint64(32)).astype(np.uint32) for g in grams]
        for i in range(last - first):
            own = words.of(i)
            out.append(np.unique(np.concatenate([g[own] for g in small])))
    return out


class Machine:
    """A fitted factorization machine; ``known`` are its sorted terms."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, factor: np.ndarray, bias: float):
        self.known, self.weight, self.factor, self.bias = known, weight, factor, bias

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.bias == -math.inf:
            return out
        for i, own in enumerate(terms(texts)):
            at = np.minimum(np.searchsorted(self.known, own), max(self.known.size - 1, 0))
            hit = at[self.known[at] == own] if self.known.size else at[:0]
            total = self.bias
            if hit.size:
                v = self.factor[hit]
                total += self.weight[hit].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()
            out[i] = 1 / (1 + math.exp(-min(40.0, max(-40.0, total))))
        return out


def _bar(tests: int) -> float:
    """How many standard deviations are significant among so many tests."""
    return statistics.NormalDist().inv_cdf(1 - LEVEL / (2 * max(tests, 1)))


def _in_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which columns go together with another one differently in two classes:
    the difference of the covariances, in standard deviations."""
    width = a.shape[1]
    a, b = (m.astype(np.float32) - m.mean(axis=0, dtype=np.float32) for m in (a, b))
    most = np.zeros(width)
    for s in range(0, width, 500):
        moments = []
        for m in (a, b):
            c = m[:, s : s + 500].T @ m / len(m)
            moments.append((c, ((m[:, s : s + 500] ** 2).T @ (m * m) / len(m) - c * c) / len(m)))
        (c1, v1), (c0, v0) = moments
        z = np.abs(c1 - c0) / np.sqrt(np.maximum(v1 + v0, 1e-9))
        z[np.arange(z.shape[0]), np.arange(s, s + z.shape[0])] = 0
        most[s : s + 500] = z.max(axis=1)
    return most >= _bar(width * (width - 1) // 2)


def fit(rows: list[np.ndarray], toxic: np.ndarray, prior: float, steps: int = 400) -> Machine:
    """Fit on term arrays and 0/1 labels; ``prior``: the share of ones to expect."""
    shift = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))  # the fit weighs both classes alike
    none = Machine(np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)), shift)
    n1 = int(toxic.sum())
    n0 = toxic.size - n1
    if not n1 or not n0:
        return none
    found, at = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [r.size for r in rows])
    f1 = np.bincount(at, weights=toxic[owner], minlength=found.size)
    f0 = np.bincount(at, minlength=found.size) - f1
    pooled = (f1 + f0) / toxic.size
    z = (f1 / n1 - f0 / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / n0))

    def matrix(some: np.ndarray, kind) -> np.ndarray:
        column = np.full(found.size, -1, dtype=np.int64)
        column[some] = np.arange(some.size)
        x = np.zeros((len(rows), some.size), dtype=kind)
        ok = column[at] >= 0
        x[owner[ok], column[at[ok]]] = 1
        return x

    telling = (f1 + f0 >= 3) & (np.abs(z) >= _bar(int((f1 + f0 >= 3).sum())))
    share1, share0 = f1 / n1, f0 / n0
    common = np.flatnonzero((np.minimum(share1, share0) >= COMMON) & (np.maximum(share1, share0) <= 1 - COMMON) & (np.minimum(f1, f0) >= 30))
    if common.size > 1:
        both = matrix(common, np.uint8)
        telling[common[_in_pairs(both[toxic > 0], both[toxic <= 0])]] = True
    usable = np.flatnonzero(telling)
    if not usable.size:
        return none
    x = matrix(usable, np.float32)
    y = toxic.astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(7))
    params = [np.zeros(1, np.float32), np.zeros(usable.size, np.float32), rng.normal(0, 0.02, (usable.size, FACTORS)).astype(np.float32)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    balance = np.where(y > 0, 0.5 / n1, 0.5 / n0).astype(np.float32)
    for step in range(1, steps + 1):
        bias, w, v = params
        xv = x @ v
        margin = bias + x @ w + 0.5 * ((xv * xv).sum(axis=1) - x @ (v * v).sum(axis=1))
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) * balance
        gradient = [error.sum(keepdims=True), x.T @ error + 1e-6 * w, x.T @ (error[:, None] * xv) - (x.T @ error)[:, None] * v + 1e-5 * v]
        for i, g in enumerate(gradient):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - 0.15 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Machine(found[usable], params[1].astype(np.float64), params[2].astype(np.float64), float(params[0][0]) + shift)


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, negatives: int = 5000) -> Machine:
    """Fit on at most so many labelled documents outside the holdout."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 11) / F.lit(float(2**53))
    share = F.when(F.col("toxic") == 1, F.lit(positives / max(n1, 1))).otherwise(F.lit(negatives / max(n0, 1)))
    # the sample's ids are bounded by its two parameters, whatever the corpus
    ship(docs.sparkSession)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.where(draw < share)), "doc_id")
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.small(batches):
            found = [t.tobytes() for t in terms(_text.utf8(batch.column("text")))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "terms"])

    rows, toxic = [], []
    for r in sorted(chosen.select("doc_id", "toxic", "text").mapInArrow(_text.frees(run), "doc_id long, toxic int, terms binary").toLocalIterator(), key=lambda r: (r["doc_id"], r["terms"])):
        rows.append(np.frombuffer(bytes(r["terms"]), dtype=np.uint32))
        toxic.append(r["toxic"])
    if not n1 + n0:
        return Machine(np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)), -math.inf)
    return fit(rows or [np.zeros(0, np.uint32)], np.array(toxic or [0], dtype=np.int64), n1 / (n1 + n0))


@functools.lru_cache(maxsize=1)
def _loaded(packed: bytes) -> Machine:
    return pickle.loads(packed)


def score_documents(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns ``keep`` plus ``score``."""
    model = ship(docs.sparkSession).sparkContext.broadcast(pickle.dumps(machine))
    schema = docs.select([quoted(k) for k in keep]).schema.add("score", "double")
    carried = [quoted(k) for k in dict.fromkeys([*keep, "text"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _loaded(model.value)
        for batch in _text.small(batches):
            score = machine.score(_text.utf8(batch.column("text")))
            yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(score, pa.float64())], names=[*keep, "score"])

    return docs.select(carried).mapInArrow(_text.frees(run), schema)


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, all columns kept.  The
    input's columns wait inside a struct, so none clashes with the score."""
    held = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), "text")
    scored = score_documents(held, train(docs, labels), ["row"])
    return scored.where(F.col("score") < THRESHOLD).select("row.*")


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict of each document."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
