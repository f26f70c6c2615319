"""Quality rules with risk-controlled thresholds, in built-in functions only.

Base statistics are computed per whole text inside one row: nothing is
exploded or shuffled.  Three-word windows are hashed, packed with their
position, sorted as primitive longs, and neighbours with equal hash are
compared word by word, so a hash collision can't count as a repeat.

Each rule rejects a text whose rate (in hundredths) reaches a cutoff.  In each
stratum (language) the rules become stricter in steps; a step lowers the cutoff of one rule.
The steps go by how much more often labelled bad texts of the stratum reach
the cutoff than texts without a label, at least ``LIFT`` times; so their order is
fixed before any good text is looked at.  Then the good texts of the labelled holdout decide: a step is
taken as long as the exact binomial test rejects "more than ``alpha`` of the good
texts would be lost by all rules together".  Tests in a fixed order need no
correction between them; the level ``delta`` is split over the strata by their
numbers of good texts (weighted Bonferroni): each gets at least what its first
test needs, as long as that is possible for all, and those with the fewest
stay without rules; ``evidence`` names them.  Together no
more than ``alpha`` of a stratum's good texts are rejected by the rules, in all
strata at once with confidence ``1 - delta``.  The driver gets only counts of strata with
enough evidence, a few times rules x 101 of each, never rows.

Edge cases: a null text has no words and fails the base rule, as does an empty
one; a null language is a stratum of its own, as is an empty one; repeated rows give a row each;
of repeated labels the better one counts; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwright.llm._session import checkpoint

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: How much oftener bad texts must reach a cutoff than others.
LIFT = 2.0
#: Rate in hundredths, from the base statistics.
RULES = {
    "symbols": "least(100, n_symbols * 100 div greatest(word_chars, 1))",
    "duplicate_lines": "least(100, n_dup_lines * 100 div greatest(n_lines, 1))",
    "repeated_words": "least(100, n_repeat_words * 100 div greatest(n_words, 1))",
    "long_words": "least(100, word_chars * 4 div greatest(n_words, 1))",
}


def _length_without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def base_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` plus counts of words, symbols, lines and repeats."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.translate(text, WHITE, " " * len(WHITE))
    one = docs.select(
        *keep,
        F.array_remove(F.split(blank, " "), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "").alias("_lines"),
        _length_without(text, WHITE).cast("long").alias("word_chars"),
        (F.length(text) - _length_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
    )
    two = one.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_bits": F.expr("length(bin(size(_words)))"),
    })
    packed = F.expr("""
        sort_array(transform(
            slice(_words, 1, greatest(size(_words) - 2, 0)),
            (w, i) -> coalesce(shiftleft(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _bits) | cast(i AS BIGINT), 0L)))
    """)
    three = two.withColumn("_sorted", packed).withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1L"))
    same = """(x, i) -> {edge} AND shiftrightunsigned(x, _bits) = shiftrightunsigned(get(_sorted, i + {step}), _bits)
        AND get(_words, cast(x & _mask AS INT)) = get(_words, cast(get(_sorted, i + {step}) & _mask AS INT))
        AND get(_words, cast(x & _mask AS INT) + 1) = get(_words, cast(get(_sorted, i + {step}) & _mask AS INT) + 1)
        AND get(_words, cast(x & _mask AS INT) + 2) = get(_words, cast(get(_sorted, i + {step}) & _mask AS INT) + 2)"""
    after = same.format(edge="i + 1 < size(_sorted)", step=1)
    before = same.format(edge="i > 0", step=-1).removeprefix("(x, i) -> ")
    four = three.withColumn("_repeats", F.expr(f"filter(_sorted, {after.replace('-> ', '-> (', 1)}) OR ({before}))"))
    covered = "transform(_repeats, x -> array(x & _mask, (x & _mask) + 1L, (x & _mask) + 2L))"
    out = four.withColumn("n_repeat_words", F.expr(f"if(size(_repeats) = 0, 0L, cast(size(array_distinct(flatten({covered}))) AS BIGINT))"))
    return out.drop("_words", "_lines", "_bits", "_sorted", "_mask", "_repeats")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rejects(lost: int, good: int, rate: float, level: float) -> bool:
    """Whether ``lost`` of ``good`` refutes a loss of more than ``rate``: the exact
    binomial lower tail at ``rate`` is at most ``level``."""
    if good == 0:
        return False
    peak, terms = -math.inf, []
    for i in range(lost + 1):
        term = math.lgamma(good + 1) - math.lgamma(i + 1) - math.lgamma(good - i + 1) + i * math.log(rate) + (good - i) * math.log1p(-rate)
        terms.append(term)
        peak = max(peak, term)
    return peak + math.log(sum(math.exp(t - peak) for t in terms)) <= math.log(level)


def least_evidence(alpha: float, level: float) -> int:
    """Good texts without a loss that a test needs to pass."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def levels(good: list[tuple[str | None, int]], alpha: float, delta: float) -> dict[str | None, float]:
    """The share of ``delta`` of each stratum that can get enough of it."""
    least, total = {}, 0.0
    for stratum, n in sorted(good, key=lambda x: (-x[1], x[0] is not None, x[0] or "")):
        if total + (1 - alpha) ** n > delta:
            break
        least[stratum] = (1 - alpha) ** n
        total += least[stratum]
    return {stratum: own + (delta - total) / len(least) for stratum, own in least.items()}


def strictest(lost_at: dict[int, int], steps: int, good: int, alpha: float, level: float) -> int:
    """The last of the steps before the first that fails; ``lost_at``: good texts
    that are first lost at each step."""
    lost = 0
    for step in range(1, steps + 1):
        lost += lost_at.get(step, 0)
        if lost > good * alpha or not rejects(lost, good, alpha, level):
            return step - 1
    return steps


def path(bad: list[dict[int, int]], other: list[dict[int, int]]) -> list[tuple[int, int]]:
    """The steps, as (rule, cutoff), by the texts per rate of each rule."""
    found = []
    for rule, (b, o) in enumerate(zip(bad, other, strict=True)):
        n_bad, n_other, bad_reach, other_reach = sum(b.values()), sum(o.values()), 0, 0
        for rate in range(100, -1, -1):
            bad_reach += b.get(rate, 0)
            other_reach += o.get(rate, 0)
            if b.get(rate) and (lift := bad_reach * (n_other + 1) / (n_bad * (other_reach + 1))) >= LIFT:
                found.append((-lift, rule, -rate))
    return [(rule, -rate) for _, rule, rate in sorted(found)]


def first_steps(steps: list[tuple[int, int]], rule: int) -> list[int]:
    """For each rate the first step that rejects it by a rule."""
    return [min((k for k, (own, cutoff) in enumerate(steps, 1) if own == rule and cutoff <= rate), default=len(steps) + 1) for rate in range(101)]


class Calibration:
    """Statistics of documents with the step from which on the rules reject each."""

    def __init__(self, docs: DataFrame, labels: DataFrame, alpha: float, delta: float):
        spark = docs.sparkSession
        statistics = base_statistics(docs, ["doc_id", F.col("lang").alias("stratum")])
        held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))
        rates = [F.expr(rate).cast("int").alias(name) for name, rate in RULES.items()]
        self.statistics = checkpoint(statistics.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), held.alias("holdout"), *rates))
        best = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        marked = self.statistics.where("NOT base_failed").join(best, "doc_id", "left").withColumn("tested", F.col("holdout") & F.col("quality").isNotNull())
        good = marked.where("tested AND quality = 1")
        self.counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
        #: Good texts of the strata with enough of them: at most one stratum for so many labels.
        found = [(r["stratum"], r["n"]) for r in self.counts.where(F.col("n") >= least_evidence(alpha, delta)).collect()]
        level = levels(found, alpha, delta)
        self.good = [(stratum, n) for stratum, n in found if stratum in level]
        enough = spark.createDataFrame([(s,) for s, _ in self.good], "stratum string")
        pairs = F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("rate")) for name in RULES)))
        pool = marked.where("NOT tested OR quality = 0").join(enough.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")), "left_semi")
        bins: dict = {}
        for stratum, bad, rule, rate, n in pool.select("stratum", F.col("tested").alias("bad"), pairs).groupBy("stratum", "bad", "rule", "rate").count().collect():
            bins.setdefault((stratum, bad, rule), {})[rate] = n
        paths = {stratum: path(*([bins.get((stratum, bad, rule), {}) for rule in RULES] for bad in (True, False))) for stratum, _ in self.good}
        steps = [(stratum, *(first_steps(own, k) for k in range(len(RULES)))) for stratum, own in paths.items()]
        self.steps = spark.createDataFrame(steps, "_s string, " + ", ".join(f"_{name} array<int>" for name in RULES))
        lost: dict = {}
        for stratum, step, n in self.with_step(good).where("_step IS NOT NULL").groupBy("stratum", "_step").count().collect():
            lost.setdefault(stratum, {})[step] = n
        self.chosen = [(stratum, strictest(lost.get(stratum, {}), len(paths[stratum]), n, alpha, level[stratum])) for stratum, n in self.good]

    def with_step(self, rows: DataFrame) -> DataFrame:
        """Add ``_step``, the first step that rejects a row; null without rules."""
        joined = rows.join(self.steps, F.col("stratum").eqNullSafe(F.col("_s")), "left")
        first = F.least(*(F.get(F.col(f"_{name}"), F.col(name)) for name in RULES))
        return joined.withColumn("_step", first).drop("_s", *(f"_{name}" for name in RULES))


def evidence(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Each language with labelled good texts: how many, whether they suffice, and
    the step taken (0: no rules)."""
    found = Calibration(docs, labels, alpha, delta)
    chosen = docs.sparkSession.createDataFrame(found.chosen, "_s string, _chosen int")
    joined = found.counts.join(chosen, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    return joined.select(F.col("stratum").alias("lang"), F.col("n").alias("n_good"), F.col("_chosen").isNotNull().alias("enough"), F.coalesce("_chosen", F.lit(0)).alias("step"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Statistics and verdict of each document."""
    found = Calibration(docs, labels, alpha, delta)
    chosen = docs.sparkSession.createDataFrame(found.chosen, "_c string, _chosen int")
    rows = found.with_step(found.statistics).join(chosen, F.col("stratum").eqNullSafe(F.col("_c")), "left")
    refused = F.coalesce(F.col("_step") <= F.col("_chosen"), F.lit(False))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(*columns, (~F.col("base_failed") & ~refused).alias("kept"))
