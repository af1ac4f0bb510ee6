"""Learned decision lists for document quality.

Counts of each text become a few ratios; from labelled documents, sequential covering grows
conjunctions of thresholds (by information gain on two thirds of the sample), prunes them (by
precision on the rest) and keeps those that still hold. The list is emitted as one ordered Spark
conditional expression: the first rule that holds gives the verdict, none means keep.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, map_rows, saved, table

#: Labelled rows that a list is learned from at most, the first by a hash of their id.
MOST_LABELS = 20_000
#: A rule must be right on this share of the pruning rows it covers, and cover so many.
LEAST_PRECISION, LEAST_COVER = 0.97, 8

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_upper long, n_marks long, n_digits long"
SYMBOLS, UPPER, MARKS, DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"!?", b"0123456789"
SPACE = " \t\n\v\f\r"


def counts(text: str) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for a text."""
    raw = text.encode()
    words = raw.split()  # at ASCII white space only, as bytes
    n = len(words)
    wins = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(wins)) < len(wins):
        found, reach = Counter(wins), 0
        for k, w in enumerate(wins):
            if found[w] > 1:
                repeated += k + 3 - max(k, reach)
                reach = k + 3
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    word_chars = len(text) - sum(map(text.count, SPACE)) if n else 0
    return n, word_chars, without(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), without(UPPER), without(MARKS), without(DIGITS)


def statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with the counts of each whole text; a null text has none of anything. A column of ``keep`` named like a
    count gives way to it."""

    def make():
        def work(batch):
            rows = [counts(t.as_py() or "") for t in batch.column(0)]
            return [*batch.columns[1:], *map(list, zip(*rows))]

        return work

    rows, schema = beside(df, text, keep, COUNTS)
    return map_rows(rows, make, schema)


def features() -> dict[str, Column]:
    """What rules may test, from the counts."""
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "marks_per_word": per("n_marks", "n_words"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "distinct_share": per("n_distinct", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "mean_word": per("word_chars", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, operator, threshold) holds."""

    tests: tuple[tuple[str, str, float], ...]

    def __str__(self):
        return " and ".join(f"{f} {op} {x:.6g}" for f, op, x in self.tests)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for f, op, at in self.tests:
            out &= x[f] >= at if op == ">=" else x[f] <= at
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, at in self.tests:
            out = out & (features()[f] >= F.lit(at) if op == ">=" else features()[f] <= F.lit(at))
        return out


def gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int = 4) -> Rule:
    tests: list[tuple[str, str, float]] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(tests) < most_tests and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, chosen = 1e-9, None
        for f, v in x.items():
            own = np.unique(v[inside])
            edges = (own[1:] + own[:-1]) / 2 if len(own) < 64 else np.unique(np.quantile(v[inside], np.linspace(0.01, 0.99, 64)))
            for op in (">=", "<="):
                for at in edges:
                    hit = inside & (v >= at if op == ">=" else v <= at)
                    if (g := gain(int((hit & bad).sum()), int((hit & ~bad).sum()), p0, n0)) > best:
                        best, chosen = g, (f, op, float(at))
        if chosen is None:
            break
        tests.append(chosen)
        inside &= Rule((chosen,)).holds(x)
    return Rule(tuple(tests))


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest prefix of the tests with the best (right - wrong) / covered on rows not grown on."""

    def worth(r: Rule) -> float:
        hit = r.holds(x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)), key=lambda r: (worth(r), -len(r.tests)), default=rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, seed: int = 3) -> list[Rule]:
    """An ordered list of reject rules; none if there are no rejected rows to learn from."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most_rules and int((left & bad).sum()) >= LEAST_COVER:
        part = rng.random(len(bad)) < 2 / 3
        for_growth, for_pruning = left & part, left & ~part
        if not (for_growth & bad).any():
            break
        rule = grow({f: v[for_growth] for f, v in x.items()}, bad[for_growth])
        if not rule.tests:
            break
        rule = prune(rule, {f: v[for_pruning] for f, v in x.items()}, bad[for_pruning])
        hit, hit_pruning = rule.holds(x) & left, rule.holds(x) & for_pruning
        if hit.sum() < LEAST_COVER or (bad & hit).sum() < LEAST_PRECISION * hit.sum() or (bad & hit_pruning).sum() < LEAST_PRECISION * hit_pruning.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where a row is kept: the ordered conditional expression of the list."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", most: int = MOST_LABELS) -> list[Rule]:
    """Rules from the rows of ``stats`` that ``labels`` (doc_id, quality 0/1) covers, ``most`` at most. Labels of an id that
    contradict each other are not used."""
    named = features()
    known = labels.filter(F.col("quality").isNotNull()).groupBy(doc_id).agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.filter("quality = most").select(doc_id, "quality")
    sample = stats.join(known, doc_id).select(doc_id, "quality", *[c.alias(f"f_{f}") for f, c in named.items()])
    rows = sample.orderBy(F.xxhash64(doc_id), doc_id).limit(most).toPandas()
    if not len(rows):
        return []
    return learn({f: rows[f"f_{f}"].to_numpy() for f in named}, (rows["quality"] == 0).to_numpy())


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns, whatever their names."""
    own = df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(df.columns)])
    judged_ = judged(statistics(own, own.columns, f"_c{df.columns.index(text)}"), rules)
    return judged_.filter("kept").select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(df.columns)])


def op6_quality_rules(spark, sf_dir):
    """The verdict on every document, by rules learned from the labels.

    A null or empty text has no words and fails the base test. Repeated rows are judged alike; without
    labels the list is empty and only the base test rejects; an empty table gives an empty one.
    """
    stats = saved(statistics(table(spark, sf_dir, "documents"), ["doc_id"]), "quality")
    rules = fit(stats, table(spark, sf_dir, "labels"))
    return judged(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
