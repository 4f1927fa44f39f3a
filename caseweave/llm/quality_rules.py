"""Decision lists learned by sequential covering from labelled text statistics.

A list is a few ordered rules, each a conjunction of thresholds; a document that meets one is
rejected, all others are kept.  Rules are grown on two thirds of the labelled rows, one threshold at
a time by information gain, and cut back on the other third.  Only histograms (features x cut
points) reach the driver, and the result is one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import fold, labelled
from caseweave.llm.statistics import COUNTS, with_statistics
from caseweave.session import materialise


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def features() -> dict[str, Column]:
    """What rules may ask about; each is 0 where its denominator is 0."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "n_words"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "upper": _share("n_upper", "word_chars"),
        "digits": _share("n_digits", "word_chars"),
        "exclaims": _share("n_exclaim", "n_words"),
        "stops": _share("n_stops", "n_words"),
        "distinct": _share("n_distinct_words", "n_words"),
        "bars": _share("n_bars", "n_words"),
        "short": _share("n_short_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def met(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule met, null if none is."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(met(rule), F.lit(k)).otherwise(out)
    return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    if not p:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_rules(
    rows: DataFrame, bad: str = "bad", pruning: str = "pruning", cuts: int = 32, max_rules: int = 10,
    max_conditions: int = 4, min_cover: int = 10, min_precision: float = 0.95,
) -> list[Rule]:
    """Rules for rows with the columns of COUNTS, a 0/1 ``bad`` and a boolean ``pruning``.

    Cut points are quantiles of each class.  A rule grows by the condition with the highest gain until
    it covers no good row or has ``max_conditions``; then its last conditions go as long as that
    doesn't hurt on the pruning rows.  Learning ends when a rule covers fewer than ``min_cover`` bad
    rows, or is right on less than ``min_precision`` of either part.  No rows, or rows of one class,
    give an empty list.
    """
    named = features()
    names = list(named)
    wide = rows.select(F.col(bad).alias("_bad"), F.col(pruning).alias("_pruning"), *COUNTS, *[
        c.alias(f"_f_{n}") for n, c in named.items()
    ])
    classes = {r["_bad"] for r in wide.groupBy("_bad").count().collect()}
    if classes != {0, 1}:
        return []
    points: dict[str, list[float]] = {n: [] for n in names}
    levels = [k / cuts for k in range(cuts + 1)]
    for side in (0, 1):
        found = wide.where(F.col("_bad") == side).approxQuantile([f"_f_{n}" for n in names], levels, 0.002)
        for name, values in zip(names, found, strict=True):
            points[name] += values
    edges = {n: sorted(set(v)) for n, v in points.items()}
    # The place of a value among the cut points: how many lie below it.  "At most edge b" is then
    # "place <= b", so that learning needs the places only.
    places = [sum(((F.col(f"_f_{n}") > e).cast("int") for e in edges[n]), F.lit(0)) for n in names]
    binned = materialise(wide.select(
        F.col("_bad").cast("int").alias("_bad"), "_pruning", F.array(*places).alias("_places")
    ))

    def placed(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            place, edge = F.get("_places", names.index(c.feature)), edges[c.feature].index(c.cut)
            out = out & ((place > edge) if c.above else (place <= edge))
        return out

    def histogram(condition: Column) -> dict[str, dict[int, tuple[int, int]]]:
        found = (
            binned.where(~F.col("_pruning") & condition).select("_bad", F.posexplode("_places").alias("f", "b"))
            .groupBy("f", "b").agg(F.sum("_bad").alias("p"), F.count(F.lit(1)).alias("n")).collect()
        )
        out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
        for r in found:
            out[names[r["f"]]][r["b"]] = (int(r["p"]), int(r["n"]) - int(r["p"]))
        return out

    rules: list[Rule] = []
    free = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            bins = histogram(free & placed(rule))
            p0, n0 = (sum(v[k] for v in bins[names[0]].values()) for k in (0, 1))
            if not p0 or not n0:
                break
            best: tuple[float, Condition | None] = (0.0, None)
            for name in names:
                p = n = 0
                for b, edge in enumerate(edges[name]):
                    x, y = bins[name].get(b, (0, 0))
                    p, n = p + x, n + y
                    for above, covered, wrong in ((False, p, n), (True, p0 - p, n0 - n)):
                        gain = _gain(p0, n0, covered, wrong)
                        if covered >= min_cover and gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, edge))
            if best[1] is None:
                break
            rule = (*rule, best[1])
        if not rule:
            break
        # What the rule covers on either part, cut after each of its conditions.
        hit = [(k, part) for k in range(1, len(rule) + 1) for part in (False, True)]
        row = binned.where(free).agg(*[
            F.coalesce(F.sum(F.when((F.col("_pruning") == part) & placed(rule[:k]), side)), F.lit(0)).alias(f"{x}{k}{part}")
            for k, part in hit for x, side in (("p", F.col("_bad")), ("n", 1 - F.col("_bad")))
        ]).first()
        rate = lambda k: (
            (row[f"p{k}True"] - row[f"n{k}True"]) / max(1, row[f"p{k}True"] + row[f"n{k}True"])
        )
        length = max(range(1, len(rule) + 1), key=lambda k: (rate(k), -k))
        rule = rule[:length]
        if any(
            row[f"p{length}{part}"] < max(least, min_precision * (row[f"p{length}{part}"] + row[f"n{length}{part}"]))
            for part, least in ((False, min_cover), (True, 1))
        ):
            break
        rules.append(rule)
        free = free & ~placed(rule)
    return rules


def judge_quality(
    docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, **learning,
) -> DataFrame:
    """Per document: id, base counts, ``base_failed``, ``rule`` (number of the rule met) and ``kept``.

    A null text counts as empty, which fails the base rule.  Equal texts get equal verdicts whatever
    their number.  Without usable labels only the base rule decides.
    """
    stats = materialise(with_statistics(
        docs.select("doc_id", "text").withColumn("_pruning", fold("doc_id", 3) == 0)
    ).drop("text"))
    failed = (F.col("n_words") < min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")
    )
    known = labelled(stats.where(~failed), labels, "quality")
    rules = learn_rules(known.withColumn("bad", 1 - F.col("_label")), "bad", "_pruning", **learning)
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"),
    )
