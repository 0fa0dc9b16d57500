"""Learned decision lists for quality, by sequential covering.

Rules for the class to reject are grown on two thirds of a labelled sample, one threshold condition at a
time by information gain, and pruned on the other third. What a rule covers is set aside and the next
rule is grown, until no rule is precise enough. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph.llm import text_stats

MOST_LABELS = 20_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, names: list[str], columns: dict[str, Column]) -> Column:
        v = columns[names[self.feature]]
        return v > self.threshold if self.above else v <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def thresholds(x: np.ndarray, most: int = 48) -> list[np.ndarray]:
    """Candidate cuts of each feature: midpoints between neighbouring quantiles."""
    out = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most + 1))) if len(x) else np.zeros(0)
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int = 4) -> Rule:
    """Add the condition of the largest gain in information about ``bad`` until the rule covers nothing else."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p == 0 or n == 0:
            break
        before, best, found = np.log2(p / (p + n)), 1e-9, None
        for j, cut in enumerate(cuts):
            where = np.searchsorted(cut, x[inside, j], side="left")
            pos = np.bincount(where[bad[inside]], minlength=len(cut) + 1).cumsum()[:-1]
            neg = np.bincount(where[~bad[inside]], minlength=len(cut) + 1).cumsum()[:-1]
            for above, (a, b) in ((False, (pos, neg)), (True, (p - pos, n - neg))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(a > 0, a * (np.log2(a / (a + b)) - before), -np.inf)
                if len(gain) and gain.max() > best:
                    best, k = float(gain.max()), int(gain.argmax())
                    found = Condition(j, above, float(cut[k]))
        if found is None:
            break
        rule.append(found)
        inside &= found.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Cut conditions from the end while the worth of the rule on rows it wasn't grown on doesn't fall."""

    def worth(r: Rule) -> float:
        c = covers(r, x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 16, precision: float = 0.8, support: int = 5) -> list[Rule]:
    """An ordered list of rules for ``bad``; rows that no rule covers are kept. No labels, no rules."""
    rng = np.random.default_rng(11)
    held = np.zeros(len(x), bool)
    held[rng.permutation(len(x))[: len(x) // 3]] = True
    left, rules, cuts = np.ones(len(x), bool), [], thresholds(x)
    while len(rules) < most_rules and (left & bad & ~held).sum() >= support:
        g, v = left & ~held, left & held
        rule = prune(grow(x[g], bad[g], cuts), x[v], bad[v])
        c = covers(rule, x) if rule else np.zeros(len(x), bool)
        p, q = int((c & v & bad).sum()), int((c & v).sum())
        if not rule or (c & left & bad).sum() < support or (p + 1) / (q + 2) < precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over ``stats``: the first rule that holds rejects."""
    columns = text_stats.features()
    names = list(columns)
    out = F
    for rule in rules:
        cond = rule[0].column(names, columns)
        for c in rule[1:]:
            cond = cond & c.column(names, columns)
        out = out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def base_failed() -> Column:
    n, r = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def learn_from(stats: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, id_col: str = "doc_id") -> list[Rule]:
    """Rules from at most about ``most_labels`` labelled rows, taken by a hash of the id."""
    x, y = text_stats.labelled(stats, labels, "quality", most_labels, id_col)
    return learn(x, y == 0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, most_labels: int = MOST_LABELS) -> DataFrame:
    """Judge every row by its statistics.

    Returns the columns named by ``keep`` (all, if None), stats, base_failed and kept. A row fails the
    base rule with fewer than 10 words or over 20 % of its words in repeated 5-word windows; null and
    empty texts fail it. Columns of docs that are named like the new ones are left out. Other rows are kept unless a rule of the learned list rejects them; with no
    labels the list is empty. Labels of ids that docs lack, null labels and repeated labels do no harm.
    The statistics are taken once, written to the shared folder, and learned from and judged there.
    """
    from kgraph.llm import common

    made = ("stats", "base_failed", "kept")
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in made)
    stats = common.save(text_stats.with_stats(docs, text_col, tuple(dict.fromkeys((*keep, id_col)))), "stats")
    rules = learn_from(stats, labels, most_labels, id_col)
    return stats.select(*(F.col(f"`{c}`") for c in keep), "stats", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that ``judge`` rejects, with all their columns. The statistics are taken twice,
    once to learn from and once beside the texts, so that no text is shuffled or written but the result."""
    from kgraph.llm import common

    stats = common.save(text_stats.with_stats(docs, text_col, (id_col,)), "stats")
    rules = learn_from(stats, labels, id_col=id_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    judged = text_stats.with_stats(docs.toDF(*names), names[docs.columns.index(text_col)])
    return judged.filter(~base_failed() & verdict(rules)).select(*names).toDF(*docs.columns)
