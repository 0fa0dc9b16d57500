"""A sparse ensemble of rules for quality.

Small trees are grown on resampled halves of a labelled sample; every path from a root is a conjunctive
rule over statistics. A logistic model with an absolute-value penalty on the rules' weights leaves a few
of them, and these compile to one Spark expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph.llm import text_stats
from kgraph.llm.quality_rules import Condition, Rule, covers, thresholds

MOST_LABELS = 20_000
TREES, DEPTH, LEAF = 60, 3, 10
PENALTIES = (0.03, 0.01, 0.003, 0.001)
CUTOFF = 0.3


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights):
            z += w * covers(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        columns = text_stats.features()
        names = list(columns)
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            cond = rule[0].column(names, columns)
            for c in rule[1:]:
                cond = cond & c.column(names, columns)
            z = z + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def tree_rules(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], features: np.ndarray, depth: int = DEPTH, path: Rule = ()) -> list[Rule]:
    """Paths of a least-squares tree, one for each node below the root."""
    n, total = len(x), residual.sum()
    if depth == 0 or n < 2 * LEAF:
        return []
    best, found = 1e-9, None
    for j in features:
        cut = cuts[j]
        where = np.searchsorted(cut, x[:, j], side="left")
        count = np.bincount(where, minlength=len(cut) + 1).cumsum()[:-1]
        part = np.bincount(where, residual, minlength=len(cut) + 1).cumsum()[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((count >= LEAF) & (n - count >= LEAF), part**2 / count + (total - part) ** 2 / (n - count) - total**2 / n, -np.inf)
        if len(gain) and gain.max() > best:
            best, found = float(gain.max()), (int(j), float(cut[gain.argmax()]))
    if found is None:
        return []
    j, t = found
    low = x[:, j] <= t
    out: list[Rule] = []
    for above, inside in ((False, low), (True, ~low)):
        here = (*path, Condition(j, above, t))
        out += [here, *tree_rules(x[inside], residual[inside], cuts, features, depth - 1, here)]
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights under an absolute-value penalty, by accelerated proximal gradients; the bias is free."""
    n, k = r.shape
    w, b = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, vb, t = w.copy(), b, 1.0
    rate = 4.0 / (1 + np.linalg.norm(r, 2) ** 2 / n)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(r @ v + vb))) - y
        nw = v - rate * (r.T @ error) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ensemble:
    """Rules and weights from statistics and 0/1 labels. The penalty is the one that does best on a fifth
    of the rows kept aside. With labels of one class only, or none, the score is constant."""
    if len(x) < 4 * LEAF or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble((), (), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts, found = thresholds(x, 32), {}
    for _ in range(TREES):
        rows = rng.choice(len(x), max(2 * LEAF, len(x) // 2), replace=False)
        some = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        for rule in tree_rules(x[rows], y[rows] - y[rows].mean(), cuts, np.sort(some), int(rng.integers(1, DEPTH + 1))):
            c = covers(rule, x)
            if LEAF <= c.sum() <= len(x) - LEAF:
                found.setdefault(np.packbits(c).tobytes(), (rule, c))
    rules = [r for r, _ in found.values()]
    r = np.stack([c for _, c in found.values()], 1).astype(np.float64)
    aside = rng.permutation(len(x)) < len(x) // 5
    best = (np.inf, PENALTIES[0])
    for penalty in PENALTIES:
        w, b = lasso(r[~aside], y[~aside], penalty)
        z = r[aside] @ w + b
        best = min(best, (float(np.mean(np.logaddexp(0, z) - y[aside] * z)), penalty))
    w, b = lasso(r, y, best[1])
    order = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(tuple(rules[i] for i in order), tuple(float(w[i]) for i in order), b)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by ``folds``. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labels: int = MOST_LABELS, cutoff: float = CUTOFF) -> DataFrame:
    """Score every row for quality.

    Returns id_col, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from ``cutoff``
    on). Learned from at most about ``most_labels`` labelled rows that aren't held out, taken by a hash of
    the id; only statistics of the text are inputs. Null and empty texts have statistics of 0 and are
    scored like others. Without labels every score is one half.
    """
    from kgraph.llm import common

    stats = common.save(text_stats.with_stats(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", ("_id",)), "stats")
    x, y = text_stats.labelled(stats.filter(~held_out(F.col("_id"))), labels, "quality", most_labels, "_id")
    value = fit(x, y).column()
    scored = stats.select(F.col("_id"), value.alias("score"))
    return scored.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
