"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are the words of a text and their prefixes of 4 to 7 letters, in lower case, hashed. Counts over
all labelled rows pick the features that go most with the label. Labels say only whether a text is toxic,
so grades come from the labelled texts themselves: 0 where the label is 0, else 1, 2 or 3 by thirds of how
many words in a hundred carry a picked feature. The model has one weight for each feature, shared by all
grades, and an ordered threshold for each: P(grade >= k) = logistic(w x - t_k). The expected severity is
the sum of these.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm import common
from kgraph.llm.quality_classifier import held_out

MOST_LABELS = 20_000
MOST_BROADCAST = 200_000
MOST_FEATURES = 4096
BUCKETS = 1 << 22
GRADES = 3
PREFIXES = (4, 5, 6, 7)
VOCABULARY = 500_000
LETTERS = re.compile(r"[^\W\d_]+")


def token_features(token: str) -> list[int]:
    """Hashed features of one token between spaces."""
    out = []
    for word in LETTERS.findall(token.lower()):
        out.append(zlib.crc32(b"w:" + word.encode("utf-8", "surrogatepass")) % BUCKETS)
        out += [zlib.crc32(b"p:" + word[:k].encode("utf-8", "surrogatepass")) % BUCKETS for k in PREFIXES if len(word) >= k]
    return out


class Known(dict):
    """Picked features of a token, remembered; forgets all when too many are held."""

    def __init__(self, picked: dict[int, int] | None) -> None:
        self.picked = picked

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= VOCABULARY:
            self.clear()
        found = token_features(token)
        value = self[token] = tuple(found) if self.picked is None else tuple(self.picked[f] for f in found if f in self.picked)
        return value


@dataclass(frozen=True)
class Ordinal:
    picked: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, 3, by row; falls with k since thresholds rise."""
        return 1 / (1 + np.exp(-(np.asarray(z)[:, None] - self.thresholds)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_features: int, l2: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean loss. rows: the features of each text."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    base = np.array([np.log(((grades < k).sum() + 1) / ((grades >= k).sum() + 1)) for k in range(1, GRADES + 1)])
    p = np.concatenate((np.zeros(n_features), base[:1], np.log(np.maximum(np.diff(base), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        t = p[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))
        z = np.bincount(at, w[col], minlength=len(rows))
        up = 1 / (1 + np.exp(-(z[:, None] - t)))
        full = np.concatenate((np.ones((len(z), 1)), up, np.zeros((len(z), 1))), 1)
        slope = full * (1 - full)
        i = np.arange(len(z))
        share = np.maximum(full[i, grades] - full[i, grades + 1], 1e-9)
        g_t = np.zeros((len(z), GRADES + 2))
        g_t[i, grades] += slope[i, grades] / share
        g_t[i, grades + 1] -= slope[i, grades + 1] / share
        g_z = -(g_t.sum(1)) / len(z)
        by_t = g_t[:, 1:-1].sum(0) / len(z)
        tail = np.cumsum(by_t[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, g_z[at], minlength=n_features) + l2 * w, tail[:1], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(p[n_features + 1 :]))))


def pick(labelled: DataFrame, n_bad: int, n_good: int, most: int = MOST_FEATURES) -> dict[int, int]:
    """The features that go most with label 1, by a likelihood ratio over how many labelled texts have
    them. Counts are summed in each task before they are shuffled."""

    def count(batches):
        bad, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        known = Known(None)
        for batch in common.slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = {f for token in set((text or "").split()) for f in known[token]}
                (bad if label else good)[np.fromiter(found, np.int64, len(found))] += 1
        has = np.flatnonzero(bad)  # a feature of no toxic text can't be picked; its other count isn't needed
        also = np.flatnonzero((good > 0) & (bad == 0))
        for part in np.array_split(np.concatenate((has, also)), max(1, (len(has) + len(also)) // 50_000)):
            yield pa.RecordBatch.from_pydict({"f": part, "bad": bad[part], "good": good[part]})

    sums = labelled.mapInArrow(count, "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("a"), F.sum("good").alias("b")).filter("a >= 3")
    p, q = (F.col("a") + 0.5) / (n_bad + 1.0), (F.col("b") + 0.5) / (n_good + 1.0)
    gain = F.col("a") * F.log(p / q)
    top = sums.filter(p > 3 * q).select("f", gain.alias("gain")).orderBy(F.desc("gain"), "f").limit(most)
    return {r["f"]: i for i, r in enumerate(top.collect())}


def with_labels(docs: DataFrame, labels: DataFrame, n: int, id_col: str, text_col: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(_id, text, label) of the rows of docs that labels (_label_id, label; each id once, n rows) names. Texts
    aren't shuffled: up to ``most_broadcast`` labels, 20 bytes each, are broadcast; of more, ids alone are
    joined, and the rows look their labels up in side files."""
    columns = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    same = F.col("_id") == F.col("_label_id")
    if n <= most_broadcast:
        return docs.select(*columns).join(F.broadcast(labels), same).select("_id", "text", "label")
    docs = common.as_scan(docs)
    found = common.scan_rows(docs, columns[:1]).join(labels, same).select("file", "row", "label")
    return common.attach(docs, found, {"label": T.IntegerType()}, "labels", columns).filter("label is not null")


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """A model from labelled rows: feature counts over all of them, weights from about ``most_labels`` at
    most, taken by a hash of the id, of which only picked features reach the driver. The label of an id with
    several is their majority, ties to toxic; null labels and ids are left out. Features of equal gain are
    picked by number. Repeated rows of a labelled id all count."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    one = common.save(one, "toxic-labels")
    n = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labelled = with_labels(docs, one, sum(n.values()), id_col, text_col)
    if not n.get(1):
        return Ordinal({}, np.zeros(0), np.array([8.0, 9.0, 10.0]))
    picked = pick(labelled, n.get(1, 0), n.get(0, 0))

    def extract(batches):
        known = Known(picked)
        for batch in common.slices(batches):
            out = []
            for i, text, label in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = (text or "").split()
                out.append((i, label, len(tokens), sum(bool(known[t]) for t in tokens), sorted({f for t in set(tokens) for f in known[t]})))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["id", "label", "n", "hits", "features"])

    share = int((1 << 30) * min(1.0, most_labels / max(1, sum(n.values()))))
    some = labelled.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) <= share)
    rows = some.mapInArrow(extract, "id long, label int, n long, hits long, features array<int>").orderBy("id", "n", "hits").collect()
    if not rows:
        return Ordinal({}, np.zeros(0), np.array([8.0, 9.0, 10.0]))
    density = np.array([r["hits"] / max(1, r["n"]) for r in rows])
    label = np.array([r["label"] for r in rows], np.int64)
    grades = label.copy()
    if label.any():
        grades[label == 1] = 1 + np.searchsorted(np.quantile(density[label == 1], (1 / 3, 2 / 3)), density[label == 1], side="right")
    weights, thresholds = fit([np.array(r["features"], np.int64) for r in rows], grades, len(picked))
    return Ordinal(picked, weights, thresholds)


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Grade every whole text.

    Returns id_col, severity (expected grade, 0 to 3), grade (the largest k with P(grade >= k) of one half
    or more) and toxic (1 if grade is 1 or more). Null and empty texts have no features. Repeated rows get
    equal grades; other columns are left out. One scan, no shuffle.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        known = Known(model.picked)
        for batch in common.slices(batches):
            z = np.array([sum(model.weights[f] for f in {f for t in set((text or "").split()) for f in known[t]}) for text in batch.column("t").to_pylist()], np.float64)
            up = model.at_least(z)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(up.sum(1)), pa.array((up >= 0.5).sum(1).astype(np.int32))], names=["i", "severity", "grade"])

    schema = T.StructType([T.StructField("i", kind), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType())])
    out = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, schema)
    return out.select(F.col("i").alias(id_col), "severity", "grade", (F.col("grade") >= 1).cast("int").alias("toxic"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labelled rows that aren't held out (see ``held_out``) and grade all rows. Without
    toxic labels nothing is called toxic."""
    model = learn(docs, labels.filter(~held_out(F.col("doc_id"))), id_col=id_col, text_col=text_col)
    return grade(docs, model, id_col, text_col).withColumn("held_out", held_out(F.col(id_col)))
