"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Fitting: presence of hashed character n-grams in labelled texts, scaled by the log ratio of smoothed counts
between toxic and other texts, then logistic regression on the scaled features. Counts and the sample come from
one pass over the labelled rows; scoring is one pass over all texts without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm import common

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass(frozen=True)
class Grams:
    """Hashed character n-grams of lower-case text, each n-gram once a text."""

    sizes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 18

    def slots(self) -> np.ndarray:
        """Scratch space for of()."""
        return np.zeros(1 << self.bits, dtype=np.int32)

    def of(self, text: str | None, scratch: np.ndarray) -> np.ndarray:
        """The distinct feature numbers of a text; white space counts as one blank, a blank stands at each end."""
        chars = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        h = np.zeros(len(chars), dtype=np.uint32)
        parts = []
        for n in range(1, max(self.sizes) + 1):
            if len(chars) < n:
                break
            h = (h[: len(chars) - n + 1] ^ chars[n - 1 :]) * _MIX[0]
            h ^= h >> np.uint32(15)
            if n in self.sizes:
                parts.append((h * _MIX[1]) >> np.uint32(32 - self.bits))
        if not parts:
            return np.zeros(0, dtype=np.int64)
        found = np.concatenate(parts).astype(np.int64)
        at = np.arange(len(found), dtype=np.int32)
        scratch[found] = at  # of equal features the last one writes; only that one stays
        return found[scratch[found] == at]


@dataclass(frozen=True)
class Model:
    """weights: of each feature, times its log-count ratio; bias."""

    grams: Grams
    weights: np.ndarray
    bias: float

    def margin(self, text: str | None, scratch: np.ndarray) -> float:
        return float(self.weights[self.grams.of(text, scratch)].sum(dtype=np.float64) + self.bias)


def fit(texts: list[str | None], labels: list[int], grams: Grams | None = None, alpha: float = 0.5, l2: float = 2.0, rounds: int = 200, kept: int = 3_000) -> Model:
    """Fit on texts and 0/1 labels. With labels of one class only, the score is that class for every text.

    The regression sees the kept features whose log-count ratio is largest against its standard error; all others
    have weight 0. Texts are read twice, so memory holds two counters and the kept features only.
    """
    grams = grams or Grams()
    size = 1 << grams.bits
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(grams, np.zeros(size, dtype=np.float32), 20.0 if len(y) and y[0] else -20.0)
    scratch = grams.slots()
    counts = np.zeros((2, size))
    for text, label in zip(texts, labels, strict=True):
        counts[label, grams.of(text, scratch)] += 1
    neg, pos = counts
    ratio = np.log((pos + alpha) / (y.sum() + 2 * alpha)) - np.log((neg + alpha) / (len(y) - y.sum() + 2 * alpha))
    z = np.abs(ratio) / np.sqrt(1 / (pos + alpha) + 1 / (neg + alpha))
    z[pos + neg < 2] = 0.0  # seen in one text: nothing to generalise
    best = np.argsort(-z, kind="stable")[:kept]
    number = np.full(size, -1, dtype=np.int64)
    number[best] = np.arange(len(best))
    rows = [f[f >= 0] for f in (number[grams.of(t, scratch)] for t in texts)]
    cols = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    r = ratio[best]
    x = r[cols]
    scale = 1.0 / np.sqrt(max(1e-9, np.mean(np.bincount(row, weights=x * x, minlength=len(rows)))))
    x = x * scale
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, bias = np.zeros(len(best)), 0.0
    m_w, v_w, m_b, v_b = np.zeros(len(best)), np.zeros(len(best)), 0.0, 0.0
    for k in range(1, rounds + 1):  # Adam on the whole sample
        margin = np.bincount(row, weights=x * w[cols], minlength=len(rows)) + bias
        gap = balance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        g = np.bincount(cols, weights=x * gap[row], minlength=len(best)) + l2 * 1e-4 * w
        gb = gap.sum()
        m_w, v_w, m_b, v_b = 0.9 * m_w + 0.1 * g, 0.99 * v_w + 0.01 * g * g, 0.9 * m_b + 0.1 * gb, 0.99 * v_b + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**k, 1 - 0.99**k
        w -= 0.05 * (m_w / c1) / (np.sqrt(v_w / c2) + 1e-8)
        bias -= 0.05 * (m_b / c1) / (np.sqrt(v_b / c2) + 1e-8)
    weights = np.zeros(size, dtype=np.float32)
    weights[best] = w * r * scale
    return Model(grams, weights, float(bias))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int = 6_000) -> DataFrame:
    """Distinct rows text, label of about most_rows labelled documents, chosen by hashes, alike in every run.

    labels: doc_id, label (0 or 1; other rows are left out). Labels are thinned by a hash of doc_id until about most_rows
    are left, so they are broadcast and the documents' texts are not shuffled; where documents repeat ids, the texts
    that these give are thinned in the same way. Texts drawn are learned from whole.
    """
    own = labels.where("label in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.col("label").cast("int").alias("label")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(F.broadcast(_thinned(own, most_rows, "label_id")), F.col("doc_id") == F.col("label_id"))
    return _thinned(met.select("text", "label").distinct(), most_rows, "text")


def _thinned(rows: DataFrame, most: int, by: str) -> DataFrame:
    """About most of the rows, chosen by a hash of a column."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(by), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


def fit_on(docs: DataFrame, labels: DataFrame, grams: Grams | None = None, most_rows: int = 6_000) -> Model:
    """Fit on a bounded sample (about most_rows whole texts) of documents (doc_id, text) with labels (doc_id, label)."""
    rows = sorted((r["text"], r["label"]) for r in labelled_sample(docs, labels, most_rows).collect())
    return fit([t for t, _ in rows], [y for _, y in rows], grams)


def annotate(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1; higher: toxic likelier) and predicted (1 if score >= 0.5), or by other names, from each whole text alone.

    A null text counts as empty. Input columns of these two names are replaced. A very long text is scored whole; memory
    follows the longest one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        scratch = own.grams.slots()

        def run(texts: list[str | None]) -> list[pa.Array]:
            z = np.array([own.margin(t, scratch) for t in texts], dtype=np.float64)
            p = np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 9)
            return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]

        return run

    return common.annotate(docs, make, [(names[0], "double"), (names[1], "int")])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every document (doc_id, text), as annotate() gives them.

    Repeated rows keep a result each; other columns are ignored; an empty table gives no rows.
    """
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns unchanged, that are not predicted toxic."""
    score, predicted = common.free_names(docs, "score", "predicted")
    return annotate(docs, model, (score, predicted)).where(F.col(predicted) == 0).select(*docs.columns)
