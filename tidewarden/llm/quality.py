"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Trees are grown level by level on binned statistics of a bounded sample and kept as complete binary trees in flat
arrays (feature, threshold, leaf value), so that numpy walks all trees of many documents at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.common import one_of_each, sample_per_class, text_of

SAMPLE_PER_LABEL = 1000     # labelled rows learned from, of each label
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
LEAST_WEIGHT = 2.0          # of the hessian in a leaf
RIDGE = 1.0
CUT = 0.3                   # a score from here on is label 1

_KIND = np.zeros(256, np.int64)    # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 . or ,, 6 other marks, 7 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (7 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else
                 4 if _c.isspace() else 5 if _c in ".," else 6 if _b > 32 else 0)

STATISTICS = ("log_bytes", "lower", "upper", "digit", "blank", "stop", "mark", "wide", "entropy", "newline",
              "log_words", "word_length", "longest_word", "distinct_words", "top_word", "same_as_before", "same_as_second",
              "marked_words", "upper_words", "single_chars", "log_lines", "distinct_lines", "line_length",
              "upper_line_share", "mark_line_share", "worst_line_repeat")


def statistics(text: str) -> list[float]:
    """``STATISTICS`` of a whole text; all finite, also for the empty one."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8) / n
    p = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    tally = Counter(words)
    lines = [line for line in text.split("\n") if line]
    k = max(1, len(lines))
    upper = marks = repeat = 0.0
    for line in lines:
        size = len(line)
        if size > 20:
            own = line.split()
            upper += size * line.isupper()
            marks += size * (sum(map(line.count, "#*$%&|!=~")) * 12 > size)
            if len(own) > 5:
                repeat = max(repeat, 1 - len(set(own)) / len(own))
    return [np.log1p(len(raw)), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
            float(-(p * np.log2(p)).sum()), counts[10] / n,
            np.log1p(len(words)), len(text) / w, np.log1p(max(map(len, tally), default=0)), len(tally) / w,
            max(tally.values(), default=0) / w,
            sum(a == b for a, b in zip(words, words[1:])) / w, sum(a == b for a, b in zip(words, words[2:])) / w,
            sum(c for x, c in tally.items() if not x[-1].isalnum() and x[-1] not in ".,") / w,
            sum(c for x, c in tally.items() if x.isupper() and len(x) > 1) / w,
            sum(c for x, c in tally.items() if len(x) == 1) / w,
            np.log1p(len(lines)), len(set(lines)) / k, len(text) / k,
            upper / max(1, len(text)), marks / max(1, len(text)), repeat]


@dataclass
class Trees:
    """Trees of one depth: node i has the children 2i + 1 (up to the threshold) and 2i + 2."""
    base: float
    feature: np.ndarray     # trees x inner nodes
    threshold: np.ndarray   # trees x inner nodes
    value: np.ndarray       # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        trees = np.arange(len(self.feature))[None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        leaves = self.value[trees, node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-(self.base + leaves.sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting on the logistic loss; each split is the best of all features' histograms."""
    n, n_features = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(n_features) * BINS
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    total = np.full(n, base)
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    feature = np.zeros((TREES, inner), np.int64)
    threshold = np.full((TREES, inner), np.inf)   # a node that is not split sends all rows to the left
    value = np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            cell = ((node - first)[:, None] * (n_features * BINS) + flat).ravel()
            shape = (width, n_features, BINS)
            g = np.bincount(cell, np.repeat(slope, n_features), width * n_features * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(weight, n_features), width * n_features * BINS).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all ** 2 / (h_all + RIDGE)
            gain[(h < LEAST_WEIGHT) | (h_all - h < LEAST_WEIGHT)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, weight, leaves) + RIDGE)
        total += value[t, leaf]
    return Trees(base, feature, threshold, value)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_name: str = "doc_id", text_name: str = "text",
          label_name: str = "quality", most: int = SAMPLE_PER_LABEL) -> Trees | None:
    """Trees from at most ``most`` labelled whole texts of each label (0, 1) among the usable labels; None without any.

    ``usable`` is a condition on the id. The sample's ids are broadcast: at most twice ``most``; of rows that repeat an
    id one is learned from. The labels keep their share: rows weigh as the counts of their label among all usable ones do.
    """
    labels = labels.where(usable & F.col(label_name).isin(0, 1)).select(id_name, F.col(label_name).alias("_label"))
    shares = {r[0]: r[1] for r in labels.groupBy("_label").count().collect()}   # at most two rows
    picked = sample_per_class(labels, id_name, "_label", most).dropDuplicates([id_name])
    rows = one_of_each(docs.select(id_name, text_of(text_name).alias("_text")).join(F.broadcast(picked), id_name), [id_name], "_text")

    def describe(batches):
        for batch in batches:
            x = [np.array(statistics(t.as_py())).astype("<f8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x, pa.binary())],
                                             names=["label", "x"])

    got = rows.select("_label", "_text").mapInArrow(describe, "label long, x binary").collect()
    if not got:
        return None
    got.sort()   # the order of partitions must not matter
    x = np.stack([np.frombuffer(r.x, "<f8") for r in got])
    y = np.array([r.label for r in got], float)
    trees = fit(x, y)
    # From the sample's odds to those of all usable labels.
    if 0 < y.mean() < 1:
        trees.base += float(np.log(shares[1] / shares[0]) - np.log(y.mean() / (1 - y.mean())))
    return trees


def predict(docs: DataFrame, trees: Trees | None, text_name: str = "text", as_name: str = "quality") -> DataFrame:
    """``docs`` with one more column: (score, predicted) of the whole text.

    A null text counts as empty. Without trees (no labels) the score is 0.5. All rows and columns stay.
    """
    @F.pandas_udf("score double, predicted int")
    def of(texts: pd.Series) -> pd.DataFrame:
        if trees is None or not len(texts):
            score = np.full(len(texts), 0.5)
        else:
            score = trees.score(np.array([statistics(t or "") for t in texts]))
        return pd.DataFrame({"score": score, "predicted": (score >= CUT).astype(np.int32)})

    return docs.withColumn(as_name, of(F.col(text_name)))
