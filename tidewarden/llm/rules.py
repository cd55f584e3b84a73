"""Quality rules: fixed rules, and an isolation forest over the statistics that such rules look at.

One pass over the texts counts the statistics of each document. The forest's trees split a few rows at random
features and values; a row that few splits part from the others is unlike them. The forest is grown on a bounded sample of
labelled rows, most of them good. Its threshold is calibrated on all labelled rows, from one histogram of scores per label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewarden.llm.common import settle, text_of

LEAST_WORDS = 10          # fixed rules: fewer words fail,
REPEAT_PERCENT = 20       # and a larger share of words in repeated windows
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
TREES = 200
TREE_ROWS = 256           # rows of one tree
HEIGHT = 8
SAMPLE = 4000             # labelled rows that the trees draw from, at most, of good ones;
BAD_SHARE = 0.02          # with so many bad ones among a tree's rows
PLAIN = 40                # plain words of 4.2 letters that are added to each text, so that ratios of short texts vary less
CLEAN_LOSS = 0.005        # share of good labelled rows that may be dropped
BINS = 2000               # of the histogram of scores

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marked", "n_same")
FEATURES = ("word length", "symbols a word", "capitals", "marked words", "words like the last")

_MARK, _BLANK, _UPPER, _LETTER = (np.array([c in chars for c in map(chr, range(256))]) for chars in (
    "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", BLANKS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def repeated_words(ids: np.ndarray) -> int:
    """Words, given by numbers below their count, that lie in windows of ``WINDOW`` words found twice or more."""
    n = len(ids)
    if n <= WINDOW:
        return 0
    of = ids.astype(np.int64)
    for k in range(1, WINDOW):   # windows grow by a word; a window's number stays below n
        of = np.unique(of[:-1] * (n + 1) + ids[k:], return_inverse=True)[1]
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.bincount(of)[of] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((edge.cumsum() > 0).sum())


def counts_of(text: str) -> list[int]:
    """``COUNTS`` of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()   # of bytes: at ASCII blanks only
    codes = np.frombuffer(raw, np.uint8)
    tally = np.bincount(codes, minlength=256)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    ends = np.append(_BLANK[codes[1:]], True) if len(codes) else np.empty(0, bool)
    return [len(words), len(text) - sum(map(text.count, BLANKS)), int(sum(tally[ord(c)] for c in SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(ids), int(tally[_UPPER].sum()), int(tally[_LETTER].sum()), int((_MARK[codes] & ends).sum()),
            int((ids[1:] == ids[:-1]).sum())]


def features(counts: np.ndarray) -> np.ndarray:
    """``FEATURES`` of rows of ``COUNTS``: ratios, so that long texts are not unlike short ones for their length.

    Repeated windows and lines are left to the fixed rule: a quoted line is no anomaly.
    """
    of = dict(zip(COUNTS, counts.T.astype(float)))
    words = of["n_words"] + PLAIN
    return np.stack([np.log1p((of["word_chars"] + 4.2 * PLAIN) / words), np.sqrt(of["n_symbols"] / words),
                     of["n_upper"] / (of["n_letters"] + 4.2 * PLAIN),
                     np.sqrt(of["n_marked"] / words), np.sqrt(of["n_same"] / words)], axis=1)


def usual_path(n):
    """Mean path length of a search in a random tree of ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees of one height: node i has the children 2i + 1 (up to the value) and 2i + 2."""
    feature: np.ndarray    # trees x inner nodes
    value: np.ndarray      # trees x inner nodes; a leaf sends all rows left, down to the last level
    length: np.ndarray     # trees x last level: path length of the rows that come out there
    usual: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 per row; the higher, the sooner parted from the others."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, length in zip(self.feature, self.value, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(HEIGHT):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            total += length[node - (2 ** HEIGHT - 1)]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def grow(good: np.ndarray, bad: np.ndarray, seed: int = 12) -> Forest:
    """Trees over draws from the rows of features; features without a spread in a node are not split there."""
    draw = np.random.default_rng(seed)
    inner = 2 ** HEIGHT - 1
    feature, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf)
    length = np.zeros((TREES, inner + 1))
    n_bad = min(len(bad), max(1, round(BAD_SHARE * TREE_ROWS)))
    n_good = min(len(good), TREE_ROWS - n_bad)
    for t in range(TREES):
        x = np.vstack([good[draw.choice(len(good), n_good, replace=False)], bad[draw.choice(len(bad), n_bad, replace=False)]])
        todo = [(0, 0, x)]
        while todo:
            node, depth, own = todo.pop()
            low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(x.shape[1]),) * 2
            spread = np.flatnonzero(high > low)
            if depth == HEIGHT or not len(spread):
                first = node
                for _ in range(depth, HEIGHT):
                    first = 2 * first + 1
                length[t, first - inner] = depth + usual_path(len(own))
                continue
            k = draw.choice(spread)
            feature[t, node], value[t, node] = k, draw.uniform(low[k], high[k])
            left = own[:, k] <= value[t, node]
            todo += [(2 * node + 1, depth + 1, own[left]), (2 * node + 2, depth + 1, own[~left])]
    return Forest(feature, value, length, float(usual_path(n_good + n_bad)))


def threshold_of(good: np.ndarray, bad: np.ndarray) -> float:
    """The score from which rows are dropped, from histograms over ``BINS`` equal steps of 0 to 1.

    Of the steps that drop at most ``CLEAN_LOSS`` of the good rows: where the shares of bad rows dropped and good rows kept
    are largest together, in the middle of equal ones.
    """
    lost = np.append(good[::-1].cumsum()[::-1], 0) / max(1, good.sum())    # dropped when the threshold is this step
    caught = np.append(bad[::-1].cumsum()[::-1], 0) / max(1, bad.sum())
    worth = np.where(lost <= CLEAN_LOSS, caught - lost, -1.0)
    best = np.flatnonzero(worth == worth.max())
    run = best[:int(np.argmin(np.append(np.diff(best) == 1, False))) + 1]  # the first of the equal stretches
    return float(run[(len(run) - 1) // 2]) / BINS


def counted(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """(id, counts: ``COUNTS`` as an array) per document."""
    kind = docs.schema[id_name].dataType.simpleString()

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([counts_of(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))], names=["id", "counts"])

    return docs.select(F.col(id_name).alias("id"), text_of(text_name).alias("t")).mapInArrow(count, f"id {kind}, counts array<long>")


def _failed():
    n, repeated = F.col("counts")[0], F.col("counts")[COUNTS.index("n_repeat_words")]
    return (n < LEAST_WORDS) | (100 * repeated > REPEAT_PERCENT * n)


def learn(counts: DataFrame, labels: DataFrame, id_name: str = "doc_id", label_name: str = "quality",
          most: int = SAMPLE) -> tuple[Forest, float] | None:
    """The forest and its threshold from labelled rows that pass the fixed rules; None unless both labels occur there.

    At most ``most`` rows of each label, chosen by a hash, are drawn from; all labelled rows calibrate the threshold. An id
    that is labelled both ways counts for both.
    """
    labels = labels.where(F.col(label_name).isin(0, 1)).select(F.col(id_name).alias("_id"), F.col(label_name).alias("label")).distinct()
    rows = settle(counts.where(~_failed()).join(labels, F.col("id") == F.col("_id")).select("id", "counts", "label"), "rules-labelled")
    drawn = []
    for label in (1, 0):
        got = rows.where(F.col("label") == label).orderBy(F.xxhash64("id", F.lit(5)), "id", "counts").limit(most).select("counts").collect()
        drawn.append(np.array([r.counts for r in got]))
    if not len(drawn[0]) or not len(drawn[1]):
        return None
    forest = grow(features(drawn[0]), features(drawn[1]))
    step = F.least(F.floor(_scores(forest)("counts") * BINS), F.lit(BINS - 1)).cast("int")
    shares = np.zeros((2, BINS), np.int64)
    for r in rows.groupBy("label", step.alias("step")).count().collect():   # at most 2 x BINS rows
        shares[r["label"], r["step"]] = r["count"]
    return forest, threshold_of(shares[1], shares[0])


def _scores(forest: Forest):
    @F.pandas_udf("double")
    def of(counts: pd.Series) -> pd.Series:
        return pd.Series(forest.score(features(np.stack(counts.to_list()))) if len(counts) else [], dtype=float)
    return of


def judge(docs: DataFrame, labels: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """One row per document: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept).

    Words are parted by ASCII blanks; a line counts as repeated when it has a word and equals an earlier one. Texts of fewer
    than ``LEAST_WORDS`` words and those with more than ``REPEAT_PERCENT`` percent of their words in repeated windows fail;
    the others are kept when their score is below the threshold. A null or empty text has no words and fails. Without
    labels of both kinds no forest can be grown: the score is 0 then and all that pass the fixed rules are kept. Rows that
    repeat an id count each; other columns are ignored; an empty table gives no rows.
    """
    counts = settle(counted(docs, id_name, text_name), "rules-counts")
    model = learn(counts, labels)
    score = _scores(model[0])("counts") if model else F.lit(0.0)
    rows = counts.withColumn("score", score)
    return rows.select(F.col("id").alias(id_name), *[F.col("counts")[k].alias(name) for k, name in enumerate(COUNTS[:5])], "score",
                       _failed().alias("base_failed"),
                       (~_failed() & (F.col("score") < (model[1] if model else 1.0))).alias("kept"))
