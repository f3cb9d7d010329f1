"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; every feature has a table of scores by bin, and some
pairs of features a table by coarse bins. Boosting goes round the features: each turn
fits a shallow tree to the gradients summed by bin and adds its leaves to the table.
Then pairs are ranked by what a tree on both explains of the residuals, and boosted the
same way. A score is a sum of table entries, looked up for whole batches at once.

The features of all documents are computed in one pass and stored; labels are joined to
them (not to texts) and the model is fitted on a bounded sample of ``MAX_TRAIN`` rows.

Edge cases: null and empty texts have features zero and get a score; without labels of
both classes the score is the mean label, or a half; rows are scored one by one, so
repeated rows and null ids are scored like others (a null id is never trained on);
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, store
from .labelled import bounded, remainder, training_labels

MAX_TRAIN = 40_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, DEPTH = 60, 0.15, 2
FEATURES = [
    "log_words", "word_length", "symbol_share", "shout_share", "capital_share", "digit_share", "stop_share",
    "bar_share", "distinct_share", "neighbour_share", "top_share", "line_length", "line_repeat_share",
]
_SYMBOLS, _DIGITS, _STOPS = b"#*$%&<>@^~_={}[]\\", b"0123456789", b".,;:?"
_CAPITALS = bytes(range(65, 91))


def features(text: str | None) -> list[float]:
    """The features of one whole text, all finite."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(raw)

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log(n)), sum(map(len, words)) / n, share(_SYMBOLS), share(b"!"), share(_CAPITALS), share(_DIGITS),
        share(_STOPS), share(b"|"), len(counts) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n, float(np.log1p(n / len(lines))), 1 - len(set(lines)) / len(lines),
    ]


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def _tree(gain: np.ndarray, weight: np.ndarray, depth: int, smooth: float = 1.0) -> np.ndarray:
    """Leaf values by bin of a tree on one ordered feature: Newton steps of its leaves."""
    out = np.full(len(gain), gain.sum() / (weight.sum() + smooth))
    if depth == 0 or len(gain) < 2:
        return out
    g, w = np.cumsum(gain)[:-1], np.cumsum(weight)[:-1]
    g2, w2 = gain.sum() - g, weight.sum() - w
    worth = g**2 / (w + smooth) + g2**2 / (w2 + smooth)
    k = int(np.argmax(worth)) + 1
    if worth[k - 1] <= gain.sum() ** 2 / (weight.sum() + smooth) + 1e-9:
        return out
    return np.concatenate((_tree(gain[:k], weight[:k], depth - 1), _tree(gain[k:], weight[k:], depth - 1)))


def _pair_tree(gain: np.ndarray, weight: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, float]:
    """One cut on each axis: leaf values by cell, and what they explain."""
    best, table = -1.0, np.zeros_like(gain)
    g, w = gain.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    rows, cols = gain.shape
    for a in range(1, rows):
        for b in range(1, cols):
            worth, new = 0.0, np.empty_like(gain)
            for r0, r1 in ((0, a), (a, rows)):
                for c0, c1 in ((0, b), (b, cols)):
                    s = [
                        m[r1 - 1, c1 - 1] - (m[r0 - 1, c1 - 1] if r0 else 0) - (m[r1 - 1, c0 - 1] if c0 else 0)
                        + (m[r0 - 1, c0 - 1] if r0 and c0 else 0)
                        for m in (g, w)
                    ]
                    worth += s[0] ** 2 / (s[1] + smooth)
                    new[r0:r1, c0:c1] = s[0] / (s[1] + smooth)
            if worth > best:
                best, table = worth, new
    return table, best


class Model:
    """Additive model over binned features, as plain arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base, self.tables, self.pairs = 0.0, [], []
        self.cuts = [np.zeros(0)] * len(FEATURES)
        self.coarse = [np.zeros(0)] * len(FEATURES)
        if not len(y) or y.min() == y.max():
            p = y.mean() if len(y) else 0.5
            self.base = float(np.clip(np.log((p + 1e-3) / (1 - p + 1e-3)), -6, 6))
            self.tables = [np.zeros(1)] * len(FEATURES)
            return
        quantiles = lambda c, n: np.unique(np.quantile(c, np.arange(1, n) / n))
        self.cuts = [quantiles(c, BINS) for c in x.T]
        self.coarse = [quantiles(c, PAIR_BINS) for c in x.T]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        bins = [np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)]
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)

        def slopes(score):
            q = 1 / (1 + np.exp(-score))
            return y - q, q * (1 - q)

        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                g, w = slopes(score)
                n = len(self.tables[f])
                step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, w, n), DEPTH)
                self.tables[f] = self.tables[f] + step
                score += step[b]
        few = [np.searchsorted(c, v, side="right") for c, v in zip(self.coarse, x.T, strict=True)]
        cells = {}
        g, w = slopes(score)
        for i in range(len(FEATURES)):
            for j in range(i):
                shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
                if min(shape) > 1:
                    cell = few[i] * shape[1] + few[j]
                    sums = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, w)]
                    cells[i, j] = (_pair_tree(*sums)[1], cell, shape)
        for i, j in sorted(cells, key=lambda k: (-cells[k][0], k))[:PAIRS]:
            self.pairs.append([i, j, np.zeros(cells[i, j][2])])
        for _ in range(ROUNDS // 4):
            for pair in self.pairs:
                g, w = slopes(score)
                _, cell, shape = cells[pair[0], pair[1]]
                sums = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, w)]
                step = RATE * _pair_tree(*sums)[0]
                pair[2] = pair[2] + step
                score += step.ravel()[cell]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        for cuts, table, v in zip(self.cuts, self.tables, x.T, strict=True):
            total += table[np.searchsorted(cuts, v, side="right")]
        for i, j, table in self.pairs:
            a, b = (np.searchsorted(self.coarse[k], x[:, k], side="right") for k in (i, j))
            total += table[a, b]
        return 1 / (1 + np.exp(-total))


def fit(rows: list) -> Model:
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES))
    return Model(x, np.array([r.y for r in rows], np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, label: str, in_training, threshold: float) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    table = store(feature_table(docs), "features")
    known = training_labels(labels, label, in_training)
    model = fit(bounded(table.join(known, "doc_id"), MAX_TRAIN).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            s = model.score(flat.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 5)
    out = score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "quality", fold != 0, 0.3)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")
