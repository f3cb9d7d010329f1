"""Toxicity by compression distance.

Several zstandard dictionaries are built from labelled text: all hold the words that are
common everywhere; the ordinary one adds the stems (word beginnings and whole words) that
ordinary documents use more, and the toxic ones, of rising strictness (``LEVELS``), those
that toxic documents use more, filled up to equal size. A window is a word before a fixed
tail that all dictionaries hold (zstandard codes no match near the end of a block); it is
compressed with each, and the bytes that a toxic dictionary saves over the ordinary one are
its gain. Gains are remembered by word. For each toxic dictionary a document's largest gain,
and how many and what share of its windows gain over each threshold, are turned into a
probability by weights calibrated on labelled documents.

The dictionaries are chosen stems and not trained by the library, and a window is one
word: trained on whole texts they tell next to nothing here, as the README's figures show.

Stem counts come from a bounded sample of ``MAX_DOCS`` labelled documents a class, and
calibration from ``MAX_TRAIN`` labelled rows; scoring reads every whole text once.

Edge cases: null, empty and blank texts have gain zero and get a score; without labels
of both classes the score is the mean label, or a half; repeated rows and null ids are
scored like others (a null id is never trained on); an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, store
from .labelled import bounded, remainder, training_labels

#: The tail of every window.
TAIL = b"0123456789ABCDEFGHIJKLMNOP"
#: Window gains that count, in bytes.
THRESHOLDS = (2, 3, 5)
CACHE = 300_000
MAX_DOCS = 2000
MAX_TRAIN = 40_000
#: Values that sum up a document's gains by one dictionary.
PER_LEVEL = 1 + 2 * len(THRESHOLDS)
COMMON, ONE_SIDED, CANDIDATES = 300, 250, 4000
#: z scores from which a stem is one-sided, for each toxic dictionary; for the first also
#: this share of the largest. The broad ones know the stems of rare languages, the strict ones
#: few that ordinary words begin with by chance.
LEVELS, LEAST_SHARE = (6.0, 8.0, 10.0, 14.0), 0.25
#: Lengths of word beginnings, the blank before them included.
STEMS = (5, 6, 7, 8, 10)
_STRIP = ".,;:!?\"'()"


def stems(text: str) -> set[str]:
    """The different stems of a text; whole words end in a blank."""
    out: set[str] = set()
    for w in {w.strip(_STRIP) for w in text.lower().split()}:
        if 3 <= len(w) <= 30:
            x = f" {w} "
            out.add(x)
            out.update([x[:k] for k in STEMS if k < len(x)])
    return out


def stem_table(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(stem, toxic, ordinary): different texts of each class in the sample that hold a stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[bool(y)].update(stems(t or ""))
            for y in (0, 1):
                names = [pa.array(list(seen[y]), pa.string()), pa.array(list(seen[y].values()), pa.int64())]
                n = len(seen[y])
                cols = [names[0], names[1], pa.array(np.zeros(n, np.int64))] if y else [names[0], pa.array(np.zeros(n, np.int64)), names[1]]
                yield pa.RecordBatch.from_arrays(cols, names=["stem", "toxic", "ordinary"])

    # at most 2 * MAX_DOCS ids are broadcast; copies of a text count once
    chosen = docs.join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text")).agg(
        F.max("y").alias("y"), F.first("text").alias("text")
    ).select("y", "text")
    counts = chosen.mapInArrow(run, "stem string, toxic long, ordinary long")
    return counts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _different(stems_by_worth: list[str], n: int) -> list[str]:
    """The first n that no chosen one holds."""
    out: list[str] = []
    for s in stems_by_worth:
        if len(out) == n:
            break
        if not any(s in x for x in out):
            out.append(s)
    return out


def dictionaries(docs: DataFrame, known: DataFrame) -> tuple[list[bytes], bytes]:
    """Contents of the toxic dictionaries, and of the ordinary one."""
    toxic, ordinary = (bounded(known.where(F.col("y") == y), MAX_DOCS) for y in (1, 0))
    sample = store(toxic.unionByName(ordinary), "sample")
    table = store(stem_table(docs, sample), "stems")
    # a stem's share among the texts of a class, against the largest count as their number
    na, nb = table.agg(F.max("toxic"), F.max("ordinary")).first()
    na, nb = max(na or 1, 1), max(nb or 1, 1)
    a, b = F.col("toxic"), F.col("ordinary")
    p = F.least((a + b) / (na + nb), F.lit(0.999))
    z = (a / na - b / nb) / F.sqrt(p * (1 - p) * (1 / na + 1 / nb))
    table = store(table.where(a + b >= 5).withColumn("z", z), "ranked")

    def top(order, where, n: int) -> list[str]:
        return [r.stem for r in table.where(where).orderBy(order, F.length("stem").desc(), "stem").limit(n).collect()]

    rank = F.round("z", 1)

    def one_sided(sign: int, least: float) -> list[str]:
        return _different(top((rank * sign).desc(), F.col("z") * sign > least, CANDIDATES), ONE_SIDED)

    best = [table.agg(F.max(F.col("z") * sign)).first()[0] or 0.0 for sign in (1, -1)]
    bars = [max(LEVELS[0], LEAST_SHARE * best[0]), *LEVELS[1:]]
    sides = [one_sided(1, bar) for bar in bars] + [one_sided(-1, max(LEVELS[0], LEAST_SHARE * best[1]))]
    size = max(len("".join(own)) for own in sides)
    # texts are in lower case, so capitals fill a dictionary up without matching
    fill = "".join(hashlib.sha256(bytes([k % 256, k // 256])).hexdigest().upper() for k in range(size // 64 + 1))
    whole = F.col("stem").endswith(" ")
    base = top((a + b).desc(), whole & (F.abs("z") < LEVELS[0]), COMMON)
    # the end of a dictionary is the cheapest to refer to: the best stems stand last
    filled = ["".join([fill[: size - len("".join(own))], *own[::-1]]) for own in sides]
    contents = [("".join(base[::-1]) + own).encode() for own in filled]
    return contents[:-1], contents[-1]


class Gains(dict):
    """Number of each word (bytes, in lower case) in ``table``, whose rows are the gains of
    words by each toxic dictionary; words of equal gains share a row."""

    def __init__(self, toxic: list[bytes], ordinary: bytes):
        super().__init__()

        def compressor(content: bytes):
            own = zstandard.ZstdCompressionDict(TAIL + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                5, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            return zstandard.ZstdCompressor(dict_data=own, compression_params=params)

        self.toxic, self.ordinary = [compressor(t) for t in toxic], compressor(ordinary)
        self.rows: dict[tuple[int, ...], int] = {}
        self.table = np.zeros((0, len(toxic)), np.int64)

    def gain(self, word: bytes) -> tuple[int, ...]:
        window = b" " + word + b" " + TAIL
        plain = len(self.ordinary.compress(window))
        return tuple(plain - len(t.compress(window)) for t in self.toxic)

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = row = self.rows.setdefault(self.gain(word), len(self.rows))
        return row

    def of(self, text: str | None) -> np.ndarray:
        """A row of gains for each window of a text."""
        rows = list(map(self.__getitem__, (text or "").lower().encode("utf-8", "surrogatepass").split()))
        if len(self.rows) > len(self.table):
            self.table = np.array(list(self.rows), np.int64).reshape(len(self.rows), -1)
        return self.table[rows]


def summary(gains: np.ndarray) -> list[float]:
    """For each dictionary the largest gain and, for each threshold, log of the count and root
    of the share of windows."""
    if not len(gains):
        return [0.0] * (gains.shape[1] * PER_LEVEL)
    out = []
    for g in gains.T:
        out.append(float(g.max()))
        for t in THRESHOLDS:
            n = int((g >= t).sum())
            out += [float(np.log1p(n)), 10 * float(np.sqrt(n / len(g)))]
    return out


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return np.array([0.0] * x.shape[1] + [np.clip(np.log((p + 1e-3) / (1 - p + 1e-3)), -6, 6)])
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
    return w


def score_documents(docs: DataFrame, labels: DataFrame, label: str, in_training, threshold: float) -> DataFrame:
    """(doc_id, max_gain, score, predicted) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = training_labels(labels, label, in_training)
    toxic, ordinary = dictionaries(docs, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(toxic, ordinary)
        for b in batches:
            x = [summary(gains.of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    table = store(docs.mapInArrow(run, "doc_id long, x array<double>"), "gains")
    rows = bounded(table.join(known, "doc_id"), MAX_TRAIN).collect()
    w = calibrate(np.array([r.x for r in rows]).reshape(-1, len(LEVELS) * PER_LEVEL), np.array([r.y for r in rows], np.float64))
    logit = F.lit(float(w[-1]))
    for i, v in enumerate(w[:-1]):
        logit = logit + F.col("x")[i] * float(v)
    x = table.withColumn("score", 1 / (1 + F.exp(-logit)))
    return x.select(
        "doc_id", F.col("x")[0].alias("max_gain"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 3)
    out = score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "toxic", fold != 1, 0.7)
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")
