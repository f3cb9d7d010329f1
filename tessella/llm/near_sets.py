"""SimHash near-duplicates held to the Jaccard similarity of word shingles.

Candidates come from two sides. Vantage-point trees over SimHash fingerprints give the
classes of ``simhash``: texts that differ in 4 bits or less. Two texts of similarity 0.8
differ in about 10 of 64 bits, and at the radius that finds most of them (14 or more) neither the
pigeonhole blocks nor the triangle bound exclude anything; for these each text gets
``BANDS`` keys of ``ROWS`` MinHash values, and a pair of similarity s shares a key with
probability 1 - (1 - s**ROWS)**BANDS, which is 0.9996 at 0.8.

Texts that are equal byte for byte are one node. Nodes that share a class or key form a group,
groups of the same members count once, and only the texts of groups of two or more are
sent. In a group the similarity of whole shingle sets decides: what is near a node is
linked to the root of its search and leaves the list, so a tight group costs its size, and
no pair of a group that could add a link is left out. A group must fit one task.

Edge cases: null, empty and blank texts have no shingles and are near each other only;
texts under ``WIDTH`` words are one shingle; words are lowered as SimHash's are; rows with
a null doc_id link and stay; the smallest non-null doc_id of a class is kept; an empty
table gives an empty result. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, cut, named_back, renamed, store

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
SEED = 42
_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_JOIN = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted different hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key for each band of MinHash values of a shingle set."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(own), 1024):
        least = np.minimum(least, (own[k : k + 1024, None] * _MULTIPLY + _ADD).min(axis=0))
    x = (least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def group_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join what is connected among the sets of one group."""
    sizes = np.array([len(s) for s in sets])
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            own = sets[todo.pop()]
            # sets of too different sizes cannot be that similar
            n = sizes[left]
            some = left[np.minimum(n, len(own)) >= least * np.maximum(n, len(own))]
            if not len(some):
                continue
            if len(own):
                flat = np.concatenate([sets[i] for i in some])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                some = some[common >= least * (len(own) + sizes[some] - common)]
            out += [(int(root), int(i)) for i in some]
            todo += list(some)
            left = np.setdiff1d(left, some, assume_unique=True)
    return out


def _banded(docs: DataFrame, kind: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            keys = [band_keys(shingles(t, width)) for t in texts]
            fps = np.array([simhash.fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            columns = [b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(fps)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "bands", "fp"])

    return docs.mapInArrow(run, f"id {kind}, node binary, bands array<long>, fp long")


def _links(grouped: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b) from rows (grp, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(nodes, texts):
            found = group_links([shingles(t, width) for t in texts], least)
            a, b = [nodes[i] for i, _ in found], [nodes[j] for _, j in found]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        group, nodes, texts = None, [], []
        for r in batches:
            for g, n, t in zip(*(r.column(i).to_pylist() for i in range(3)), strict=True):
                if g != group:
                    if len(nodes) > 1:
                        yield done(nodes, texts)
                    group, nodes, texts = g, [], []
                nodes.append(n)
                texts.append(t)
        if len(nodes) > 1:
            yield done(nodes, texts)

    return grouped.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(run, "a binary, b binary")


def keep_one(docs: DataFrame, width: int = WIDTH, least: float = LEAST, max_bits: int = simhash.MAX_BITS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicate class, with the
    columns of docs, whatever their names."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs, new, names = *renamed(docs, ("doc_id", "text")), docs.columns
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))
    marked = store(_banded(own, kind, width), "near-bands")
    nodes = marked.groupBy("node").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    fps = cut(nodes.select("fp").distinct())
    classes = connected_components(simhash.links(fps, max_bits)).withColumnRenamed("node", "fp")
    by_class = nodes.select("node", "fp").join(classes, "fp", "left").select(
        "node", F.xxhash64(F.coalesce("component", "fp"), F.lit("class")).alias("band")
    )
    keyed = nodes.select("node", F.explode("bands").alias("band")).unionByName(by_class)
    groups = keyed.groupBy("band").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    groups = groups.where(F.size("nodes") > 1).groupBy("nodes").agg(F.min("band").alias("grp"))
    members = cut(groups.select("grp", F.explode("nodes").alias("node")))
    texts = own.select("node", "text").join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    links = _links(members.join(texts, "node").select("grp", "node", "text"), width, least)
    found = connected_components(links)
    named = marked.groupBy("node").agg(F.min("id").alias("id")).join(found, "node", "left")
    keep = named.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("id").alias("_keep")).select("_keep")
    # rows of null id stay whatever they are near to
    none = docs.sparkSession.range(1).select(F.lit(None).cast(kind).alias("_keep"))
    keep = keep.where(F.col("_keep").isNotNull()).unionByName(none)
    out = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
    return out.select(*named_back(out, new, names))
