"""SimHash near-duplicates through vantage-point trees.

The 64 bits are cut into ``max_bits + 1`` blocks, so that of a pair within ``max_bits``
some block agrees. If it is the first that does, each block before it differs, and what is
left for the blocks after it is known: they are cut again in the same way. Distance
restricted to the bits of a block is a metric, so each block gets a vantage-point tree: a
node holds a vantage point and a median distance, near fingerprints go left and far ones
right, and a query of radius r goes to both sides where the triangle bound
|d(q, v) - mu| <= r does not exclude one. Two trees, one in the other, lead to a shard. At
radius 0, to which the blocks bring it, no query overlaps a boundary: a fingerprint is
copied 16 times, whatever their number, where trees of radius 1 made 35 to 580 copies.

In a shard all 64 bits are compared exactly. A large shard is put in the order of the
distance from a vantage point, and only fingerprints whose distances differ by no more
than ``max_bits`` (the triangle bound again) are compared.

Edge cases: null, empty and blank texts have no shingles and fingerprint zero, and
link like any other; texts under four words are one shingle; repeated rows collapse to
one fingerprint; an empty table gives an empty result; only doc_id and text are read.
A null doc_id keeps its row; the smallest non-null doc_id names the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, named_back, read, renamed

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Bound of the sample of fingerprints that fixes vantage points and medians.
SAMPLE = 16384
#: Fingerprints a shard should hold.
SHARD = 128
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, len(starts), 65536):
        part = zip(starts[k : k + 65536].tolist(), ends[k : k + 65536].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], seed) for s, e in part], dtype="<u8")
        seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COLS).ravel(), minlength=2048)
        total += (seen.reshape(8, 256) @ _BITS).ravel()
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long")


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    """bits in so many blocks of about equal size."""
    out, k = [], 0
    for i in range(parts):
        n = (len(bits) - k) // (parts - i)
        out.append(bits[k : k + n])
        k += n
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def paths(max_bits: int) -> list[tuple[int, int]]:
    """Masks of two blocks each; of a pair within max_bits some path agrees on both.

    Path group i is for pairs whose first agreeing block is i: i bits or more are spent on
    the blocks before. Where nothing is left to spend, one block before holds one differing
    bit, and one of its halves agrees.
    """
    blocks = _cut(list(range(64)), max_bits + 1)
    out = []
    for i, own in enumerate(blocks):
        after = [b for x in blocks[i + 1 :] for b in x]
        left = max_bits - i
        seconds = _cut(after, left + 1) if after else _cut(blocks[0], 2) if i else [own]
        out += [(_mask(own), _mask(s)) for s in seconds]
    return out


class Tree:
    """Vantage-point tree over the bits of one mask, as flat arrays in heap order."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mask, self.radius, self.depth = np.uint64(mask), radius, depth
        self.vp = np.zeros(1 << depth, np.uint64)
        self.mu = np.full(1 << depth, bin(mask).count("1") // 2, np.int16)
        members = {1: sample & self.mask}
        for node in range(1, 1 << depth):
            own = members.pop(node, sample[:0])
            if len(own):
                self.vp[node] = own[rng.integers(len(own))]
                d = np.bitwise_count(own ^ self.vp[node])
                self.mu[node] = int(np.median(d)) - (np.median(d) == d.max() and d.min() < d.max())
                near = d <= self.mu[node]
                members[2 * node], members[2 * node + 1] = own[near], own[~near]
            else:
                self.vp[node] = rng.integers(0, 2**63, dtype=np.uint64) & self.mask

    def visit(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in fps, leaf) of all leaves that the triangle bound does not exclude."""
        idx, node = np.arange(len(fps)), np.ones(len(fps), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count((fps[idx] ^ self.vp[node]) & self.mask).astype(np.int16)
            mu = self.mu[node]
            left, right = d - self.radius <= mu, d + self.radius > mu
            idx = np.concatenate((idx[left], idx[right]))
            node = np.concatenate((2 * node[left], 2 * node[right] + 1))
        return idx, node


def _forest(sample: np.ndarray, n: int, max_bits: int) -> list[tuple[Tree, Tree]]:
    """Pairs of trees; two fingerprints within max_bits meet in a shard of at least one pair."""
    depth = max(2, int(np.ceil(np.log2(max(2, n / SHARD)))))
    first = min(12, (depth + 1) // 2)
    second = min(10, depth - first)
    trees: dict[tuple[int, int], Tree] = {}
    for a, b in paths(max_bits):
        for mask, d in ((a, first), (b, second)):
            trees.setdefault((mask, d), Tree(sample, mask, 0, d, len(trees)))
    return [(trees[a, first], trees[b, second]) for a, b in paths(max_bits)]


def shard_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what is connected inside one shard of distinct fingerprints.

    Everything near a fingerprint is linked to the root of its search and leaves the
    list, so a tight cluster costs its size, and links stay fewer than fingerprints.
    """
    out: list[tuple[int, int]] = []
    signed = fps.view(np.int64)
    if len(fps) <= 512:
        close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
        i, j = np.nonzero(np.triu(close, 1))
        if len(i) < len(fps):
            return list(zip(signed[i].tolist(), signed[j].tolist(), strict=True))
    # in the order of the distance from a vantage point; equal distances stand together
    away = np.bitwise_count(fps ^ fps[0]).astype(np.int64)
    order = np.argsort(away, kind="stable")
    fps, away = fps[order], away[order]
    edges = np.searchsorted(away, np.arange(66 + max_bits))
    here = np.ones(len(fps), bool)
    for k in range(len(fps)):
        if not here[k]:
            continue
        here[k] = False
        root, todo = int(fps[k : k + 1].view(np.int64)[0]), [k]
        while todo:
            at = todo.pop()
            lo, hi = edges[max(0, away[at] - max_bits)], edges[away[at] + max_bits + 1]
            near = lo + np.flatnonzero(here[lo:hi] & (np.bitwise_count(fps[lo:hi] ^ fps[at]) <= max_bits))
            if len(near):
                here[near] = False
                out += [(root, x) for x in fps[near].view(np.int64).tolist()]
                todo += near.tolist()
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints in column fp that join each class."""
    spark = fps.sparkSession
    n = fps.count()
    rows = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    forest = spark.sparkContext.broadcast(_forest(sample, n, max_bits))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, trees in enumerate(forest.value):
                idx, key = np.arange(len(x)), np.full(len(x), t, np.int64)
                for tree in trees:
                    at, leaf = tree.visit(x[idx])
                    idx, key = idx[at], (key[at] << 20) + leaf
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(x[idx].view(np.int64))], names=["shard", "fp"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found):
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(k, f):
            cuts = np.flatnonzero(np.diff(k)) + 1
            out = []
            for part in np.split(f, cuts):
                if len(part) > 1:
                    out += shard_links(np.unique(part), max_bits)
            return out

        for b in batches:
            if not b.num_rows:
                continue
            held_k = np.concatenate((held_k, b.column(0).to_numpy(zero_copy_only=False)))
            held_f = np.concatenate((held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            last = int(np.searchsorted(held_k, held_k[-1]))
            if last:
                if found := done(held_k[:last], held_f[:last]):
                    yield emit(found)
                held_k, held_f = held_k[last:], held_f[last:]
        if found := done(held_k, held_f):
            yield emit(found)

    routed = fps.select("fp").mapInArrow(route, "shard long, fp long")
    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(compare, "a long, b long")


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, least, component_id) of rows (id, fp): one row a fingerprint, with its smallest id
    and that of all fingerprints reachable from it."""
    own = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    found = connected_components(links(own, max_bits)).withColumnRenamed("node", "fp")
    linked = found.join(own, "fp")
    # cut, so that the join below deals both its sides itself and can split a hot component
    named = cut(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    names = found.join(named, "component").select("fp", "component_id")
    return own.join(names, "fp", "left").select("fp", "least", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(
    docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE
) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row of docs."""
    marked = cut(fingerprints(docs, id_col, text_col, width))
    names = cut(classes(marked, max_bits))
    return marked.join(names.select("fp", "component_id"), "fp", "left").select(
        F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, width: int = SHINGLE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicate class, with the
    columns of docs, whatever their names. Rows of a null doc_id stay."""
    own, new = renamed(docs, ("doc_id", "text"))
    found = near_duplicates(own.select("doc_id", "text"), max_bits, width=width)
    keep = found.where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("_keep")).distinct()
    out = own.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
    return out.select(*named_back(out, new, docs.columns))
