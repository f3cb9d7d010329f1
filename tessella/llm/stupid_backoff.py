"""Language-model scores of documents by stupid backoff.

Counts of the n-grams of the whole corpus, up to ORDER words, are kept in a table that is
partitioned by n-gram hash; every document's n-grams meet their counts there, and each
document is scored by the sum of its words' logs:

    S(w3 | w1 w2) = c(w1 w2 w3) / c(w1 w2)   if c(w1 w2 w3) >= MIN_COUNT
                    ALPHA * S(w3 | w2)       else, likewise down to
    S(w)          = c(w) / N

N-grams of several words that stand only once in the corpus do not count (MIN_COUNT), so
a document does not vouch for itself; words are counted as they are.

For 100 TB the exchange, not the arithmetic, decides. Documents are dealt into chunks by
their id; a chunk lists each of its different n-grams once, with its count, packed into
one row per hash bucket: sorted 64-bit hashes as differences, in as few bytes as they need. A bucket adds up
the counts of all chunks and answers each in the order of its list, with frequent
n-grams already summed up, so no n-gram is hot. Chunk and bucket numbers grow with the
input. N-grams are told apart by 64-bit hashes.

Edge cases: null, empty and blank texts have no words and score null; repeated rows
count as often as they stand; rows with a null id are counted and scored too; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, store

#: Words of the longest n-grams.
ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
#: Bytes of text a chunk, and packed bytes a bucket, should hold.
CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 12 << 20
#: Bytes of text whose words are held at once.
PORTION_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str | None] | pa.Array, order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes per order (entry i of order n: the n-gram that starts at word i; zero where
    it would cross a document's end), and the number of words of each text."""
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    # blanks at the ends of a text leave empty words there
    real = pc.greater(pc.binary_length(words), 0)
    of = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.bincount(of[real.to_numpy(zero_copy_only=False)], minlength=len(texts)).astype(np.int64)
    coded = words.filter(real).dictionary_encode()
    own = coded.dictionary
    edges = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, own.offset * 4).tolist() if len(own) else [0]
    data, digest = own.buffers()[2].to_pybytes() if edges[-1] else b"", xxhash.xxh64_intdigest
    names = _mix(np.array([digest(data[x:y]) for x, y in zip(edges, edges[1:], strict=False)], np.uint64) + np.uint64(1))
    first = names[coded.indices.to_numpy(zero_copy_only=False)]
    n = len(first)
    last = np.repeat(np.cumsum(sizes), sizes)  # one past each word's document
    out = [first]
    for k in range(1, order):
        g = np.zeros(n, np.uint64)
        if n > k:
            g[:-k] = _mix(out[-1][:-k] * _ODD + first[k:] * np.uint64(2 * k + 1))
            g[np.arange(n) + k >= last] = 0
        out.append(g)
    return out, sizes


def _pack(sorted_hashes: np.ndarray, base: int) -> bytes:
    """Differences of sorted hashes from base on, as planes of bytes, the highest compressed:
    the width, the length of the highest plane if it is compressed, and the planes."""
    d = np.diff(sorted_hashes, prepend=np.uint64(base))
    width = max(1, -(-int(d.max()).bit_length() // 8))
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    top, low = planes[-1].tobytes(), planes[:-1].tobytes()
    small = zstandard.compress(top, 1)
    top, size = (small, len(small)) if len(small) < len(top) else (top, 0)
    return struct.pack("<BI", width, size) + top + low


def _unpack(raw: bytes, base: int) -> np.ndarray:
    width, size = struct.unpack_from("<BI", raw)
    planes = zstandard.decompress(raw[5 : 5 + size]) + raw[5 + size :] if size else raw[5:]
    n = len(planes) // width
    d = np.zeros((n, 8), np.uint8)
    d[:, width - 1] = np.frombuffer(planes, np.uint8, n)
    d[:, : width - 1] = np.frombuffer(planes, np.uint8, offset=n).reshape(width - 1, n).T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)


def _counts(values: np.ndarray) -> bytes:
    """Counts from 1: a bit for each that is more, a byte for each of those, eight bytes for
    each that a byte cannot hold."""
    more = values > 1
    rest = values[more]
    large = rest >= 256
    data = np.packbits(more).tobytes() + np.where(large, 0, rest).astype(np.uint8).tobytes() + rest[large].astype("<u8").tobytes()
    return zstandard.compress(data, 1)


def _read_counts(raw: bytes, n: int) -> np.ndarray:
    data = zstandard.decompress(raw)
    at = (n + 7) // 8
    more = np.unpackbits(np.frombuffer(data, np.uint8, at), count=n).astype(bool)
    m = int(more.sum())
    rest = np.frombuffer(data, np.uint8, m, at).astype(np.int64)
    rest[rest == 0] = np.frombuffer(data, "<u8", offset=at + m)
    out = np.ones(n, np.int64)
    out[more] = rest
    return out


def _merged(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different names of sorted lists, their summed counts, and where each name stands."""
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")  # merges the sorted lists
    every = every[order]
    new = np.append(True, every[1:] != every[:-1]) if len(every) else np.zeros(0, bool)
    back = np.empty(len(every), np.int64)
    back[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(np.concatenate(counts)[order], starts) if len(starts) else np.zeros(0, np.int64)
    return every[starts], sums, back


def _portions(texts: pa.ChunkedArray) -> Iterator[pa.Array]:
    """The texts in portions of about PORTION_BYTES, or one text."""
    for part in texts.chunks:
        if len(part):
            ends = np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(ends // PORTION_BYTES)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
                yield part.slice(a, b - a)


def _listed(per_order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different n-grams and their counts."""
    flat = np.concatenate(per_order)
    flat = np.sort(flat[flat != 0])
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    return flat[starts], np.diff(np.append(starts, len(flat)))


def _buckets(names: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that hold some of the sorted names."""
    own = names >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return list(zip(own[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)], strict=False))


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_words, log_score, score): the sum of natural logs, and it per word."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # powers of two, so that a bucket is the top bits of a hash
    bits = max(3, int(np.ceil(np.log2(max(1, total / BUCKET_BYTES)))))
    n_chunks = max(spark.sparkContext.defaultParallelism, int(total // CHUNK_BYTES) + 1)
    # long documents are dealt like others; equal ids with other text too
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int")
    dealt = docs.withColumn("chunk", chunk)

    def lists(key, t):
        found = [_listed(grams(p, order)[0]) for p in _portions(t.column("text"))]
        names, counts, _ = _merged([n for n, _ in found], [c for _, c in found])
        rows = _buckets(names, bits)
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "names": pa.array([_pack(names[x:y], b << 64 - bits) for b, x, y in rows], pa.binary()),
            "counts": pa.array([_counts(counts[x:y]) for _, x, y in rows], pa.binary()),
        })

    def add_up(key, t):
        base = key[0].as_py() << 64 - bits
        names = [_unpack(x, base) for x in t.column("names").to_pylist()]
        counts = [_read_counts(x, len(n)) for x, n in zip(t.column("counts").to_pylist(), names, strict=True)]
        _, sums, back = _merged(names, counts)
        ends = np.cumsum([len(n) for n in names])[:-1]
        answers = [_counts(sums[b]) for b in np.split(back, ends)]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "answer": pa.array(answers, pa.binary())})

    def scores(sizes, c):
        n = int(sizes.sum())
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(divide="ignore", invalid="ignore"):
            best, alone = np.log(c[0]), np.ones(n, bool)
            for k in range(1, order):
                # the n-gram that ends at word i starts at i - k
                at = np.arange(n) - k
                inside = at >= begin
                top = np.where(inside, c[k][np.maximum(at, 0)], 0)
                under = np.where(inside, c[k - 1][np.maximum(at, 0)], 1)
                seen = top >= min_count
                alone &= ~seen
                best = np.where(seen, np.log(np.where(seen, top, 1) / under), np.where(inside, np.log(alpha) + best, best))
        at = np.repeat(np.arange(len(sizes)), sizes)
        return np.bincount(at, best, len(sizes)), np.bincount(at, alone, len(sizes))

    def score(key, t, answers):
        found, own = [], [np.zeros(0, np.uint64)]
        for p in _portions(t.column("text")):
            per_order, sizes = grams(p, order)
            mine, at = np.unique(np.concatenate([*per_order, np.zeros(1, np.uint64)]), return_inverse=True)
            found.append((sizes, at[:-1].astype(np.int32).reshape(order, -1)))
            own.append(mine[1:])  # the first is the zero of n-grams that end nowhere
        names, _, back = _merged(own, [np.zeros(len(o), np.int64) for o in own])
        known, places = np.ones(len(names), np.int64), {b: (x, y) for b, x, y in _buckets(names, bits)}
        for b, raw in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True):
            x, y = places[b]
            known[x:y] = _read_counts(raw, y - x)
        out, k = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))], 0
        for (sizes, at), mine in zip(found, own[1:], strict=True):
            c, k = np.append(0, known[back[k : k + len(mine)]]), k + len(mine)
            out.append((sizes, *scores(sizes, c[at])))
        sizes, sums, falls = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(sizes), "sums": pa.array(sums), "falls": pa.array(falls)})

    packed = dealt.groupBy("chunk").applyInArrow(lists, "chunk int, bucket int, names binary, counts binary")
    # not cut: both sides below share the one exchange of the texts
    answers = packed.groupBy("bucket").applyInArrow(add_up, "chunk int, bucket int, answer binary")
    parts = store(
        dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
            score, f"doc_id {kind}, n_words long, sums double, falls double"
        ), "lm-parts",
    )
    # words that fell back to their own count are held against all words of the corpus
    n = max(1, parts.agg(F.sum("n_words")).first()[0] or 0)
    log_score = F.when(F.col("n_words") > 0, F.col("sums") - F.col("falls") * math.log(n))
    return parts.select("doc_id", "n_words", log_score.alias("log_score"), (log_score / F.col("n_words")).alias("score"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
