"""Sum-of-squares online packing of documents into windows of at most ``capacity`` ids.

Whole windows are cut off a document's front; the rest is placed, in arrival order,
into an open window of the fill level h that makes the sum over levels of (number of
open windows)^2 smallest, or into a new window. A level array holds those numbers.
Each input partition packs by itself, without a shuffle, and when it ends it pours its
emptiest open windows into its fullest, cutting pieces, so that it leaves at most one
window that is not full: padding is under ``capacity`` ids a partition.

Edge cases: null text counts as empty (one piece, the end id); null doc_ids and
repeated rows are packed like others; an empty table gives no pieces; columns other
than doc_id and text are not read. No id is dropped or repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .tokens import encoder, portions

CAPACITY = 1024
END_ID = 0
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


class Packer:
    """Pieces are (doc, start, ids, doc_tokens); ids are an array of unsigned 32-bit ints."""

    def __init__(self, capacity: int, first_sequence: int = 0, with_ids: bool = True):
        self.with_ids = with_ids
        self.capacity, self.next = capacity, first_sequence
        # open windows of each level; half a window less at the top makes filling one count
        # as losing a square without gaining one
        self.levels = np.zeros(capacity + 1)
        self.levels[capacity] = -0.5
        self.open: dict[int, list[list]] = {}
        self.out: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.tobytes()
            kept = raw if self.with_ids else None
            self.out.append((doc, start, len(ids), zlib.crc32(raw), total, self.next, offset, kept))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, cap = len(ids), self.capacity
        full = total - total % cap
        for k in range(0, full, cap):
            self.close([(doc, k, ids[k : k + cap], total)])
        if full < total:
            self.place((doc, full, ids[full:], total))

    def place(self, piece: tuple) -> None:
        size, n, cap = len(piece[2]), self.levels, self.capacity
        now = n[1 : cap - size + 1]
        change = np.where(now > 0, 2 * (n[1 + size :] - now) + 2, np.inf)
        # of equal changes, the fullest level
        best = len(change) - int(np.argmin(change[::-1])) if len(change) else 0
        if best and change[best - 1] <= 2 * n[size] + 1:
            window = self.open[best].pop()
            n[best] -= 1
        else:
            best, window = 0, []
        window.append(piece)
        if best + size == cap:
            self.close(window)
        else:
            self.open.setdefault(best + size, []).append(window)
            n[best + size] += 1

    def finish(self) -> None:
        left = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        i, j = 0, len(left) - 1
        while i < j:
            level, window = left[i]
            other, source = left[j]
            doc, start, ids, total = source.pop()
            room = self.capacity - level
            if len(ids) > room:
                source.append((doc, start + room, ids[room:], total))
                ids = ids[:room]
            window.append((doc, start, ids, total))
            left[i], left[j] = (level + len(ids), window), (other - len(ids), source)
            if level + len(ids) == self.capacity:
                self.close(window)
                i += 1
            if other == len(ids):
                j -= 1
        if i == j:
            self.close(left[i][1])
        self.open, self.levels[1 : self.capacity] = {}, 0


def pack(
    docs: DataFrame, vocabulary: str, keeps_blanks: bool = True, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True
) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, if asked for, ids (little-endian unsigned 32-bit)."""
    end = np.array([end_id], dtype="<u4").tobytes()
    names = _NAMES if with_ids else _NAMES[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, keeps_blanks)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36, with_ids)

        def given() -> pa.RecordBatch:
            cols = list(zip(*packer.out, strict=True)) if packer.out else [[]] * 8
            packer.out = []
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

        for b in batches:
            docs_of = b.column(0).to_pylist()
            for first, texts in portions(b.column(1).to_pylist()):
                for doc, raw in zip(docs_of[first:], enc.many(texts), strict=False):
                    packer.add(doc, np.frombuffer(raw + end, "<u4"))
                    if len(packer.out) > 5000:
                        yield given()
        packer.finish()
        yield given()

    schema = ", ".join(f"{n} long" for n in _NAMES[:7]) + (", ids binary" if with_ids else "")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
