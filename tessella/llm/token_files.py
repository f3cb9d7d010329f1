"""Token ids as files: every document is a zstandard frame of its own.

A data set is a folder with two Parquet tables. ``dictionary`` has one row, the shared
zstandard dictionary and its SHA-256. ``segments`` has rows of about ``SEGMENT`` bytes:

    shard, segment      place in the whole order (shards are ranges of doc_id)
    shard_start         ids in the shard before this segment
    first_id, last_id   smallest and largest doc_id, for pruning
    dict_hash           SHA-256 of the dictionary that its frames need
    doc_ids, offsets, n_tokens   index: offsets[i]:offsets[i+1] is the frame of doc i
    payload             the frames; ids are little-endian, ``width`` bytes each

A short document is read by pruning to its segment, slicing and decompressing one frame.

Edge cases: null text counts as empty; an empty document has the end id only; null
doc_ids sort first; rows of one id are kept, ordered by a hash of their text; an empty table writes no
segments and an empty dictionary; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_path
from .tokens import encoder, portions

END_ID = 2
SEGMENT = 4 << 20
DICT_BYTES = 64 << 10
#: Bounds of the sample that the dictionary is trained on: documents, and ids in a row from
#: anywhere in each.
DICT_DOCS, DICT_IDS = 1000, 2048
LEVEL = 3
_FIELDS = (
    "shard long, segment long, shard_start long, first_id long, last_id long, dict_hash string, width int, "
    "doc_ids array<long>, offsets array<long>, n_tokens array<long>, payload binary"
)


def _pack(raw: bytes, width: int) -> bytes:
    return raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, keeps_blanks: bool, width: int) -> bytes:
    """A dictionary from a bounded sample of rows (doc_id, text, h): those of smallest hash.

    Hashes are chosen first, so texts of other documents never leave their partition.
    """
    own = docs.select(F.xxhash64("doc_id", "h").alias("key"), "text")
    keys = sorted({r.key for r in own.select("key").orderBy("key").limit(DICT_DOCS).collect()})
    sample = own.where(F.col("key").isin(keys)).groupBy("key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, keeps_blanks)
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, texts in portions(b.column(1).to_pylist()):
                spans = []
                for key, raw in zip(keys[first:], enc.many(texts), strict=False):
                    at = key % max(1, len(raw) // 4 - DICT_IDS + 1)  # anywhere in the array
                    spans.append(_pack(raw[4 * at : 4 * (at + DICT_IDS)], width))
                yield pa.RecordBatch.from_arrays([pa.array(spans, pa.binary())], names=["x"])

    parts = sorted(bytes(r.x) for r in sample.mapInArrow(run, "x binary").collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, [p for p in parts if len(p) >= 8]).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b""


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, keeps_blanks: bool = False, end_id: int = END_ID, vocab_size: int = 49408
) -> None:
    """Encode docs (doc_id, text) and write them to ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    width = 2 if max(vocab_size, end_id + 1) <= 65536 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    raw_dict = train_dictionary(docs, vocabulary, keeps_blanks, width)
    digest = hashlib.sha256(raw_dict).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw_dict))], "dict_hash string, dictionary binary").write.parquet(
        f"{path}/dictionary"
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, keeps_blanks)
        own = zstandard.ZstdCompressionDict(raw_dict) if raw_dict else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
        shard = TaskContext.get().partitionId()
        segment = done = 0
        ids: list = []
        frames: list[bytes] = []
        sizes: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames])))
            row = [shard, segment, done, min(known, default=None), max(known, default=None), digest, width]
            row += [ids, offsets.tolist(), sizes, b"".join(frames)]
            kinds = [*[pa.int64()] * 5, pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = [x.split()[0] for x in _FIELDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            docs_of = b.column(0).to_pylist()
            for start, texts in portions(b.column(1).to_pylist()):
                for doc, raw in zip(docs_of[start:], enc.many(texts), strict=False):
                    raw += end
                    ids.append(doc)
                    frames.append(press.compress(_pack(raw, width)))
                    sizes.append(len(raw) // 4)
                    held += len(frames[-1])
                    if held >= SEGMENT:
                        yield flush()
                        segment, done = segment + 1, done + sum(sizes)
                        ids, frames, sizes, held = [], [], [], 0
        if ids:
            yield flush()

    # the text's hash, so that rows of one id need not meet in one shard
    ordered = docs.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(run, _FIELDS).write.parquet(f"{path}/segments")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.dict_hash:
        raise ValueError(f"the dictionary of {path} is damaged")
    return row.dict_hash, bytes(row.dictionary)


def _decode(frame: bytes, press: zstandard.ZstdDecompressor, width: int) -> np.ndarray:
    return np.frombuffer(press.decompress(frame), "<u2" if width == 2 else "<u4").astype("<u4")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary) of every document, from the files.

    Without ``with_ids`` the ids are read and summed alike, but not handed to Spark.
    """
    digest, raw = _dictionary(spark, path)
    table = spark.read.schema(_FIELDS).parquet(f"{path}/segments")
    totals = (
        table.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
        .groupBy("shard").agg(F.sum("n").alias("n")).collect()
    )  # one row a shard
    base, before = {}, 0
    for r in sorted(totals):
        base[r.shard] = before
        before += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError("a segment needs another dictionary")
                o, sizes = r["offsets"], r["n_tokens"]
                ids = [_decode(r["payload"][x:y], press, r["width"]).tobytes() for x, y in zip(o, o[1:], strict=False)]
                starts = base[r["shard"]] + r["shard_start"] + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                columns = [
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(starts.astype(np.int64)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [f.split()[0] for f in fields.split(", ")]
    return table.mapInArrow(run, fields)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document (the first, of repeated rows): one frame is decompressed."""
    _, raw = _dictionary(spark, path)
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long"))
    rows = (
        spark.read.schema(_FIELDS).parquet(f"{path}/segments")
        .where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & (at > 0))
        .select("shard", "segment", "width", F.expr(
            f"substring(payload, int(offsets[int(array_position(doc_ids, {int(doc_id)}L)) - 1]) + 1,"
            f" int(offsets[int(array_position(doc_ids, {int(doc_id)}L))]"
            f" - offsets[int(array_position(doc_ids, {int(doc_id)}L)) - 1]))").alias("frame"))
        .orderBy("shard", "segment").limit(1).collect()
    )
    if not rows:
        return None
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    return _decode(bytes(rows[0].frame), press, rows[0].width).tolist()


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
