"""Helpers shared by the operators: checkpoints, word splitting, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


#: Folders written by ``store`` in this process and not yet deleted.
_STORED: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Set a checkpoint folder where the session names none: only a session without other
    machines (tests) gets a temporary one, as executors of a cluster would not see it."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is None and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-ckpt-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, for Spark's writers."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: like ``cut``, in columns."""
    path = shared_path(df.sparkSession, name)
    _STORED.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path in _STORED:
            _STORED.remove(path)
            delete(t.sparkSession, path)


def stored() -> list[str]:
    """A mark for ``discard_since``."""
    return list(_STORED)


def discard_since(spark: SparkSession, mark: list[str]) -> None:
    """Delete all that was stored since the mark; its results must have been written."""
    for path in [p for p in _STORED if p not in mark]:
        _STORED.remove(path)
        delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The rows are computed once: they are kept while the checkpoint job writes them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def renamed(docs: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """docs with its columns named _in0, _in1, ... so that no name of theirs clashes, but those
    to keep; and the new names, in the order of the columns."""
    new = [c if c in keep else f"_in{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*new), new


def named_back(df: DataFrame, new: list[str], names: list[str]) -> list[Column]:
    """The columns of ``renamed`` under their own names."""
    return [df[n].alias(c) for n, c in zip(new, names, strict=True)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sql_words(col):
    """Array of words of a text column, in SQL functions; null text has none."""
    parts = F.split(F.coalesce(col, F.lit("")), BLANKS)
    return F.filter(parts, lambda w: w != F.lit(""))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    Each round hangs every node under its smallest neighbour, jumps pointers twice
    and contracts. The edges of a round's forest stay edges of the contracted graph,
    so no link is lost, and the edge list shrinks geometrically.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mapping = None
    while not e.isEmpty():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        parent = cut(parent.select("node", F.least("node", "up").alias("up")))
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        parent = cut(parent)
        if mapping is None:
            mapping = parent.select("node", F.col("up").alias("component"))
        else:
            nxt = parent.select(F.col("node").alias("component"), "up")
            mapping = mapping.join(nxt, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")
            )
        mapping = cut(mapping)
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("pb"))
        e = e.join(left, "a").join(right, "b").where("pa <> pb")
        e = cut(e.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
    if mapping is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping


__all__ = [
    "BLANKS", "connected_components", "cut", "delete", "discard", "discard_since", "ensure_checkpoint_dir", "named_back", "read",
    "renamed", "shared_path", "sql_words", "store", "stored",
]
