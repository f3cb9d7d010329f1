"""Chunks that boxes in raster space need, and the lists to read them by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks_under(boxes: DataFrame) -> DataFrame:
    """A row with chunk_idx for each chunk under a box x0, y0, x1, y1, one pixel wider on
    each side and clipped to the raster (w, h, cw, ch, across). Boxes beside the raster and
    boxes that are not finite give none."""
    col = F.col
    edges = [col(c) for c in ("x0", "y0", "x1", "y1")]
    finite = F.lit(True)
    for e in edges:
        finite = finite & e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    d = boxes.where(finite)
    d = d.where((col("x1") + 1 >= 0) & (col("y1") + 1 >= 0) & (col("x0") - 1 < col("w")) & (col("y0") - 1 < col("h")))

    def low(v: str, c: str):
        return F.floor(F.greatest(F.floor(v) - 1, F.lit(0)) / col(c)).cast("long")

    def high(v: str, n: str, c: str):
        return F.floor(F.least(F.ceil(v) + 1, col(n) - 1) / col(c)).cast("long")

    d = d.withColumn("cx", F.explode(F.sequence(low("x0", "cw"), high("x1", "w", "cw"))))
    d = d.withColumn("cy", F.explode(F.sequence(low("y0", "ch"), high("y1", "h", "ch"))))
    return d.withColumn("chunk_idx", col("cy") * col("across") + col("cx")).drop("cx", "cy")


def chunk_lists(needs: DataFrame) -> DataFrame:
    """(source_idx, chunks): the different chunks to read of each source, ascending."""
    own = needs.select("source_idx", "chunk_idx").distinct()
    return own.groupBy("source_idx").agg(F.sort_array(F.collect_list("chunk_idx")).alias("chunks"))
