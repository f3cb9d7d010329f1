"""Which tiles of the pyramid which sources cover.

The overlap join is not a nested loop: every footprint is exploded into the grid cells
that it can touch at each zoom (one more on each side, as closed boxes that touch count)
and the exact predicate is checked on those rows. Work grows with covered tiles, and a
tile or source is never compared with all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as T

BOX = ["min_x", "min_y", "max_x", "max_y"]


def extent(footprints: DataFrame) -> DataFrame:
    """The box around all footprints; parts that are no number have no say."""
    own = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in BOX]
    return footprints.select(*own).agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")
    )


def zoom_range(box: DataFrame, min_zoom: int | None = None, max_zoom: int | None = None) -> DataFrame:
    """box with min_zoom and max_zoom: automatic from the larger side, and three more."""
    need = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    low = T.auto_zoom(need) if min_zoom is None else F.lit(min_zoom)
    d = box.withColumn("min_zoom", low)
    high = F.least(F.col("min_zoom") + 3, F.lit(T.ZOOM_MAX)) if max_zoom is None else F.lit(max_zoom)
    return d.withColumn("max_zoom", high)


def grid_ranges(ranges: DataFrame) -> DataFrame:
    """One row per zoom of a box with min_zoom and max_zoom: x0, x1, y0, y1, n_cells."""
    z = F.col("z")
    d = ranges.withColumn("z", F.explode(F.sequence("min_zoom", "max_zoom")))
    d = d.select(
        "z", T.tile_x(F.col("min_x"), z).alias("x0"), T.tile_x(F.col("max_x"), z).alias("x1"),
        T.tile_y(F.col("max_y"), z).alias("y0"), T.tile_y(F.col("min_y"), z).alias("y1"),
    )
    return d.withColumn("n_cells", (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))


def tile_sources(footprints: DataFrame, ranges: DataFrame, key: str = "source_idx") -> DataFrame:
    """(z, x, y, key): every source whose box overlaps a tile of the union's range.

    ``ranges`` is the one-row result of ``zoom_range``; it is broadcast.
    """
    z = F.col("z")
    grid = F.broadcast(grid_ranges(ranges))  # a row per zoom, 32 at most
    last = T.tiles_across(z).cast("long") - 1
    d = footprints.select(key, *BOX).join(grid, F.col("x0") <= last)
    low = lambda v, edge: F.greatest(v - 1, F.col(edge))
    high = lambda v, edge: F.least(v + 1, F.col(edge))
    d = d.select(
        key, *BOX, "z",
        low(T.tile_x(F.col("min_x"), z), "x0").alias("a0"), high(T.tile_x(F.col("max_x"), z), "x1").alias("a1"),
        low(T.tile_y(F.col("max_y"), z), "y0").alias("b0"), high(T.tile_y(F.col("min_y"), z), "y1").alias("b1"),
    ).where("a0 <= a1 and b0 <= b1")
    d = d.withColumn("x", F.explode(F.sequence("a0", "a1"))).withColumn("y", F.explode(F.sequence("b0", "b1")))
    box = {c: F.col(c) for c in BOX}
    return d.where(T.overlaps(T.tile_bounds(z, F.col("x"), F.col("y")), box)).select("z", "x", "y", key)


def coverage_by_zoom(footprints: DataFrame, ranges: DataFrame, key: str = "source_idx") -> DataFrame:
    """(z, n_cells, n_kept, n_empty, n_pairs) per zoom."""
    pairs = tile_sources(footprints, ranges, key)
    kept = pairs.groupBy("z", "x", "y").count().groupBy("z").agg(F.count("*").alias("n_kept"), F.sum("count").alias("n_pairs"))
    out = grid_ranges(ranges).select("z", "n_cells").join(F.broadcast(kept), "z", "left").na.fill(0)
    return out.select("z", "n_cells", "n_kept", (F.col("n_cells") - F.col("n_kept")).alias("n_empty"), "n_pairs")


def tile_jobs(tiles: DataFrame, max_zoom: int) -> DataFrame:
    """tiles (z, x, y) with tile_id (write order) and locality_key (render order)."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    return tiles.withColumn("tile_id", T.hilbert_tile_id(z, x, y)).withColumn("locality_key", T.locality_key(z, x, y, max_zoom))


def dense_ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the position of each row in an order, from 0, without a single-task sort:
    rows are dealt by range, numbered in their partition, and shifted by the sizes of the
    partitions before (one number a partition on the driver). ``order`` must be total."""
    ranged = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).persist()
    sizes = {r["_pid"]: r["count"] for r in ranged.groupBy("_pid").count().collect()}
    shifts, before = [], 0
    for pid in range(max(sizes, default=-1) + 1):
        shifts.append(before)
        before += sizes.get(pid, 0)
    shift = F.get(F.array(*map(F.lit, shifts)), F.col("_pid")) if shifts else F.lit(0)
    w = Window.partitionBy("_pid").orderBy(*order)
    return ranged.withColumn(name, (F.row_number().over(w) - 1 + shift).cast("long")).drop("_pid")


def progress_marks(df: DataFrame, ordinal: str) -> DataFrame:
    """(percent, written, total): where the share of rows done, in the order of their ordinal
    from 0, reaches another tenth. One row a tenth at most, found without a global order."""
    total = df.agg(F.count("*").alias("total"))
    k = F.col(ordinal) + 1
    d = df.select(k.alias("written")).join(F.broadcast(total))  # one row
    d = d.withColumn("percent", F.expr("written * 100 div total"))
    first = d.groupBy(F.expr("percent div 10").alias("tenth")).agg(F.min(F.struct("written", "percent", "total")).alias("m"))
    return first.where("tenth > 0").select("m.percent", "m.written", "m.total")
