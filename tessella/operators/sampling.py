"""Nearest and bilinear sampling over a table of pixels, as joins and aggregates.

points: (point columns..., source_idx, px, py) with px, py in a source's pixel units;
pixels: (source_idx, x, y, r, g, b, a). Each point looks at the four pixels around it by
one equi-join on (source_idx, x, y); missing, and nodata, pixels are not valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nodata import matches

BANDS = ["r", "g", "b", "a"]
EPSILON = 2.220446049250313e-16
#: Fixed order of the four neighbours: it breaks ties.
CORNERS = [(0, 0), (1, 0), (0, 1), (1, 1)]


def neighbours(points: DataFrame, pixels: DataFrame, nodata: tuple[int, int, int] | None = None) -> DataFrame:
    """points with ordinal k (0..3), nx, ny and the bands of each valid neighbour."""
    x0, y0 = F.floor("px").cast("long"), F.floor("py").cast("long")
    four = F.array(*(
        F.struct(F.lit(k).alias("k"), (x0 + i).alias("nx"), (y0 + j).alias("ny"))
        for k, (i, j) in enumerate(CORNERS)
    ))
    d = points.withColumn("_n", F.explode(four)).select("*", "_n.*").drop("_n")
    px = pixels.select("source_idx", F.col("x").alias("nx"), F.col("y").alias("ny"), *BANDS)
    return d.join(px, ["source_idx", "nx", "ny"]).where(~matches(F.col("r"), F.col("g"), F.col("b"), nodata))


def nearest(points: DataFrame, pixels: DataFrame, keys: list[str], nodata: tuple[int, int, int] | None = None) -> DataFrame:
    """keys and the bands of the nearest valid neighbour over all sources of a point.

    Distances are in each source's own pixels; of equal ones the earlier source wins,
    then the earlier neighbour. Points without a valid neighbour are absent.
    """
    d = neighbours(points, pixels, nodata)
    dx, dy = F.col("px") - F.col("nx"), F.col("py") - F.col("ny")
    rank = F.struct((dx * dx + dy * dy).alias("d2"), F.col("source_idx"), F.col("k"))
    best = d.groupBy(*keys).agg(F.min_by(F.struct("source_idx", *BANDS), rank).alias("p"))
    return best.select(*keys, "p.*")


def _weighted(col: str, weight: list[Column]) -> Column:
    """The four terms in fixed order, missing ones left out."""
    total: Column = F.lit(0.0)
    for k in range(4):
        total = total + F.coalesce(F.col(f"{col}{k}") * weight[k], F.lit(0.0))
    return total


def bilinear(points: DataFrame, pixels: DataFrame, keys: list[str], nodata: tuple[int, int, int] | None = None) -> DataFrame:
    """keys and the weighted mean of the valid neighbours of the first source that has any."""
    d = neighbours(points, pixels, nodata)
    aggs = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(4) for c in BANDS]
    d = d.groupBy(*keys, "source_idx", "px", "py").agg(*aggs)
    tx, ty = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    weight = [(1 - tx) * (1 - ty), tx * (1 - ty), (1 - tx) * ty, tx * ty]
    there = [F.when(F.col(f"r{k}").isNotNull(), weight[k]) for k in range(4)]
    total: Column = F.lit(0.0)
    for w in there:
        total = total + F.coalesce(w, F.lit(0.0))
    d = d.withColumn("_w", total).where(F.col("_w") > EPSILON)
    value = lambda c: F.least(F.greatest(F.round(_weighted(c, weight) / F.col("_w")), F.lit(0.0)), F.lit(255.0)).cast("int")
    d = d.select(*keys, "source_idx", *(value(c).alias(c) for c in BANDS))
    first = d.groupBy(*keys).agg(F.min_by(F.struct("source_idx", *BANDS), F.col("source_idx")).alias("p"))
    return first.select(*keys, "p.*")
