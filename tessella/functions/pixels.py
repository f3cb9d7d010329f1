"""Chunk geometry, normalisation and band expansion as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def ceil_div(a: Column, b: Column) -> Column:
    return F.call_function("div", (a + b - 1).cast("long"), b.cast("long"))


def chunk_of(x: Column, y: Column, chunk_w: Column, chunk_h: Column, across: Column) -> Column:
    return F.floor(y / chunk_h).cast("long") * across + F.floor(x / chunk_w).cast("long")


def chunk_size(col: Column, chunk: Column, total: Column) -> Column:
    """Columns (or rows) of data in a chunk: those at the far edge are clipped."""
    return F.least(chunk, total - col * chunk)


def normalise(v: Column, least: Column, most: Column) -> Column:
    """A sample stretched to 0..255 between the finite extremes of its chunk.

    Not-a-number and minus infinity give 0, plus infinity 255; without a range all is 0.
    """
    span = most - least
    share = F.least(F.greatest((v - least) / span, F.lit(0.0)), F.lit(1.0))
    flat = least.isNull() | (F.abs(span) < EPSILON) | F.isnan(v) | v.isNull()
    return F.when(flat, 0).otherwise(F.round(share * 255.0).cast("int"))


def finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def expand(bands: Column, stride: Column) -> list[Column]:
    """Red, green, blue and alpha of a pixel's bands; a fifth band is ignored."""
    b = [F.get(bands, F.lit(i)) for i in range(4)]
    r = F.when(stride == 0, 0).otherwise(b[0])
    g = F.when(stride == 0, 0).when(stride < 3, b[0]).otherwise(b[1])
    blue = F.when(stride == 0, 0).when(stride < 3, b[0]).otherwise(b[2])
    a = F.when(stride == 0, 0).when(stride == 2, b[1]).when(stride >= 4, b[3]).otherwise(255)
    return [r, g, blue, a]
