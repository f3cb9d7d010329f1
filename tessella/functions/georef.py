"""Georeferencing as columns: transforms, world files, geokeys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Geokey ids, the "user defined" code, world-file endings by priority.
PROJECTED_KEY, GEOGRAPHIC_KEY, RASTER_TYPE_KEY = 3072, 2048, 1025
UNSET_CODES = [0, 32767]
PIXEL_IS_POINT = 2
WORLD_FILE_ENDINGS = [".tfw", ".TFW", ".tifw", ".TIFW"]
SINGULAR = 1e-15


def affine_apply(p: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """p = a, b, c, d, e, f with x' = a x + b y + c and y' = d x + e y + f."""
    a, b, c, d, e, f = p
    return a * x + b * y + c, d * x + e * y + f


def affine_invert(p: list[Column]) -> list[Column]:
    """Inverse parameters, null where the determinant vanishes."""
    a, b, c, d, e, f = p
    det = a * e - b * d
    good = F.when(F.abs(det) >= SINGULAR, det)
    return [e / good, -b / good, (b * f - e * c) / good, -d / good, a / good, (d * c - a * f) / good]


def tiepoint_apply(p: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """p = raster x, y, model x, y, scale x, y; rows run against the model's y."""
    rx, ry, mx, my, sx, sy = p
    return (x - rx) * sx + mx, (y - ry) * -sy + my


def tiepoint_invert(p: list[Column]) -> list[Column]:
    rx, ry, mx, my, sx, sy = p
    good = (sx != 0) & (sy != 0)
    return [F.when(good, v) for v in (mx, my, rx, ry, F.lit(1.0) / sx, F.lit(1.0) / sy)]


def geokey(directory: Column, key: int) -> Column:
    """The first inline short of a key: entries of four words after the header's count."""
    count = F.get(directory, F.lit(3))
    room = F.floor(F.size(directory) / 4) - 1
    last = F.greatest(room, F.lit(1)).cast("int")  # a sequence needs an end that is not before its start
    entries = F.filter(F.sequence(F.lit(1), last), lambda i: (i <= count) & (i <= room))
    hits = F.filter(
        entries,
        lambda i: (F.get(directory, i * 4) == key) & (F.get(directory, i * 4 + 1) == 0) & (F.get(directory, i * 4 + 2) == 1),
    )
    return F.get(directory, F.get(hits, F.lit(0)) * 4 + 3)


def epsg(directory: Column) -> Column:
    """The projected code, else the geographic one; null if neither is set."""
    found = [F.when(~geokey(directory, k).isin(UNSET_CODES), geokey(directory, k)) for k in (PROJECTED_KEY, GEOGRAPHIC_KEY)]
    return F.coalesce(*found)


def raster_offset(from_world_file: Column, raster_type: Column) -> Column:
    return F.when(from_world_file | (F.coalesce(raster_type, F.lit(0)) == PIXEL_IS_POINT), -0.5).otherwise(0.0)


#: A plain decimal number: no type suffix, no words.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def world_file(text: Column) -> Column:
    """The affine parameters of a world file (lines A, D, B, E, C, F); null if malformed."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(lines, parse_number)
    pick = F.array(*(F.get(numbers, F.lit(i)) for i in (0, 2, 4, 1, 3, 5)))
    return F.when((F.size(numbers) == 6) & F.forall(numbers, lambda v: v.isNotNull()), pick)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t
