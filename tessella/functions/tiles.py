"""Web Mercator tile arithmetic as columns: indexes, bounds, orders, zoom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the tiling scheme.
ORIGIN = 20037508.342789244
EPSILON = 2.220446049250313e-16
AUTO_ZOOM_MAX = 24
ZOOM_MAX = 31
TILE_SIZE = 256


def lon_to_x(lon: Column) -> Column:
    return lon * (ORIGIN / 180.0)


def lat_to_y(lat: Column) -> Column:
    return F.log(F.tan((90.0 + lat) * F.lit(3.141592653589793 / 360.0))) * F.lit(ORIGIN / 3.141592653589793)


def x_to_lon(x: Column) -> Column:
    return x * (180.0 / ORIGIN)


def y_to_lat(y: Column) -> Column:
    return F.atan(F.exp(y * (3.141592653589793 / ORIGIN))) * (360.0 / 3.141592653589793) - 90.0


def tiles_across(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def _index(share: Column, z: Column) -> Column:
    inside = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0 - EPSILON))
    return F.floor(inside * tiles_across(z)).cast("long")


def tile_x(x: Column, z: Column) -> Column:
    """Column index; the world's edge belongs to the last tile."""
    return _index((x + ORIGIN) / (2.0 * ORIGIN), z)


def tile_y(y: Column, z: Column) -> Column:
    return _index((F.lit(ORIGIN) - y) / (2.0 * ORIGIN), z)


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """min_x, min_y, max_x, max_y; the far edges are the near ones plus the size."""
    size = F.lit(2.0 * ORIGIN) / tiles_across(z)
    min_x, max_y = x * size - ORIGIN, F.lit(ORIGIN) - y * size
    return {"min_x": min_x, "min_y": max_y - size, "max_x": min_x + size, "max_y": max_y}


def spread_bits(v: Column) -> Column:
    """The low 32 bits at the even positions of 64 bits."""
    x = v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x: Column, y: Column) -> Column:
    return spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1))


def locality_key(z: Column, x: Column, y: Column, max_zoom: int) -> Column:
    """Morton key of the tile's centre in half cells of the finest zoom."""
    shift = (F.lit(max_zoom) - z).cast("int")
    half = lambda v: F.call_function("shiftleft", F.call_function("shiftleft", v.cast("long"), shift), F.lit(1)).bitwiseOR(F.lit(1).cast("long"))
    return morton(half(x), half(y))


def hilbert_tile_id(z: Column, x: Column, y: Column) -> Column:
    """Position in the archive's order: all coarser tiles, then the Hilbert curve."""
    bits = F.filter(F.sequence(F.lit(ZOOM_MAX), F.lit(0), F.lit(-1)), lambda k: k < z)
    full = F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int")) - 1
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, k: Column) -> Column:
        rx = F.call_function("shiftright", a["x"], k).bitwiseAND(F.lit(1).cast("long"))
        ry = F.call_function("shiftright", a["y"], k).bitwiseAND(F.lit(1).cast("long"))
        d = a["d"] + F.call_function("shiftleft", (rx * 3).bitwiseXOR(ry), k * 2)
        fx = F.when(rx == 1, full - a["x"]).otherwise(a["x"])
        fy = F.when(rx == 1, full - a["y"]).otherwise(a["y"])
        return F.struct(
            F.when(ry == 0, fy).otherwise(a["x"]).alias("x"), F.when(ry == 0, fx).otherwise(a["y"]).alias("y"), d.alias("d")
        )

    on_curve = F.aggregate(bits, start, step)["d"]
    return _exact_third(z) + on_curve


def _exact_third(z: Column) -> Column:
    """(4^z - 1) / 3 in whole numbers."""
    four = F.call_function("shiftleft", F.lit(1).cast("long"), (z * 2).cast("int"))
    return F.call_function("div", four - 1, F.lit(3).cast("long"))


def auto_zoom(need: Column) -> Column:
    """The finest zoom up to 24 whose tile edge still covers ``need``; 0 if none does."""
    zooms = F.sequence(F.lit(0), F.lit(AUTO_ZOOM_MAX))
    wide = F.filter(zooms, lambda z: F.lit(2.0 * ORIGIN) / F.pow(F.lit(2.0), z) >= need)
    return F.coalesce(F.array_max(wide), F.lit(0))


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed boxes that touch count; a null box overlaps nothing."""
    return (
        (a["max_x"] >= b["min_x"]) & (a["min_x"] <= b["max_x"]) & (a["max_y"] >= b["min_y"]) & (a["min_y"] <= b["max_y"])
    )
