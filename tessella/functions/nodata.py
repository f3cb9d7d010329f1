"""Nodata values: one grey level or one colour, parsed, matched and agreed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .georef import parse_number


def level(text: Column) -> Column:
    """A whole number from 0 to 255, also written as a decimal; else null."""
    v = parse_number(text)
    return F.when((v >= 0) & (v <= 255) & (v % 1 == 0), v.cast("int"))


def parse(text: Column) -> Column:
    """struct(kind, r, g, b); kind is null for a blank text and 'error' for a bad one."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda p: p != "")
    v = [level(F.get(parts, F.lit(i))) for i in range(3)]
    n = F.size(parts)
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    grey = (n == 1) & v[0].isNotNull()
    colour = (n == 3) & v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull()
    kind = F.when(blank, F.lit(None).cast("string")).when(grey, "gray").when(colour, "rgb").otherwise("error")
    r = F.when(grey | colour, v[0])
    g = F.when(grey, v[0]).when(colour, v[1])
    b = F.when(grey, v[0]).when(colour, v[2])
    return F.struct(kind.alias("kind"), r.alias("r"), g.alias("g"), b.alias("b"))


def matches(r: Column, g: Column, b: Column, spec: tuple[int, int, int] | None) -> Column:
    """Alpha plays no part."""
    if spec is None:
        return F.lit(False)
    return (r == spec[0]) & (g == spec[1]) & (b == spec[2])


def consensus(tags: DataFrame, column: str = "gdal_nodata") -> DataFrame:
    """One row: n_values different parsed values, and the value if it is the only one.

    Blank and unreadable tags have no vote; a grey and an equal colour are two values.
    """
    p = tags.select(parse(F.col(column)).alias("p")).where("p.kind in ('gray', 'rgb')")
    votes = F.collect_set(F.struct("p.kind", "p.r", "p.g", "p.b"))  # 2 * 256^3 values at most, a few in practice
    return p.agg(votes.alias("v")).select(
        F.size("v").alias("n_values"), F.when(F.size("v") == 1, F.get("v", F.lit(0))).alias("spec")
    )
