"""Command line: python -m tessella.cli INPUT... -o out.pmtiles"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description="Georeferenced rasters to one tile archive.")
    p.add_argument("input", nargs="+", help="paths or glob patterns")
    p.add_argument("-o", "--output", default="out.pmtiles")
    p.add_argument("--src-crs", help="reference system of files that name none")
    p.add_argument("--nodata", help="a grey level, or R,G,B")
    p.add_argument("--min-zoom", type=int)
    p.add_argument("--max-zoom", type=int)
    p.add_argument("--resampling", choices=["nearest", "bilinear"], default="bilinear")
    p.add_argument("--quality", type=int, default=55)
    p.add_argument("--speed", type=int, default=4)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans.convert import Options, convert

    try:
        options = Options(a.src_crs, a.nodata, a.min_zoom, a.max_zoom, a.resampling, a.quality, a.speed)
        spark = SparkSession.builder.appName("tessella").getOrCreate()
        for r in convert(spark, a.input, a.output, options, print).orderBy("z").collect():
            print(f"z{r.z}: {r.n_written} written, {r.n_empty} empty, {r.n_kept - r.n_written} transparent")
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
