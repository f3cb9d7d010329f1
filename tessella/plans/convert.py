"""The whole job: rasters in, one tile archive out.

    files -> headers -> footprints -> zooms -> tile x source pairs -> chunks needed
          -> decoded chunks -> rendered tiles -> encoded tiles in archive order

Headers are one row per file and are collected; all else stays distributed. Chunks are
decoded once per run. Tiles are dealt by a prefix of their locality key, in batches of up
to 256 tiles of the finest zoom and those above them; a chunk is sent once to each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import nodata as N
from ..functions import tiles as T
from ..operators import chunks, coverage, render
from ..sources import archive, tiff
from ..sources.paths import resolve_inputs


#: Low bits of a locality key that a batch leaves free: two for the half tile by which keys
#: are shifted, and eight for the 256 tiles of the finest zoom.
BATCH_BITS = 10


@dataclass(frozen=True)
class Options:
    """The command's options; see ``cli``."""

    src_crs: str | None = None
    nodata: str | None = None
    min_zoom: int | None = None
    max_zoom: int | None = None
    resampling: str = "bilinear"
    quality: int = 55
    speed: int = 4

    def __post_init__(self):
        if self.resampling not in ("nearest", "bilinear"):
            raise ValueError("resampling must be nearest or bilinear")
        if not 1 <= self.quality <= 100 or not 1 <= self.speed <= 10:
            raise ValueError("quality must be in 1..100 and speed in 1..10")
        for z in (self.min_zoom, self.max_zoom):
            if z is not None and not 0 <= z <= T.ZOOM_MAX:
                raise ValueError(f"zooms must be in 0..{T.ZOOM_MAX}, got {z}")
        if self.min_zoom is not None and self.max_zoom is not None and self.max_zoom < self.min_zoom:
            raise ValueError("max_zoom must not be below min_zoom")


_SOURCE = (
    "path string, width long, height long, chunk_w long, chunk_h long, crs string, kind string, p array<double>, "
    "raster_offset double, gdal_nodata string"
)


def _local(path: str) -> str:
    return path.removeprefix("file:")


def read_sources(spark: SparkSession, paths: list[str], src_crs: str | None) -> DataFrame:
    """One row per file, by one task per file; the first error ends the run."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part.path, part.content, strict=True):
                try:
                    h = tiff.read_header(content)
                    g = tiff.georeference(h, _local(path), src_crs)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                row = (path, h.width, h.height, h.layout.chunk_w, h.layout.chunk_h, g["crs"], g["kind"], g["p"], g["raster_offset"], h.nodata)
                yield pd.DataFrame([row], columns=[x.split()[0] for x in _SOURCE.split(", ")])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, _SOURCE)


def _apply(kind: str, p, x, y):
    if kind == "affine":
        return p[0] * x + p[1] * y + p[2], p[3] * x + p[4] * y + p[5]
    return (x - p[0]) * p[4] + p[2], (y - p[1]) * -p[5] + p[3]


def _inverse(kind: str, p) -> tuple[str, list[float]] | None:
    if kind == "affine":
        det = p[0] * p[4] - p[1] * p[3]
        if abs(det) < 1e-15:
            return None
        a, b, c, d, e, f = p
        return kind, [e / det, -b / det, (b * f - e * c) / det, -d / det, a / det, (d * c - a * f) / det]
    if p[4] == 0 or p[5] == 0:
        return None
    return kind, [p[2], p[3], p[0], p[1], 1 / p[4], 1 / p[5]]


def footprint(source) -> tuple[float, float, float, float]:
    """The source's box in Web Mercator, from its four corners."""
    x = np.array([0.0, source.width, source.width, 0.0]) + source.raster_offset
    y = np.array([0.0, 0.0, source.height, source.height]) + source.raster_offset
    mx, my = C.transform(source.crs, "EPSG:3857", *_apply(source.kind, source.p, x, y))
    good = np.isfinite(mx) & np.isfinite(my)
    if not good.any():
        return (float("nan"),) * 4
    return float(mx[good].min()), float(my[good].min()), float(mx[good].max()), float(my[good].max())


def tile_corners(source, z: int, x: int, y: int) -> np.ndarray | None:
    """Raster coordinates of a tile's corners UL, UR, LR, LL; None if they can't be had."""
    size = 2 * T.ORIGIN / 2**z
    min_x, max_y = x * size - T.ORIGIN, T.ORIGIN - y * size
    xs = np.array([min_x, min_x + size, min_x + size, min_x])
    ys = np.array([max_y, max_y, max_y - size, max_y - size])
    inverse = _inverse(source.kind, source.p)
    if inverse is None:
        return None
    out = np.stack(_apply(*inverse, *C.transform("EPSG:3857", source.crs, xs, ys)), axis=1)
    return out if np.isfinite(out).all() else None


def agreed_nodata(option: str | None, sources: DataFrame) -> tuple[int, int, int] | None:
    """The option's value, else the one value that the files' tags agree on."""
    spark = sources.sparkSession
    if option is not None:
        p = spark.range(1).select(N.parse(F.lit(option)).alias("p")).first().p
        if p.kind == "error":
            raise ValueError(f"invalid nodata value {option!r}")
        return None if p.kind is None else (p.r, p.g, p.b)
    row = N.consensus(sources).first()
    if row.n_values > 1:
        raise ValueError("the files' nodata values differ; give one with --nodata")
    return (row.spec.r, row.spec.g, row.spec.b) if row.n_values else None


def render_tiles(spark: SparkSession, sources: list, pairs: DataFrame, resampling: str, nodata, max_zoom: int) -> DataFrame:
    """(z, x, y, tile_id, rgba) of every tile that is not wholly transparent."""
    meta = spark.sparkContext.broadcast(sources)  # one row a file

    fields = "z int, x long, y long, source_idx int, x0 double, y0 double, x1 double, y1 double, w long, h long, cw long, ch long, across long"

    def boxes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for z, x, y, s in part.itertuples(index=False):
                m = meta.value[s]
                corners = tile_corners(m, z, x, y)
                if corners is not None:
                    lay = render.Layout(m.width, m.height, m.chunk_w, m.chunk_h)
                    out.append((z, x, y, s, *corners.min(axis=0), *corners.max(axis=0), m.width, m.height, m.chunk_w, m.chunk_h, lay.across))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")])

    wanted = chunks.chunks_under(pairs.select("z", "x", "y", "source_idx").mapInPandas(boxes, fields))
    key = T.locality_key(F.col("z"), F.col("x"), F.col("y"), max_zoom)
    wanted = wanted.select("z", "x", "y", "source_idx", "chunk_idx", F.shiftright(key, BATCH_BITS).alias("batch"))
    files = spark.createDataFrame([(k, s.path) for k, s in enumerate(sources)], "source_idx int, path string")
    per_file = chunks.chunk_lists(wanted)
    content = spark.read.format("binaryFile").load([s.path for s in sources]).select("path", "content")

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s, needed, data in part.itertuples(index=False):
                head = tiff.read_header(data)
                for c in needed:
                    px = tiff.read_chunk(data, head, int(c))
                    yield pd.DataFrame([(s, c, px.shape[0], px.shape[1], px.tobytes())], columns=["source_idx", "chunk_idx", "h", "w", "px"])

    decoded = content.join(files, "path").join(per_file, "source_idx").select("source_idx", "chunks", "content")
    decoded = decoded.mapInPandas(decode, "source_idx int, chunk_idx long, h int, w int, px binary")
    sent = wanted.select("batch", "source_idx", "chunk_idx").distinct().join(decoded, ["source_idx", "chunk_idx"])

    def draw(key: tuple, part: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        px = {(r.source_idx, r.chunk_idx): np.frombuffer(r.px, np.uint8).reshape(r.h, r.w, 4) for r in part.itertuples()}
        rows = []
        for (z, x, y), own_tile in tiles.groupby(["t_z", "t_x", "t_y"]):
            selected = []
            for s, needed in own_tile.groupby("t_source_idx"):
                m = meta.value[s]
                own = render.Source(render.Layout(m.width, m.height, m.chunk_w, m.chunk_h))
                own.chunks.update({c: px[s, c] for c in needed.t_chunk_idx})
                selected.append((own, tile_corners(m, z, x, y)))
            out = (render.nearest if resampling == "nearest" else render.bilinear)(selected, nodata)
            if out[..., 3].any():
                rows.append((z, x, y, out.tobytes()))
        return pd.DataFrame(rows, columns=["z", "x", "y", "rgba"])

    # under other names, as both sides come from the same rows
    tiles = wanted.toDF(*(f"t_{c}" for c in wanted.columns))
    drawn = sent.groupBy("batch").cogroup(tiles.groupBy("t_batch")).applyInPandas(draw, "z int, x long, y long, rgba binary")
    return coverage.tile_jobs(drawn, max_zoom).drop("locality_key")


def reported(items: Iterator, total: int, say: Callable[[str], None]) -> Iterator:
    """The items, with a message whenever another tenth of them is done."""
    tenth = 0
    for k, item in enumerate(items, 1):
        yield item
        percent = 100 * k // max(total, 1)
        if percent // 10 > tenth:
            tenth = percent // 10
            say(f"{percent}% ({k}/{total})")


def convert(
    spark: SparkSession, inputs: list[str], output: str, options: Options = Options(), say: Callable[[str], None] = lambda _: None  # noqa: B008
) -> DataFrame:
    """Write the archive; returns (z, n_cells, n_kept, n_empty, n_pairs, n_written). Progress
    is told to ``say``."""
    paths = resolve_inputs(inputs)
    table = read_sources(spark, paths, options.src_crs)
    sources = sorted(table.collect(), key=lambda r: _local(r.path))
    kept = spark.createDataFrame([tuple(r) for r in sources], _SOURCE)
    nodata = agreed_nodata(options.nodata, kept)
    boxes = [(k, *footprint(s)) for k, s in enumerate(sources)]
    prints = spark.createDataFrame(boxes, "source_idx int, min_x double, min_y double, max_x double, max_y double")
    ranges = coverage.zoom_range(coverage.extent(prints), options.min_zoom, options.max_zoom)
    row = ranges.first()
    Options(min_zoom=row.min_zoom, max_zoom=row.max_zoom)
    pairs = coverage.tile_sources(prints, ranges)
    tiles = render_tiles(spark, sources, pairs, options.resampling, nodata, row.max_zoom)
    kind, encode = archive.encoder(options.quality, options.speed)
    size = render.SIZE

    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"z": part.z, "tile_id": part.tile_id, "data": [encode(r, size) for r in part.rgba]})

    done = tiles.mapInPandas(encoded, "z int, tile_id long, data binary").persist()
    lon, lat = C.to_lonlat("EPSG:3857", [row.min_x, row.max_x], [row.min_y, row.max_y])
    ordered = done.repartitionByRange("tile_id").sortWithinPartitions("tile_id")
    per_zoom = coverage.coverage_by_zoom(prints, ranges).orderBy("z").collect()
    for r in per_zoom:
        if r.n_empty:
            say(f"z={r.z}: skipped {r.n_empty} empty tile(s)")
        say(f"z={r.z}: rendering {r.n_kept} tile(s)")
    written = {r.z: r["count"] for r in done.groupBy("z").count().collect()}
    stream = ((r.tile_id, bytes(r.data)) for r in ordered.toLocalIterator())
    archive.write_archive(output, reported(stream, sum(written.values()), say), kind, (row.min_zoom, row.max_zoom), (lon[0], lat[0], lon[1], lat[1]))
    done.unpersist()
    report = [(*r, written.get(r.z, 0)) for r in per_zoom]
    return spark.createDataFrame(report, "z int, n_cells long, n_kept long, n_empty long, n_pairs long, n_written long")
