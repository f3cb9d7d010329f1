import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import crs, georef, nodata, tiles
from tessella.operators import render
from tessella.plans.convert import Options, convert
from tessella.sources import archive, tiff
from tessella.sources.paths import has_glob_characters, resolve_inputs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_affine_and_tiepoint_round_trips(spark):
    p = [F.lit(float(v)) for v in (2, 1, 10, -1, 3, 20)]
    x, y = georef.affine_apply(georef.affine_invert(p), *georef.affine_apply(p, F.lit(5.0), F.lit(-2.0)))
    assert one(spark, x, y) == pytest.approx((5, -2), abs=1e-9)
    t = [F.lit(float(v)) for v in (100, 200, 1000, 2000, 2, 4)]
    x, y = georef.tiepoint_apply(georef.tiepoint_invert(t), *georef.tiepoint_apply(t, F.lit(110.0), F.lit(210.0)))
    assert one(spark, x, y) == pytest.approx((110, 210), abs=1e-9)


def test_singular_transforms_are_null(spark):
    p = [F.lit(float(v)) for v in (1, 2, 0, 2, 4, 0)]
    t = [F.lit(float(v)) for v in (0, 0, 0, 0, 0, 1)]
    assert set(one(spark, *(v.alias(str(k)) for k, v in enumerate(georef.affine_invert(p) + georef.tiepoint_invert(t))))) == {None}


def test_nodata_match(spark):
    m = lambda px, s: nodata.matches(*map(F.lit, px), s)
    got = one(spark, *(c.alias(str(k)) for k, c in enumerate([m((7, 7, 7), (7,) * 3), m((7, 8, 7), (7,) * 3), m((1, 2, 3), (1, 2, 3)), m((1, 2, 4), (1, 2, 3))])))
    assert tuple(got) == (True, False, True, False)


@pytest.mark.parametrize(
    "text,want",
    [(None, (None, None, None, None)), ("", (None,) * 4), ("   ", (None,) * 4), ("42", ("gray", 42, 42, 42)), (" 1, 2 ,3 ", ("rgb", 1, 2, 3)),
     ("0.0", ("gray", 0, 0, 0)), ("255.0", ("gray", 255, 255, 255)), ("1.0, 2.0, 3.0", ("rgb", 1, 2, 3))]
    + [(t, ("error", None, None, None)) for t in ("1,2", "x", "1,2,300", "-9999", "0.5", "5d", "nan")],
)
def test_nodata_parser(spark, text, want):
    assert tuple(one(spark, nodata.parse(F.lit(text).cast("string")).alias("p")).p) == want


def test_auto_zoom_and_edges(spark):
    world = 2 * tiles.ORIGIN
    got = one(spark, *(tiles.auto_zoom(F.lit(v)).alias(str(k)) for k, v in enumerate([world, world / 2**10, world / 2**11 + 1, world * 2])))
    assert tuple(got) == (0, 10, 10, 0)
    o = tiles.ORIGIN
    got = one(spark, tiles.tile_x(F.lit(-o), F.lit(2)), tiles.tile_y(F.lit(o), F.lit(2)), tiles.tile_x(F.lit(o), F.lit(2)), tiles.tile_y(F.lit(-o), F.lit(2)))
    assert tuple(got) == (0, 0, 3, 3)
    b = tiles.tile_bounds(F.lit(0), F.lit(0), F.lit(0))
    assert tuple(one(spark, *b.values())) == (-o, -o, o, o)


def test_hilbert_is_a_bijection(spark):
    for z in (0, 1, 2, 4):
        n = 1 << z
        d = spark.range(n * n).select((F.col("id") % n).alias("x"), F.expr(f"id div {n}").alias("y"))
        ids = sorted(r[0] for r in d.select(tiles.hilbert_tile_id(F.lit(z), F.col("x"), F.col("y"))).collect())
        assert ids == list(range((4**z - 1) // 3, (4 ** (z + 1) - 1) // 3))


@settings(max_examples=30, deadline=None)
@given(st.floats(-179, 179), st.floats(-80, 80), st.sampled_from(["EPSG:3857", "EPSG:32610", "EPSG:32733", "EPSG:4326"]))
def test_crs_round_trip(lon, lat, code):
    if code[5:7] == "32":
        zone = int(code[-2:])
        lon = 6 * zone - 183 + (lon / 179) * 3
    back = crs.to_lonlat(code, *crs.from_lonlat(code, lon, lat))
    assert np.allclose(back, (lon, lat), atol=1e-7)


def test_utm_known_point():
    x, y = crs.from_lonlat("EPSG:32631", 3.0, 0.0)
    assert (float(x), float(y)) == pytest.approx((500000, 0), abs=1e-6)
    x, y = crs.from_lonlat("EPSG:32631", 3.0, 45.0)
    assert float(y) == pytest.approx(4982950.4, abs=0.2)


def test_paths(tmp_path):
    assert has_glob_characters("*.tif") and has_glob_characters("a?[0-9].tif") and not has_glob_characters("plain.tif")
    a, b = tmp_path / "a.tif", tmp_path / "b.tif"
    a.touch(), b.touch()
    assert resolve_inputs([str(a)]) == [str(a)]
    assert resolve_inputs([f"{tmp_path}/*.tif", str(b)]) == [str(a), str(b)]
    with pytest.raises(ValueError):
        resolve_inputs([])
    with pytest.raises(FileNotFoundError, match="no such file"):
        resolve_inputs([f"{tmp_path}/x.tif"])
    with pytest.raises(FileNotFoundError, match="pattern"):
        resolve_inputs([f"{tmp_path}/*.png"])


def test_normalise_and_expand():
    v = np.array([np.nan, np.inf, -np.inf, 1.0, 2.0, 3.0], np.float32)
    assert render.to_bytes(v).tolist() == [0, 255, 0, 0, 128, 255]
    assert render.to_bytes(np.array([5, 5], np.uint16)).tolist() == [0, 0]
    px = np.arange(10, dtype=np.uint8)
    assert render.expand_bands(px[:2], 2, 1)[0].tolist() == [[0, 0, 0, 255], [1, 1, 1, 255]]
    assert render.expand_bands(px[:2], 1, 1)[0].tolist() == [[0, 0, 0, 1]]
    assert render.expand_bands(px[:3], 1, 1)[0].tolist() == [[0, 1, 2, 255]]
    assert render.expand_bands(px[:5], 1, 1)[0].tolist() == [[0, 1, 2, 3]]
    lay = render.Layout(5, 3, 2, 2)
    assert (lay.across, lay.down, lay.data_size(2), lay.data_size(5)) == (3, 2, (1, 2), (1, 1))


def test_lzw_and_packbits():
    # codes: clear, A, B, 258 (AB), 260 (ABA), end; 9 bits each
    codes = [256, 65, 66, 258, 260, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unpack_lzw(raw) == b"ABABABA"
    assert tiff.unpack_bits(bytes([2, 65, 66, 67, 254, 90])) == b"ABCZZZ"


def write_world(path, x, y, step):
    path.write_text(f"{step}\n0\n0\n-{step}\n{x}\n{y}\n")


def test_convert(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = np.full((200, 300, 4), 255, np.uint8)
    a[..., :3] = rng.integers(0, 255, (200, 300, 3))
    tiff.write_tiff(f"{tmp_path}/a.tif", a)
    write_world(tmp_path / "a.tfw", 10, 50, 0.01)
    tiff.write_tiff(f"{tmp_path}/b.tif", a[:100, :100, 0:1], {tiff.NODATA: ("s", (b"0\0",))}, deflate=False)
    write_world(tmp_path / "b.tfw", 12.5, 49, 0.02)
    out = f"{tmp_path}/out.pmtiles"
    report = convert(spark, [f"{tmp_path}/*.tif"], out, Options(src_crs="EPSG:4326", max_zoom=7)).orderBy("z").collect()
    head, stored = archive.read_archive(out)
    assert sum(r.n_written for r in report) == len(stored) == head["n_tiles"] > 3
    assert head["bounds"] == pytest.approx([9.995, 46.995, 14.49, 50.005], abs=0.02)
    assert all(r.n_cells == r.n_kept + r.n_empty and r.n_written <= r.n_kept for r in report)
    with pytest.raises(ValueError):
        Options(min_zoom=5, max_zoom=4)
    with pytest.raises(ValueError):
        Options(quality=0)


def test_progress_is_told_by_tenths():
    from tessella.plans.convert import reported

    said = []
    assert list(reported(iter(range(25)), 25, said.append)) == list(range(25))
    assert said[0] == "12% (3/25)" and said[-1] == "100% (25/25)" and len(said) == 10
    assert list(reported(iter([]), 0, said.append)) == []


def test_patterns(tmp_path):
    from tessella.sources.paths import check_pattern, resolve_inputs

    (tmp_path / "sub").mkdir()
    for name in ("a.tif", ".b.tif", "sub/c.tif"):
        (tmp_path / name).write_text("x")
    assert resolve_inputs([f"{tmp_path}/*.tif"]) == [f"{tmp_path}/.b.tif", f"{tmp_path}/a.tif"]
    assert f"{tmp_path}/sub/c.tif" in resolve_inputs([f"{tmp_path}/**/*.tif"])
    assert resolve_inputs([f"{tmp_path}/[!b].tif", f"{tmp_path}/a.tif"]) == [f"{tmp_path}/a.tif"]
    for bad in ("a***", "a**/b", "x/**y", "[ab", "[]", "[!]"):
        with pytest.raises(ValueError):
            check_pattern(bad)
    with pytest.raises(FileNotFoundError):
        resolve_inputs([f"{tmp_path}/no.tif"])


def test_late_geokeys_count(spark):
    from pyspark.sql import functions as F

    from tessella.functions import georef

    keys = [1, 1, 0, 81, *[v for k in range(80) for v in (5000 + k, 0, 1, k)], 3072, 0, 1, 32633]
    d = spark.createDataFrame([(keys,), ([1, 1, 0, 0],), ([1, 1],), (None,)], "k array<int>")
    assert [r.e for r in d.select(georef.epsg(F.col("k")).alias("e")).collect()] == [32633, None, None, None]


def test_exit_status(tmp_path, capsys):
    from tessella import cli

    assert cli.main([f"{tmp_path}/none.tif", "--min-zoom", "5", "--max-zoom", "3"]) == 1
    assert "error" in capsys.readouterr().err


def test_separate_planes_are_refused(tmp_path):
    px = np.zeros((4, 4, 3), np.uint8)
    tiff.write_tiff(f"{tmp_path}/p.tif", px, {tiff.PLANAR: ("H", (2,))})
    with pytest.raises(ValueError):
        tiff.read_header((tmp_path / "p.tif").read_bytes())


def test_numpy_renderer_equals_joins(spark):
    from tessella.operators import sampling

    rng = random.Random(4)
    lay = [render.Layout(40, 30, 16, 16), render.Layout(20, 20, 20, 7)]
    sources, rows = [], []
    for s, m in enumerate(lay):
        px = np.array([[[rng.randint(0, 3) * 60 for _ in range(4)] for _ in range(m.width)] for _ in range(m.height)], np.uint8)
        own = render.Source(m)
        for c in range(m.across * m.down):
            w, h = m.data_size(c)
            y, x = c // m.across * m.chunk_h, c % m.across * m.chunk_w
            own.chunks[c] = px[y : y + h, x : x + w]
        sources.append(own)
        rows += [(s, x, y, *map(int, px[y, x])) for y in range(m.height) for x in range(m.width)]
    corners = [np.array([[-3.0, -2.0], [41, -2.5], [42, 33], [-3, 32]]), np.array([[-1.0, -1], [21, -1], [21, 21], [-1, 21]])]
    size = 24
    pts = []
    for s in (0, 1):
        x, y = render.sample_grid(corners[s], size)
        pts += [(i, j, s, float(x[j, i]), float(y[j, i])) for j in range(size) for i in range(size)]
    points = spark.createDataFrame(pts, "i int, j int, source_idx int, px double, py double")
    pixels = spark.createDataFrame(rows, "source_idx int, x long, y long, r int, g int, b int, a int")
    for plain, joined in ((render.nearest, sampling.nearest), (render.bilinear, sampling.bilinear)):
        want = plain(list(zip(sources, corners, strict=True)), (0, 0, 0), size)
        got = np.zeros_like(want)
        for r in joined(points, pixels, ["i", "j"], (0, 0, 0)).collect():
            got[r.j, r.i] = (r.r, r.g, r.b, r.a)
        assert (want == got).all()


def test_archive_with_leaves(tmp_path):
    path = os.path.join(tmp_path, "x.pmtiles")
    tiles_in = [(k * 3, f"tile {k % 5000}".encode()) for k in range(30000)]
    archive.write_archive(path, iter(tiles_in), "png", (0, 8), (-1, -2, 3, 4))
    assert archive.read_archive(path)[1] == dict(tiles_in)
