"""Queries over the shared tables that exercise every operator, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import georef as G
from ..functions import nodata as N
from ..functions import pixels as P
from ..functions import tiles as T
from ..operators import chunks as K
from ..operators import coverage as V
from ..operators import sampling as S
from ..sources.paths import has_glob_column

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


col, lit = F.col, F.lit
O = "20037508.342789244e0"  # noqa: E741
PI = "3.141592653589793e0"

# --- points and tiles -------------------------------------------------------------


def points(spark, sf) -> DataFrame:
    t = table(spark, sf, "lineitem")
    lon = lit(-180.0) + ((col("l_orderkey") * 7919 + col("l_linenumber") * 31) % 360000) / 1000.0
    lat = lit(-85.0) + ((col("l_partkey") * 104729 + col("l_suppkey")) % 170000) / 1000.0
    return t.select(T.lon_to_x(lon).alias("mx"), T.lat_to_y(lat).alias("my"))


POINTS = f"""pts as (select lon * ({O} / 180e0) as mx, ln(tan((90e0 + lat) * ({PI} / 360e0))) * ({O} / {PI}) as my from (
  select -180e0 + ((l_orderkey * 7919 + l_linenumber * 31) % 360000) / 1000e0 as lon,
         -85e0 + ((l_partkey * 104729 + l_suppkey) % 170000) / 1000e0 as lat from lineitem))"""


def sql_tx(x: str, z: str) -> str:
    return f"cast(floor(least(greatest(({x} + {O}) / (2e0 * {O}), 0e0), 1e0 - 2.220446049250313e-16) * pow(2e0, {z})) as bigint)"


def sql_ty(y: str, z: str) -> str:
    return f"cast(floor(least(greatest(({O} - {y}) / (2e0 * {O}), 0e0), 1e0 - 2.220446049250313e-16) * pow(2e0, {z})) as bigint)"


def point_tiles(spark, sf, z: int) -> DataFrame:
    p = points(spark, sf)
    return p.select(lit(z).alias("z"), T.tile_x(col("mx"), lit(z)).alias("x"), T.tile_y(col("my"), lit(z)).alias("y")).distinct()


def TILES(z: int) -> str:  # noqa: N802
    return f"{POINTS}, t as (select distinct {z} as z, {sql_tx('mx', str(z))} as x, {sql_ty('my', str(z))} as y from pts)"


@query(f"with {POINTS} select {sql_tx('mx', '8')} as x, {sql_ty('my', '8')} as y, count(*) as n from pts group by 1, 2")
def tile_index_counts(spark, sf):
    p = points(spark, sf)
    return p.groupBy(T.tile_x(col("mx"), lit(8)).alias("x"), T.tile_y(col("my"), lit(8)).alias("y")).agg(F.count("*").alias("n"))


SIZE = f"(2e0 * {O} / pow(2e0, z))"


@query(f"""with {TILES(6)} select x, y, round(x * {SIZE} - {O}, 3) + 0e0 as min_x, round({O} - y * {SIZE} - {SIZE}, 3) + 0e0 as min_y,
  round(x * {SIZE} - {O} + {SIZE}, 3) + 0e0 as max_x, round({O} - y * {SIZE}, 3) + 0e0 as max_y from t""")
def tile_bounds(spark, sf):
    b = T.tile_bounds(col("z"), col("x"), col("y"))
    return point_tiles(spark, sf, 6).select("x", "y", *((F.round(v, 3) + 0.0).alias(k) for k, v in b.items()))


@query(f"with {POINTS} select cast(count(*) as bigint) as n, cast(count(*) as bigint) as n_inside from pts")
def tile_roundtrip_contains(spark, sf):
    p = points(spark, sf)
    z = lit(12)
    b = T.tile_bounds(z, T.tile_x(col("mx"), z), T.tile_y(col("my"), z))
    near = 1e-6
    inside = (col("mx") >= b["min_x"] - near) & (col("mx") <= b["max_x"] + near) & (col("my") >= b["min_y"] - near) & (col("my") <= b["max_y"] + near)
    return p.agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))


def sql_morton(x: str, y: str, bits: int = 31) -> str:
    part = lambda v, s: f"list_sum(list_transform(range(0, {bits}), lambda i: ((({v}) >> i) & 1) << (2 * i + {s})))"
    return f"cast({part(x, 0)} + {part(y, 1)} as bigint)"


@query(f"with {TILES(8)} select x, y, {sql_morton('x', 'y', 12)} as morton from t")
def morton_order(spark, sf):
    return point_tiles(spark, sf, 8).select("x", "y", T.morton(col("x"), col("y")).alias("morton"))


def SOME(spark, sf):  # noqa: N802
    return point_tiles(spark, sf, 4).unionByName(point_tiles(spark, sf, 6))


SOME_SQL = f"""{POINTS}, t as (select distinct 4 as z, {sql_tx('mx', '4')} as x, {sql_ty('my', '4')} as y from pts
  union all select distinct 6 as z, {sql_tx('mx', '6')} as x, {sql_ty('my', '6')} as y from pts)"""
HALF = lambda v: f"(((({v}) << (6 - z)) << 1) | 1)"
LOCAL_SQL = f"{SOME_SQL}, loc as (select z, x, y, {sql_morton(HALF('x'), HALF('y'), 12)} as locality_key from t)"


@query(f"with {LOCAL_SQL} select z, x, y, locality_key, row_number() over (order by locality_key, z) - 1 as n from loc")
def locality_rank(spark, sf):
    d = SOME(spark, sf).withColumn("locality_key", T.locality_key(col("z"), col("x"), col("y"), 6))
    return V.dense_ordinal(d, ["locality_key", "z"], "n")


def hilbert_sql(source: str, z: int) -> str:
    """CTEs h{z}..h0 over source (z, x, y): curve distance bit by bit."""
    full = (1 << z) - 1
    out = [f"h{z} as (select z, x, y, x as hx, y as hy, 0::bigint as d from {source} where z = {z})"]
    for k in range(z - 1, -1, -1):
        rx, ry = f"((hx >> {k}) & 1)", f"((hy >> {k}) & 1)"
        out.append(f"""h{k} as (select z, x, y,
          case when {ry} = 0 then (case when {rx} = 1 then {full} - hy else hy end) else hx end as hx,
          case when {ry} = 0 then (case when {rx} = 1 then {full} - hx else hx end) else hy end as hy,
          d + (xor(3 * {rx}, {ry}) << {2 * k}) as d from h{k + 1})""")
    return ",\n".join(out)


HILBERT = f"{TILES(6)}, {hilbert_sql('t', 6)}, ids as (select z, x, y, cast({(4**6 - 1) // 3} + d as bigint) as tile_id from h0)"


@query(f"with {HILBERT} select x, y, tile_id from ids")
def hilbert_tile_id(spark, sf):
    return point_tiles(spark, sf, 6).select("x", "y", T.hilbert_tile_id(col("z"), col("x"), col("y")).alias("tile_id"))


@query(f"with {HILBERT} select x, y, tile_id, row_number() over (order by tile_id) - 1 as write_idx from ids")
def write_ordinal(spark, sf):
    d = point_tiles(spark, sf, 6)
    d = d.select("x", "y", T.hilbert_tile_id(col("z"), col("x"), col("y")).alias("tile_id"))
    return V.dense_ordinal(d, ["tile_id"], "write_idx")


@query(f"""with {HILBERT}, w as (select row_number() over (order by tile_id) as k, count(*) over () as total from ids),
  p as (select k, total, k * 100 // total as percent, lag(k * 100 // total, 1, 0) over (order by k) as before from w)
  select percent, k as written, total from p where percent // 10 > before // 10""")
def progress_marks(spark, sf):
    return V.progress_marks(write_ordinal(spark, sf), "write_idx")


@query(f"""with {LOCAL_SQL} select n // 256 as batch, count(*) as n_tiles, min(locality_key) as first_key from (
  select locality_key, row_number() over (order by locality_key, z) - 1 as n from loc) group by 1""")
def render_batches(spark, sf):
    d = locality_rank(spark, sf).withColumn("batch", F.expr("n div 256"))
    return d.groupBy("batch").agg(F.count("*").alias("n_tiles"), F.min("locality_key").alias("first_key"))


@query(f"""select z, count(*) as n from (select coalesce((select max(k) from range(0, 25) r(k) where 2e0 * {O} / pow(2e0, k) >= need), 0) as z
  from (select (c_custkey + 1) * 40000.37e0 as need from customer)) group by z""")
def auto_zoom(spark, sf):
    d = table(spark, sf, "customer").select(T.auto_zoom((col("c_custkey") + 1) * 40000.37).cast("long").alias("z"))
    return d.groupBy("z").agg(F.count("*").alias("n"))


# --- footprints and coverage --------------------------------------------------------


def footprints(spark, sf) -> DataFrame:
    k = col("s_suppkey")
    d = table(spark, sf, "supplier").select(
        k.alias("source_idx"), (lit(-130.0) + (k * 7919 % 6000) / 100.0).alias("lon"), (lit(20.0) + (k * 104729 % 3000) / 100.0).alias("lat")
    )
    return d.select(
        "source_idx", T.lon_to_x(col("lon")).alias("min_x"), T.lat_to_y(col("lat")).alias("min_y"),
        T.lon_to_x(col("lon") + 0.15).alias("max_x"), T.lat_to_y(col("lat") + 0.1).alias("max_y"),
    )


def sql_y(lat: str) -> str:
    return f"ln(tan((90e0 + ({lat})) * ({PI} / 360e0))) * ({O} / {PI})"


BOXES = f"""boxes as (select s_suppkey as source_idx, lon * ({O} / 180e0) as min_x, {sql_y('lat')} as min_y,
    (lon + 0.15e0) * ({O} / 180e0) as max_x, {sql_y('lat + 0.1e0')} as max_y
  from (select s_suppkey, -130e0 + (s_suppkey * 7919 % 6000) / 100e0 as lon, 20e0 + (s_suppkey * 104729 % 3000) / 100e0 as lat from supplier)),
ext as (select min(min_x) as wx, min(min_y) as wy, max(max_x) as vx, max(max_y) as vy from boxes)"""
GRID = f"""{BOXES}, zr as (select *, (select max(k) from range(0, 25) r(k) where 2e0 * {O} / pow(2e0, k) >= greatest(vx - wx, vy - wy)) as z0 from ext),
zs as (select cast(unnest(range(z0, z0 + 4)) as int) as z, wx, wy, vx, vy from zr),
gr as (select z, {sql_tx('wx', 'z')} as x0, {sql_tx('vx', 'z')} as x1, {sql_ty('vy', 'z')} as y0, {sql_ty('wy', 'z')} as y1 from zs),
gx as (select z, y0, y1, unnest(range(x0, x1 + 1)) as x from gr), g as (select z, x, unnest(range(y0, y1 + 1)) as y from gx),
gb as (select z, x, y, x * {SIZE} - {O} as min_x, {O} - y * {SIZE} - {SIZE} as min_y, x * {SIZE} - {O} + {SIZE} as max_x, {O} - y * {SIZE} as max_y from g),
pairs as (select z, x, y, source_idx from gb join boxes b on gb.max_x >= b.min_x and gb.min_x <= b.max_x and gb.max_y >= b.min_y and gb.min_y <= b.max_y)"""


def ranges(spark, sf) -> DataFrame:
    return V.zoom_range(V.extent(footprints(spark, sf)))


@query(f"with {BOXES} select round(wx, 3) as min_x, round(wy, 3) as min_y, round(vx, 3) as max_x, round(vy, 3) as max_y from ext")
def union_extent(spark, sf):
    return V.extent(footprints(spark, sf)).select(*(F.round(c, 3).alias(c) for c in V.BOX))


@query(f"with {BOXES} select source_idx, round(min_x, 3) as min_x, round(min_y, 3) as min_y, round(max_x, 3) as max_x, round(max_y, 3) as max_y from boxes")
def source_bbox(spark, sf):
    return footprints(spark, sf).select("source_idx", *(F.round(c, 3).alias(c) for c in V.BOX))


LAT = lambda y: f"(atan(exp({y} * ({PI} / {O}))) * (360e0 / {PI}) - 90e0)"
LON = lambda x: f"({x} * (180e0 / {O}))"


@query(f"""with {BOXES} select round({LON('wx')}, 6) as min_lon, round({LAT('wy')}, 6) as min_lat, round({LON('vx')}, 6) as max_lon, round({LAT('vy')}, 6) as max_lat,
  round(({LON('wx')} + {LON('vx')}) / 2e0, 6) as center_lon, round(({LAT('wy')} + {LAT('vy')}) / 2e0, 6) as center_lat from ext""")
def lonlat_bounds_center(spark, sf):
    e = V.extent(footprints(spark, sf))
    a, b, c, d = T.x_to_lon(col("min_x")), T.y_to_lat(col("min_y")), T.x_to_lon(col("max_x")), T.y_to_lat(col("max_y"))
    named = {"min_lon": a, "min_lat": b, "max_lon": c, "max_lat": d, "center_lon": (a + c) / 2, "center_lat": (b + d) / 2}
    return e.select(*(F.round(v, 6).alias(k) for k, v in named.items()))


@query(f"with {GRID} select distinct z, x, y from pairs")
def tile_coverage_semi(spark, sf):
    return V.tile_sources(footprints(spark, sf), ranges(spark, sf)).select("z", "x", "y").distinct()


@query(f"with {GRID} select z, count(*) as n_empty from g where not exists (select 1 from pairs p where p.z = g.z and p.x = g.x and p.y = g.y) group by z")
def tile_coverage_empty(spark, sf):
    return V.coverage_by_zoom(footprints(spark, sf), ranges(spark, sf)).where("n_empty > 0").select("z", "n_empty")


@query(f"with {GRID} select z, x, y, source_idx from pairs")
def tile_source_pairs(spark, sf):
    return V.tile_sources(footprints(spark, sf), ranges(spark, sf))


@query(f"""with {GRID}, kept as (select z, count(distinct (x, y)) as n_kept, count(*) as n_pairs from pairs group by z)
  select g.z, count(*) as n_cells, max(n_kept) as n_kept, count(*) - max(n_kept) as n_empty, max(n_pairs) as n_pairs from g join kept using (z) group by g.z""")
def coverage_by_zoom(spark, sf):
    return V.coverage_by_zoom(footprints(spark, sf), ranges(spark, sf))


@query(f"""with {GRID} select 'none' as tile_compression, cast(min(z) as int) as min_zoom, cast(max(z) as int) as max_zoom, cast(min(z) as int) as center_zoom,
  round({LON('max(wx)')}, 6) as min_lon, round({LAT('max(vy)')}, 6) as max_lat from zs""")
def archive_header_row(spark, sf):
    r = ranges(spark, sf)
    return r.select(
        lit("none").alias("tile_compression"), col("min_zoom").cast("int").alias("min_zoom"), col("max_zoom").cast("int").alias("max_zoom"), col("min_zoom").cast("int").alias("center_zoom"),
        F.round(T.x_to_lon(col("min_x")), 6).alias("min_lon"), F.round(T.y_to_lat(col("max_y")), 6).alias("max_lat"),
    )


# --- georeferencing -------------------------------------------------------------------

AFFINE = "1e0 + k % 7 as a, k % 3 * 1e0 as b, k % 100 * 1e0 as c, k % 2 * 1e0 as d, 2e0 + k % 5 as e, k % 50 * 1e0 as f"


def affines(spark, sf):
    k = col("c_custkey")
    d = table(spark, sf, "customer")
    p = [lit(1.0) + k % 7, k % 3 * 1.0, k % 100 * 1.0, k % 2 * 1.0, lit(2.0) + k % 5, k % 50 * 1.0]
    return d.select(k.alias("k"), *(v.alias(n) for v, n in zip(p, "abcdef", strict=True)))


PARAMS = list("abcdef")
_CUSTOMERS = f"p as (select c_custkey as k, {AFFINE.replace('k %', 'c_custkey %')} from customer)"


@query(f"with {_CUSTOMERS} select k, a * 5e0 + b * -2e0 + c as x, d * 5e0 + e * -2e0 + f as y from p")
def affine_apply(spark, sf):
    x, y = G.affine_apply([col(c) for c in PARAMS], lit(5.0), lit(-2.0))
    return affines(spark, sf).select("k", x.alias("x"), y.alias("y"))


@query(f"""with {_CUSTOMERS}, q as (select *, case when abs(a * e - b * d) >= 1e-15 then a * e - b * d end as det from p)
  select k, round(e / det, 9) + 0e0 as ia, round(-b / det, 9) + 0e0 as ib, round((b * f - e * c) / det, 9) + 0e0 as ic, round(-d / det, 9) + 0e0 as id, round(a / det, 9) + 0e0 as ie, round((d * c - a * f) / det, 9) + 0e0 as "if" from q""")
def affine_invert(spark, sf):
    inv = G.affine_invert([col(c) for c in PARAMS])
    return affines(spark, sf).select("k", *((F.round(v, 9) + 0.0).alias(f"i{c}") for v, c in zip(inv, PARAMS, strict=True)))


@query("""with p as (select c_custkey as k, c_custkey % 3 * 1e0 as sx, 1e0 + c_custkey % 4 as sy from customer)
  select k, case when sx <> 0 then 1000e0 + k end as rx, case when sx <> 0 then 100e0 end as mx, case when sx <> 0 then round(1e0 / sx, 9) end as isx, case when sx <> 0 then round(1e0 / sy, 9) end as isy from p""")
def tiepoint_invert(spark, sf):
    k = col("c_custkey")
    inv = G.tiepoint_invert([lit(100.0), lit(200.0), lit(1000.0) + k, lit(2000.0), k % 3 * 1.0, lit(1.0) + k % 4])
    return table(spark, sf, "customer").select(k.alias("k"), inv[0].alias("rx"), inv[2].alias("mx"), F.round(inv[4], 9).alias("isx"), F.round(inv[5], 9).alias("isy"))


@query(f"""with {_CUSTOMERS}, q as (select k, unnest([0e0, 10e0, 10e0, 0e0]) as x, unnest([0e0, 0e0, 10e0, 10e0]) as y, a, b, c, d, e, f from p)
  select k, min(a * x + b * y + c) as min_x, min(d * x + e * y + f) as min_y, max(a * x + b * y + c) as max_x, max(d * x + e * y + f) as max_y from q group by k""")
def quad_raster_bbox(spark, sf):
    p = [col(c) for c in PARAMS]
    four = [G.affine_apply(p, lit(x), lit(y)) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))]
    xs, ys = [q[0] for q in four], [q[1] for q in four]
    return affines(spark, sf).select(
        "k", F.least(*xs).alias("min_x"), F.least(*ys).alias("min_y"), F.greatest(*xs).alias("max_x"), F.greatest(*ys).alias("max_y")
    )


@query("""select k, coalesce(case when proj not in (0, 32767) then proj end, case when k % 5 <> 0 and geog not in (0, 32767) then geog end) as epsg from (
  select c_custkey as k, cast([32767, 0, 32610, 3857][1 + c_custkey % 4] as int) as proj, cast([4326, 0, 32767][1 + c_custkey % 3] as int) as geog from customer)""")
def geokey_epsg(spark, sf):
    k = col("c_custkey")
    proj = F.get(F.array(*map(lit, (32767, 0, 32610, 3857))), (k % 4).cast("int"))
    geog = F.get(F.array(*map(lit, (4326, 0, 32767))), (k % 3).cast("int"))
    # a geographic key that is not stored inline doesn't count
    words = [lit(1), lit(1), lit(0), lit(3), lit(1024), lit(0), lit(1), lit(2), lit(2048), F.when(k % 5 == 0, 34736).otherwise(0), lit(1), geog, lit(3072), lit(0), lit(1), proj]
    return table(spark, sf, "customer").select(k.alias("k"), G.epsg(F.array(*words)).cast("int").alias("epsg"))


WORLD = "concat(cast(k % 9 + 1 as varchar), chr(10), ' 0.25 ', chr(10), chr(10), '-.5', chr(10), case when k % 6 = 0 then '5d' else '-2e1' end, chr(10), cast(k as varchar), case when k % 7 = 0 then '' else concat(chr(10), '3.5') end)"


@query("select k, k % 9 + 1.0e0 as a, -0.5e0 as b, cast(k as double) as c, 0.25e0 as d, -20e0 as e, 3.5e0 as f from (select c_custkey as k from customer) where k % 6 <> 0 and k % 7 <> 0")
def worldfile_parse(spark, sf):
    d = table(spark, sf, "customer").select(col("c_custkey").alias("k"))
    text = F.expr(WORLD.replace("varchar", "string"))
    d = d.select("k", G.world_file(text).alias("p")).where("p is not null")
    return d.select("k", *(F.get("p", lit(i)).alias(c) for i, c in enumerate("abcdef")))


@query("""select k, case when k % 2 = 0 then '.tfw' when k % 3 = 0 then '.TFW' when k % 5 = 0 then '.tifw' else '.TIFW' end as ending from (select c_custkey as k from customer)""")
def worldfile_priority(spark, sf):
    d = table(spark, sf, "customer").select(col("c_custkey").alias("k"))
    there = F.array(*(F.when(col("k") % m == 0, e) for m, e in zip((2, 3, 5, 1), G.WORLD_FILE_ENDINGS, strict=True)))
    files = d.select("k", F.explode(there).alias("ending")).where("ending is not null")
    rank = F.array_position(F.array(*map(lit, G.WORLD_FILE_ENDINGS)), col("ending"))
    best = files.groupBy("k").agg(F.min_by("ending", rank).alias("ending"))
    return d.join(best, "k", "left")


@query("""select k, case when k % 2 = 0 then 'matrix' when k % 3 = 0 then 'tiepoint' when k % 5 = 0 then 'worldfile' end as origin,
  case when (k % 2 <> 0 and k % 3 <> 0 and k % 5 = 0) or k % 4 = 2 then -0.5e0 else 0e0 end as raster_offset from (select c_custkey as k from customer)""")
def georef_precedence(spark, sf):
    k = col("k")
    d = table(spark, sf, "customer").select(col("c_custkey").alias("k"))
    origin = F.coalesce(F.when(k % 2 == 0, "matrix"), F.when(k % 3 == 0, "tiepoint"), F.when(k % 5 == 0, "worldfile"))
    d = d.withColumn("origin", origin)
    return d.withColumn("raster_offset", G.raster_offset(F.coalesce(col("origin") == "worldfile", lit(False)), (k % 4).cast("int")))


# --- nodata -----------------------------------------------------------------------------

TEXTS = ["", "   ", "42", " 1, 2 ,3 ", "0.0", "255.0", "1.0, 2.0, 3.0", "1,2", "x", "1,2,300", "-9999", "0.5", "5d", "inf", "7,7,7", ",8,", "1e2"]
_LIST = "[" + ", ".join(f"'{t}'" for t in TEXTS) + "]"
_LEVEL = "case when regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') and try_cast(x as double) between 0 and 255 and try_cast(x as double) % 1 = 0 then cast(try_cast(x as double) as int) end"
_PARSED = f"""src as (select p_partkey as k, {_LIST}[1 + p_partkey % {len(TEXTS)}] as t from part),
parts as (select k, t, list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') as s from src),
lev as (select k, t, s, list_transform(s, lambda x: {_LEVEL}) as v from parts),
parsed as (select k, case when trim(t) = '' then null when len(s) = 1 and v[1] is not null then 'gray'
    when len(s) = 3 and v[1] is not null and v[2] is not null and v[3] is not null then 'rgb' else 'error' end as kind, v from lev)"""


def tags(spark, sf):
    k = col("p_partkey")
    return table(spark, sf, "part").select(k.alias("k"), F.get(F.array(*map(lit, TEXTS)), (k % len(TEXTS)).cast("int")).alias("gdal_nodata"))


@query(f"""with {_PARSED} select k, kind, case when kind in ('gray', 'rgb') then v[1] end as r, case when kind = 'gray' then v[1] when kind = 'rgb' then v[2] end as g,
  case when kind = 'gray' then v[1] when kind = 'rgb' then v[3] end as b from parsed""")
def nodata_parse(spark, sf):
    return tags(spark, sf).select("k", N.parse(col("gdal_nodata")).alias("p")).select("k", "p.*")


@query(f"with {_PARSED} select count(distinct (kind, v)) as n_values from parsed where kind in ('gray', 'rgb')")
def nodata_consensus(spark, sf):
    return N.consensus(tags(spark, sf)).select(col("n_values").cast("long").alias("n_values"))


@query("select r, g, b, count(*) as n, count(*) filter (where r = 1 and g = 1 and b = 1) as n_nodata from (select l_orderkey % 3 as r, l_partkey % 3 as g, l_suppkey % 3 as b from lineitem) group by all")
def nodata_mask(spark, sf):
    d = table(spark, sf, "lineitem").select((col("l_orderkey") % 3).alias("r"), (col("l_partkey") % 3).alias("g"), (col("l_suppkey") % 3).alias("b"))
    return d.groupBy("r", "g", "b").agg(F.count("*").alias("n"), F.count_if(N.matches(col("r"), col("g"), col("b"), (1, 1, 1))).alias("n_nodata"))


# --- chunks -------------------------------------------------------------------------------


def layouts(spark, sf):
    k = col("s_suppkey")
    d = table(spark, sf, "supplier").select(k.alias("source_idx"), (k % 97 + 300).alias("w"), (k % 53 + 200).alias("h"), (k % 3 * 32 + 32).alias("cw"), (k % 2 * 48 + 16).alias("ch"))
    return d.withColumn("across", P.ceil_div(col("w"), col("cw"))).withColumn("down", P.ceil_div(col("h"), col("ch")))


LAYOUTS = """lay as (select *, (w + cw - 1) // cw as across, (h + ch - 1) // ch as down from (
  select s_suppkey as source_idx, s_suppkey % 97 + 300 as w, s_suppkey % 53 + 200 as h, s_suppkey % 3 * 32 + 32 as cw, s_suppkey % 2 * 48 + 16 as ch from supplier))"""


@query(f"with {LAYOUTS} select source_idx, across, down, across * down as chunk_count from lay")
def chunk_grid(spark, sf):
    return layouts(spark, sf).select("source_idx", "across", "down", (col("across") * col("down")).alias("chunk_count"))


@query(f"""with {LAYOUTS} select source_idx, i as chunk_idx, least(cw, w - (i % across) * cw) as data_w, least(ch, h - (i // across) * ch) as data_h
  from (select *, unnest(range(across * down)) as i from lay)""")
def chunk_edge_dims(spark, sf):
    d = layouts(spark, sf).withColumn("i", F.explode(F.sequence(lit(0).cast("long"), col("across") * col("down") - 1)))
    return d.select(
        "source_idx", col("i").alias("chunk_idx"), P.chunk_size(col("i") % col("across"), col("cw"), col("w")).alias("data_w"),
        P.chunk_size(F.expr("i div across"), col("ch"), col("h")).alias("data_h"),
    )


@query(f"""with {LAYOUTS} select source_idx, (y // ch) * across + x // cw as chunk_idx, count(*) as n, cast(sum(x % cw) as bigint) as sum_lx, cast(sum(y % ch) as bigint) as sum_ly
  from lineitem join lay on l_suppkey = source_idx, lateral (select l_orderkey % w as x, l_partkey % h as y) group by 1, 2""")
def pixel_to_chunk(spark, sf):
    d = table(spark, sf, "lineitem").join(layouts(spark, sf), col("l_suppkey") == col("source_idx"))
    d = d.select("source_idx", "across", "cw", "ch", (col("l_orderkey") % col("w")).alias("x"), (col("l_partkey") % col("h")).alias("y"))
    d = d.withColumn("chunk_idx", P.chunk_of(col("x"), col("y"), col("cw"), col("ch"), col("across")))
    return d.groupBy("source_idx", "chunk_idx").agg(F.count("*").alias("n"), F.sum(col("x") % col("cw")).alias("sum_lx"), F.sum(col("y") % col("ch")).alias("sum_ly"))


def needs(spark, sf):
    """Chunks under boxes in raster space, a pixel wider, clipped; an empty range gives none."""
    k = col("source_idx")
    d = layouts(spark, sf).select("*", (k * 37 % 400 - 50.5).alias("x0"), (k * 41 % 300 - 40.5).alias("y0"))
    return K.chunks_under(d.select("*", (col("x0") + 80).alias("x1"), (col("y0") + 60).alias("y1")))


NEEDS = f"""{LAYOUTS}, bx as (select *, x0 + 80 as x1, y0 + 60 as y1 from (select *, source_idx * 37 % 400 - 50.5e0 as x0, source_idx * 41 % 300 - 40.5e0 as y0 from lay)),
ok as (select * from bx where x1 + 1 >= 0 and y1 + 1 >= 0 and x0 - 1 < w and y0 - 1 < h),
cx as (select *, unnest(range(cast(floor(greatest(floor(x0) - 1, 0) / cw) as bigint), cast(floor(least(ceil(x1) + 1, w - 1) / cw) as bigint) + 1)) as cx from ok),
need as (select source_idx, cy * across + cx as chunk_idx from (
  select *, unnest(range(cast(floor(greatest(floor(y0) - 1, 0) / ch) as bigint), cast(floor(least(ceil(y1) + 1, h - 1) / ch) as bigint) + 1)) as cy from cx))"""


@query(f"with {NEEDS} select source_idx, chunk_idx from need")
def chunk_requirements(spark, sf):
    return needs(spark, sf).select("source_idx", "chunk_idx")


@query(f"with {NEEDS} select source_idx, array_to_string(list(distinct chunk_idx order by chunk_idx), ' ') as chunks from need group by 1")
def chunks_by_source(spark, sf):
    d = K.chunk_lists(needs(spark, sf))
    return d.select("source_idx", F.array_join(F.transform("chunks", lambda x: x.cast("string")), " ").alias("chunks"))


# --- pixels ---------------------------------------------------------------------------------


def raster(spark, sf):
    """The embeddings as a raster: a row per vector, a column per part."""
    d = table(spark, sf, "embeddings").select(col("vec_id").alias("y"), "label", F.posexplode("embedding").alias("x", "v"))
    return d.select(col("x").cast("long").alias("x"), "y", "label", col("v").cast("double").alias("v"))


RASTER = "ras as (select cast(x as bigint) as x, vec_id as y, label, cast(v as double) as v from (select vec_id, label, unnest(embedding) as v, unnest(range(len(embedding))) as x from embeddings))"


@query(f"""with {RASTER}, ext as (select y // 64 as chunk_idx, min(v) as a, max(v) as b from ras group by 1)
  select chunk_idx, cast(floor(least(greatest((v - a) / (b - a), 0e0), 1e0) * 255e0 + 0.5e0) as int) as u8, count(*) as n from ras join ext on y // 64 = chunk_idx group by 1, 2""")
def normalize_u8(spark, sf):
    d = raster(spark, sf).withColumn("chunk_idx", F.expr("y div 64"))
    ext = d.groupBy("chunk_idx").agg(F.min(P.finite(col("v"))).alias("a"), F.max(P.finite(col("v"))).alias("b"))
    d = d.join(ext, "chunk_idx").select("chunk_idx", P.normalise(col("v"), col("a"), col("b")).alias("u8"))
    return d.groupBy("chunk_idx", "u8").agg(F.count("*").alias("n"))


@query("""select k, case when s = 0 then 0 else k % 256 end as r, case when s = 0 then 0 when s < 3 then k % 256 else (k + 1) % 256 end as g,
  case when s = 0 then 0 when s < 3 then k % 256 else (k + 2) % 256 end as b, case when s = 0 then 0 when s = 2 then (k + 1) % 256 when s >= 4 then (k + 3) % 256 else 255 end as a
  from (select p_partkey as k, p_size % 6 as s from part)""")
def band_expand(spark, sf):
    k = col("p_partkey")
    bands = F.array(*((k + i) % 256 for i in range(5)))
    d = table(spark, sf, "part").select(k.alias("k"), (col("p_size") % 6).alias("s"), bands.alias("bands"))
    return d.select("k", *(c.cast("long").alias(n) for c, n in zip(P.expand(col("bands"), col("s")), "rgba", strict=True)))


def pixel_table(spark, sf, split: bool):
    v = F.floor(F.abs(col("v")) * 1000).cast("int")
    source = (col("label") % 2).cast("int") if split else lit(0)
    return raster(spark, sf).select(
        source.alias("source_idx"), "x", "y", (v % 256).alias("r"), (v % 7 * 20).cast("int").alias("g"), (v % 5 * 50).cast("int").alias("b"),
        F.when(v % 11 == 0, 0).otherwise(255).alias("a"),
    )


PIXELS = lambda split: f"""{RASTER}, px as (select {'cast(label % 2 as int)' if split else '0'} as source_idx, x, y, v % 256 as r, v % 7 * 20 as g, v % 5 * 50 as b, case when v % 11 = 0 then 0 else 255 end as a
  from (select x, y, label, cast(floor(abs(v) * 1000) as int) as v from ras) where not (v % 256 = 17 and v % 7 * 20 = 17 and v % 5 * 50 = 17) and not (v % 256 = 0 and v % 7 = 0 and v % 5 = 0))"""  # noqa: E731


def grid_points(spark, sf, n_sources: int):
    k = col("l_orderkey")
    d = table(spark, sf, "lineitem").select(k.alias("i"), col("l_partkey").alias("j")).distinct()
    d = d.withColumn("source_idx", F.explode(F.sequence(lit(0), lit(n_sources - 1))))
    return d.select("i", "j", "source_idx", ((col("i") % 150) / 2.0 - 4 + col("source_idx") * 0.25).alias("px"), ((col("j") % 1100) / 2.0 - 5).alias("py"))


GRIDP = lambda n: f"""gp as (select i, j, s as source_idx, (i % 150) / 2e0 - 4 + s * 0.25e0 as px, (j % 1100) / 2e0 - 5 as py from (
  select i, j, unnest(range({n})) as s from (select distinct l_orderkey as i, l_partkey as j from lineitem)))"""  # noqa: E731
NEAR = """nb as (select i, j, g.source_idx, px, py, o.k, cast(floor(px) as bigint) + o.dx as nx, cast(floor(py) as bigint) + o.dy as ny
  from gp g, (values (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)) o(k, dx, dy)),
hit as (select nb.*, r, g, b, a, (px - nx) * (px - nx) + (py - ny) * (py - ny) as d2 from nb join px on px.source_idx = nb.source_idx and px.x = nx and px.y = ny)"""
NODATA = (0, 0, 0)


def nearest_sql(n: int) -> str:
    return f"""with {PIXELS(n > 1)}, {GRIDP(n)}, {NEAR}
      select i, j, source_idx, r, g, b, a from (select *, row_number() over (partition by i, j order by d2, source_idx, k) as rn from hit) where rn = 1"""


def bilinear_sql(n: int) -> str:
    t = {0: "(1 - tx) * (1 - ty)", 1: "tx * (1 - ty)", 2: "(1 - tx) * ty", 3: "tx * ty"}
    w = " + ".join(f"coalesce(case when r{k} is not null then {t[k]} end, 0e0)" for k in range(4))
    val = lambda c: "cast(least(greatest(floor((" + " + ".join(f"coalesce({c}{k} * ({t[k]}), 0e0)" for k in range(4)) + ") / w + 0.5e0), 0), 255) as int)"
    four = ", ".join(f"max({c}) filter (where k = {k}) as {c}{k}" for k in range(4) for c in "rgba")
    return f"""with {PIXELS(n > 1)}, {GRIDP(n)}, {NEAR}, f as (select i, j, source_idx, px - floor(px) as tx, py - floor(py) as ty, {four} from hit group by i, j, source_idx, px, py),
      w as (select *, {w} as w from f), ok as (select *, row_number() over (partition by i, j order by source_idx) as rn from w where w > 2.220446049250313e-16)
      select i, j, source_idx, {", ".join(f"{val(c)} as {c}" for c in "rgba")} from ok where rn = 1"""


@query(nearest_sql(1))
def resample_nearest(spark, sf):
    return S.nearest(grid_points(spark, sf, 1), pixel_table(spark, sf, False), ["i", "j"], NODATA)


@query(nearest_sql(2))
def mosaic_nearest(spark, sf):
    return S.nearest(grid_points(spark, sf, 2), pixel_table(spark, sf, True), ["i", "j"], NODATA)


@query(bilinear_sql(1))
def resample_bilinear(spark, sf):
    return S.bilinear(grid_points(spark, sf, 1), pixel_table(spark, sf, False), ["i", "j"], NODATA)


@query(bilinear_sql(2))
def mosaic_bilinear_first(spark, sf):
    return S.bilinear(grid_points(spark, sf, 2), pixel_table(spark, sf, True), ["i", "j"], NODATA)


@query(f"""with {RASTER} select y // 4 as ty, x // 4 as tx, count(*) as n, max(case when v < 0 then 0 else 255 end) = 0 as transparent from ras group by 1, 2""")
def transparent_tiles(spark, sf):
    d = raster(spark, sf).select(F.expr("y div 4").alias("ty"), F.expr("x div 4").alias("tx"), F.when(col("v") < 0, 0).otherwise(255).alias("a"))
    return d.groupBy("ty", "tx").agg(F.count("*").alias("n"), F.bool_and(col("a") == 0).alias("transparent"))


@query("""select j, i, row_x + i * ((right_x - row_x) / 255e0) as sx from (select j, 10e0 + (14e0 - 10e0) * (j / 255e0) as row_x, 500e0 + (470e0 - 500e0) * (j / 255e0) as right_x from range(256) t(j)), range(256) u(i)""")
def scanline_coordinates(spark, sf):
    d = spark.range(65536).select((F.expr("id div 256")).alias("j"), (col("id") % 256).alias("i"))
    v = col("j") / 255.0
    left, right = G.lerp(lit(10.0), lit(14.0), v), G.lerp(lit(500.0), lit(470.0), v)
    return d.select("j", "i", (left + col("i") * ((right - left) / 255.0)).alias("sx"))


@query("""select y, x, (cast(floor(x * 255 / 512) as int) + seed) % 256 as r, cast(floor(y * 255 / 512) as int) as g, (cast(xor(x, y) & 255 as int) + seed) % 256 as b, 255 as a
  from (select k // 512 as y, k % 512 as x, 11 as seed from range(512 * 512) t(k))""")
def bench_raster_pixels(spark, sf):
    return bench_raster(spark, 512, 11)


def bench_raster(spark: SparkSession, edge: int, seed: int) -> DataFrame:
    """The synthetic RGBA raster of the benchmark, a row per pixel."""
    x, y = col("x"), col("y")
    d = spark.range(edge * edge).select(F.expr(f"id div {edge}").alias("y"), (col("id") % edge).alias("x"))
    ramp = lambda v: F.floor(v * 255 / edge).cast("int")
    return d.select(
        "y", "x", ((ramp(x) + seed) % 256).alias("r"), ramp(y).alias("g"),
        ((x.bitwiseXOR(y).bitwiseAND(lit(255).cast("long")).cast("int") + seed) % 256).alias("b"), lit(255).alias("a"),
    )


@query("select distinct concat('/in/', p_brand, '/', cast(p_size as varchar), '.tif') as path, contains(p_type, '*') as has_glob from part")
def path_dedup_sort(spark, sf):
    path = F.concat(lit("/in/"), "p_brand", lit("/"), col("p_size").cast("string"), lit(".tif")).alias("path")
    return table(spark, sf, "part").select(path, has_glob_column("p_type").alias("has_glob")).distinct().orderBy("path")
