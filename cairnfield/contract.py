"""Named queries over the driver's tables, with the DuckDB SQL that gives the same rows.

The tables hold no point cloud, so points are views: the same expressions, read by both
engines, make a survey of 200 x 200 m out of lineitem, and one with unique ids of
100 x 100 m out of events, for operators that depend on order or on neighbours.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lattice import Raster, Tiles
from .operators import ground, metrics, neighbours, points, raster, report, surfaces, tables, tiling
from .plans.graph import Graph, over_files
from .plans.nodes import NODES
from .session import shared_dir
from .sources import grids, las, sinks, vectors
from .streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINE = {
    "x": "cast((l_partkey * 37 + l_orderkey * 11) % 20000 as double) / 100e0",
    "y": "cast((l_suppkey * 53 + l_orderkey * 29 + l_linenumber * 7) % 20000 as double) / 100e0",
    "z": "l_quantity / 2e0 + l_discount * 100e0",
    "intensity": "cast(floor(l_extendedprice) as bigint) % 65536",
    "classification": "case when l_returnflag = 'N' then 2 when l_returnflag = 'A' then 5 when l_tax >= 7e-2 then 7 else 6 end",
    "return_number": "l_linenumber",
    "number_of_returns": "greatest(l_linenumber, cast(1 + l_partkey % 7 as int))",
    "point_source_id": "cast(l_suppkey % 8 as int)",
    "scan_angle": "cast(l_partkey % 121 - 60 as double)",
    "gps_time": "cast(l_orderkey as double) / 10e0",
    "withheld": "l_orderkey % 50 = 0",
    "overlap": "l_partkey % 11 = 0",
    "synthetic": "l_suppkey % 9 = 0",
    "key_point": "l_orderkey % 17 = 0",
}
EVENT = {
    "point_id": "event_id",
    "x": "cast((event_id * 7919 + user_id * 31) % 10000 as double) / 100e0",
    "y": "cast((event_id * 104729 + user_id * 17) % 10000 as double) / 100e0",
    "z": "100e0 + value / 100e0",
    "classification": "case when event_id % 3 = 0 then 2 else 5 end",
    "withheld": "event_id % 40 = 0",
    "key_point": "event_id % 23 = 0",
}
#: The lattices of the two surveys.
TILES, EVENT_TILES = Tiles(0.0, 0.0, 50.0, 4, 4), Tiles(0.0, 0.0, 25.0, 4, 4)
CELLS = Raster(0.0, 200.0, 10.0, 20, 20)
FINE = Raster(0.0, 200.0, 4.0, 50, 50)
TERRAIN = Raster(0.0, 100.0, 10.0, 10, 10)


def _select(view: dict[str, str]) -> str:
    return ", ".join(f"{e} as {c}" for c, e in view.items())


P = f"points as (select {_select(LINE)} from lineitem)"
E = f"points as (select {_select(EVENT)} from events)"
TILE = "least(greatest(cast(floor(x / 50e0) as bigint), 0), 3) as tile_col, least(greatest(cast(floor(y / 50e0) as bigint), 0), 3) as tile_row"
ETILE = TILE.replace("50e0", "25e0")


def _cell(res: float, north: float, n: int) -> str:
    return f"case when y = 0 then {n - 1} else cast(floor(({north}e0 - y) / {res}e0) as bigint) end as row, cast(floor(x / {res}e0) as bigint) as col"


C10, C4 = _cell(10, 200, 20), _cell(4, 200, 50)
SEEN = "not withheld"


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} as {c}" for c, e in LINE.items()])


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} as {c}" for c, e in EVENT.items()])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as sums of any order give them; adding zero turns -0 into 0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def r6(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0e0 as {n}" for n in names)


# --- grid metrics ---------------------------------------------------------------

_SHARES = ", ".join(f"count(*) filter (classification = {k}) as class_{k}" for k in metrics.CLASSES)
_PARTIAL = f"""select cast(floor(x / 10e0) as bigint) as cell_col, cast(floor(y / 10e0) as bigint) as cell_row, count(*) as n, sum(z) as z_sum, sum(z * z) as z_sumsq,
  min(z) as z_min, max(z) as z_max, count(*) filter (classification = 2) as ground, count(*) filter (classification in (7, 18)) as noise,
  count(intensity) as i_n, sum(cast(intensity as double)) as i_sum, sum(cast(intensity as double) * intensity) as i_sumsq, min(cast(intensity as double)) as i_min, max(cast(intensity as double)) as i_max,
  count(*) filter (return_number = 1) as first_ret, count(*) filter (return_number = number_of_returns) as last_ret, {_SHARES}
  from points where {SEEN} group by 1, 2"""
_MOST = f"greatest({', '.join(f'class_{k}' for k in metrics.CLASSES)})"
_DOMINANT = "case " + " ".join(f"when class_{k} = {_MOST} then {k}" for k in metrics.CLASSES) + " end"
_FINAL = f"""select cell_col, cell_row, cell_col || '_' || cell_row as gid, n as point_count, n / 100e0 as density, z_sum / n as z_mean,
  sqrt(greatest(z_sumsq / n - (z_sum / n) * (z_sum / n), 0e0)) as z_std, z_min, z_max, z_max - z_min as z_range, ground as ground_count, ground / cast(n as double) as ground_cover,
  i_sum / i_n as intensity_mean, sqrt(greatest(i_sumsq / i_n - (i_sum / i_n) * (i_sum / i_n), 0e0)) as intensity_std, i_min as intensity_min, i_max as intensity_max, noise as noise_count,
  {_DOMINANT} as dominant_class, first_ret / cast(n as double) as first_return_cover, last_ret / cast(n as double) as last_return_cover,
  (class_3 + class_4 + class_5) / cast(n as double) as veg_cover, class_6 / cast(n as double) as building_cover, class_9 / cast(n as double) as water_cover from partial"""
_DOUBLES = ["density", "z_mean", "z_std", "z_min", "z_max", "z_range", "ground_cover", "intensity_mean", "intensity_std", "intensity_min", "intensity_max", "first_return_cover", "last_return_cover", "veg_cover", "building_cover", "water_cover"]


def _replace(doubles: list[str], digits: int = 6) -> str:
    return "* replace (" + ", ".join(f"round({c}, {digits}) + 0e0 as {c}" for c in doubles) + ")"


@query(f"with {P}, partial as ({_PARTIAL}), final as ({_FINAL}) select {_replace(_DOUBLES)} from final")
def grid_metrics(spark, sf_dir):
    return rounded(metrics.grid_metrics(line_points(spark, sf_dir), 10.0))


@query(f"with {P}, partial as ({_PARTIAL}) select {_replace(['z_sum', 'z_sumsq', 'i_sum', 'i_sumsq'], 3)} from partial")
def grid_partials(spark, sf_dir):
    """Partials of two halves of the survey, merged: the same as those of the whole."""
    p = line_points(spark, sf_dir)
    west, east = (metrics.grid_partial(p.where(t), 10.0) for t in (F.col("x") < 97.5, F.col("x") >= 97.5))
    out = metrics.merge_partials(west, east)
    return out.withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("z_sum", "z_sumsq", "i_sum", "i_sumsq")})


@query(f"with {P}, partial as ({_PARTIAL}), final as ({_FINAL}) select {_replace(_DOUBLES)} from final")
def consolidate_grid(spark, sf_dir):
    p = line_points(spark, sf_dir)
    return rounded(metrics.consolidate_grid(*[metrics.grid_metrics(p.where(t), 10.0, sums=True) for t in (F.col("x") < 97.5, F.col("x") >= 97.5)], res=10.0))


# --- filters ---------------------------------------------------------------------

_PROFILE = "select classification, count(*) as n, round(sum(z), 3) as z_sum, round(sum(x), 3) as x_sum, min(intensity) as i_min, max(intensity) as i_max from kept group by 1"


def _profile(df: DataFrame) -> DataFrame:
    return df.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 3).alias("z_sum"), F.round(F.sum("x"), 3).alias("x_sum"), F.min("intensity").alias("i_min"), F.max("intensity").alias("i_max"))


def _filter(name: str, run: Callable[[DataFrame], DataFrame], where: str = "true", tag: str | None = None) -> None:
    cls = f"case when {tag} then classification else 7 end as classification" if tag else "classification"
    sql = f"with {P}, kept as (select * replace ({cls}) from points where {where}) {_PROFILE}" if tag else f"with {P}, kept as (select * from points where {where}) {_PROFILE}"
    query(sql, name)(lambda spark, sf_dir: _profile(run(line_points(spark, sf_dir))))


_filter("elev_classify", lambda p: points.elevation_range(p, 5, 20), tag="(z between 5 and 20 or classification = 2) and not withheld")
_filter("elev_remove", lambda p: points.elevation_range(p, 5, 20, action="remove"), "(z between 5 and 20 or classification = 2) and not withheld")
_filter("protect_ground_off", lambda p: points.elevation_range(p, 5, 20, action="remove", protect_ground=False), "z between 5 and 20 and not withheld")
_filter("intensity_filter", lambda p: points.intensity_range(p, 1000, 99999, action="remove"), "(intensity between 1000 and 65535 or classification = 2) and not withheld")
_filter("intensity_classify", lambda p: points.intensity_range(p, 1000, 40000), tag="(intensity between 1000 and 40000 or classification = 2) and not withheld")
_filter("scan_angle_filter", lambda p: points.scan_angle_range(p, -30, 30, action="remove", protect_ground=False), "scan_angle between -30 and 30 and not withheld")
_filter("withheld_exclusion", lambda p: points.clean(p, F.lit(True), action="remove"), "not withheld")
for _mode, _test in (("first", "return_number = 1"), ("last", "return_number = number_of_returns"), ("single", "number_of_returns = 1"), ("multiple", "number_of_returns > 1")):
    _filter(f"return_{_mode}", lambda p, m=_mode: points.by_return(p, m), f"{_test} and not withheld")
_filter("class_keep", lambda p: points.by_class(p, "2, 5"), "classification in (2, 5) and not withheld")
_filter("class_remove", lambda p: points.by_class(p, "7", "remove"), "classification not in (7) and not withheld")
for _mode, _test in (("remove_overlap", "not overlap"), ("remove_synthetic", "not synthetic"), ("remove_all_qa", "not overlap and not synthetic"), ("only_overlap", "overlap")):
    _filter(f"qa_{_mode}", lambda p, m=_mode: points.by_flags(p, m), f"{_test} and not withheld")
_filter("clip_polygon", lambda p: points.clip_polygon(p, "POLYGON ((20 20, 180 40, 100 180, 20 20))"),
        "(160 * (y - 20) - 20 * (x - 20)) >= 0 and (-80 * (y - 40) - 140 * (x - 180)) >= 0 and (-80 * (y - 180) + 160 * (x - 100)) >= 0")
_filter("clip_polygon_buffer", lambda p: points.clip_polygon(p, "POLYGON ((50 50, 150 50, 150 150, 50 150, 50 50))", 10.0),
        "sqrt(pow(greatest(50 - x, 0, x - 150), 2) + pow(greatest(50 - y, 0, y - 150), 2)) <= 10")

# --- sampling ----------------------------------------------------------------------

_HASH = "(event_id * 2654435761) % 4294967296"


def _salt() -> F.Column:
    return F.expr("(point_id * 2654435761) % 4294967296")


_SAMPLE = "select point_id, round(x, 2) as x, round(y, 2) as y"


def _sampled(df: DataFrame) -> DataFrame:
    return df.select("point_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(f"with {E}, p as (select *, {ETILE} from points), r as (select *, row_number() over (partition by tile_col, tile_row order by point_id) - 1 as k from p) {_SAMPLE} from r where k % 4 = 0 or key_point")
def decimate_ratio_nth(spark, sf_dir):
    return _sampled(points.decimate(tiling.with_tiles(event_points(spark, sf_dir), EVENT_TILES), by=("tile_col", "tile_row")))


@query(f"with {E}, p as (select *, {ETILE} from points), r as (select *, row_number() over (partition by tile_col, tile_row order by point_id) - 1 as k, count(*) over (partition by tile_col, tile_row) as n from p) {_SAMPLE} from r where k % cast(greatest(1, ceil(n / 100e0)) as bigint) = 0 or key_point")
def decimate_adaptive(spark, sf_dir):
    return _sampled(points.decimate(tiling.with_tiles(event_points(spark, sf_dir), EVENT_TILES), by=("tile_col", "tile_row"), mode="adaptive", target=100))


@query(f"with {E}, p as (select *, {ETILE} from points), r as (select *, row_number() over (partition by tile_col, tile_row order by (point_id * 2654435761) % 4294967296, point_id) - 1 as k, count(*) over (partition by tile_col, tile_row) as n from p) {_SAMPLE} from r where k < ceil(n / 4e0) or key_point")
def decimate_random(spark, sf_dir):
    return _sampled(points.decimate(tiling.with_tiles(event_points(spark, sf_dir), EVENT_TILES), by=("tile_col", "tile_row"), strategy="random", salt=_salt()))


@query(f"with {E} {_SAMPLE} from points order by (point_id * 2654435761) % 4294967296, point_id limit 500")
def topk_sample(spark, sf_dir):
    return _sampled(points.sample(event_points(spark, sf_dir), 500, _salt()))


@query(f"with {E}, p as (select *, {ETILE} from points), r as (select *, row_number() over (partition by tile_col, tile_row order by (point_id * 2654435761) % 4294967296, point_id) as k from p) {_SAMPLE} from r where k <= 20")
def stratified_sample(spark, sf_dir):
    return _sampled(points.stratified_sample(tiling.with_tiles(event_points(spark, sf_dir), EVENT_TILES), ("tile_col", "tile_row"), 320, 16, _salt()))


# --- rasters out of points ------------------------------------------------------------

_CELL = f"cells as (select *, {C10}, {TILE} from points)"


def _cells(name: str, run, sql: str) -> None:
    query(f"with {P}, {_CELL} select row, col, round(value, 6) + 0e0 as value from ({sql})", name)(lambda spark, sf_dir: rounded(run(line_points(spark, sf_dir))))


for _how, _agg in (("min", "min(z)"), ("mean", "avg(z)"), ("median", "quantile_cont(z, 0.5)")):
    _cells(f"dtm_{_how}", lambda p, h=_how: surfaces.dtm(p, CELLS, h), f"select row, col, {_agg} as value from cells where {SEEN} and classification = 2 group by 1, 2")
for _how, _agg in (("max", "max(z)"), ("mean", "avg(z)"), ("min", "min(z)"), ("median", "quantile_cont(z, 0.5)")):
    _cells(f"dsm_{_how}", lambda p, h=_how: surfaces.dsm(p, CELLS, h), f"select row, col, {_agg} as value from cells where {SEEN} group by 1, 2")
_cells("dtm_idw", lambda p: surfaces.dtm(p, CELLS, "idw"), f"select row, col, sum(z / greatest(pow(z - m, 2), 1e-6)) / sum(1 / greatest(pow(z - m, 2), 1e-6)) as value from (select row, col, z, avg(z) over (partition by row, col) as m from cells where {SEEN} and classification = 2) group by 1, 2")
_cells("dsm_idw", lambda p: surfaces.dsm(p, CELLS, "idw"), f"select row, col, sum(z / greatest(pow(z - m, 2), 1e-6)) / sum(1 / greatest(pow(z - m, 2), 1e-6)) as value from (select row, col, z, avg(z) over (partition by row, col) as m from cells where {SEEN}) group by 1, 2")
_cells("dtm_tile_fallback", lambda p: surfaces.dtm(tiling.with_tiles(p.where("not (x < 50 and y < 50 and classification = 2)"), TILES), CELLS, "min", ("tile_col", "tile_row")),
       f"select row, col, min(z) as value from (select *, max(case when classification = 2 then 1 else 0 end) over (partition by tile_col, tile_row) as g from cells where {SEEN} and not (x < 50 and y < 50 and classification = 2)) where classification = 2 or g = 0 group by 1, 2")
_cells("penetration", lambda p: surfaces.canopy_penetration(tiling.with_tiles(p.where("not (x < 50 and y < 50 and classification = 2)"), TILES), CELLS),
       f"select row, col, count(*) filter (classification = 2) / cast(count(*) as double) as value from (select *, max(case when classification = 2 then 1 else 0 end) over (partition by tile_col, tile_row) as g from cells where {SEEN} and not (x < 50 and y < 50 and classification = 2)) where g = 1 group by 1, 2")
_cells("flight_coverage", lambda p: surfaces.flightline_coverage(p, CELLS), "select row, col, cast(count(distinct point_source_id) as double) as value from cells group by 1, 2")
_cells("flight_density", lambda p: surfaces.flightline_coverage(p, CELLS, "density"), "select row, col, cast(count(*) as double) as value from cells group by 1, 2")
_cells("intensity_mean", lambda p: surfaces.intensity_ortho(p, CELLS, False), f"select row, col, avg(intensity) as value from cells where {SEEN} group by 1, 2")
_cells("intensity_cos", lambda p: surfaces.intensity_ortho(p, CELLS, True, 45.0), f"select row, col, avg(intensity / greatest(cos(radians(scan_angle)), cos(radians(45e0)))) as value from cells where {SEEN} and abs(scan_angle) <= 45 group by 1, 2")

# --- raster algebra, stencils, terrain ---------------------------------------------------

_DEM = f"dem as (select row, col, max(z) as value from (select *, {C10} from points) where {SEEN} group by 1, 2)"
_LOW = f"low as (select row, col, min(z) as value from (select *, {C10} from points) where {SEEN} and classification = 2 group by 1, 2)"
#: A raster with holes: sparse cells of 4 m.
_HOLED = f"dem as (select row, col, avg(z) as value from (select *, {C4} from points) where {SEEN} and return_number = 1 and classification = 5 and overlap group by 1, 2)"


def _dem(spark, sf_dir) -> DataFrame:
    return surfaces.dsm(line_points(spark, sf_dir), CELLS)


def _low(spark, sf_dir) -> DataFrame:
    return surfaces.dtm(line_points(spark, sf_dir), CELLS)


def _holed(spark, sf_dir) -> DataFrame:
    return surfaces.dsm(line_points(spark, sf_dir).where("return_number = 1 and classification = 5 and overlap"), FINE, "mean")


def _algebra(name: str, run, sql: str, base: str = f"{_DEM}, {_LOW}") -> None:
    query(f"with {P}, {base} select row, col, round(value, 6) + 0e0 as value from ({sql})", name)(lambda spark, sf_dir: rounded(run(spark, sf_dir)))


_algebra("chm", lambda s, d: surfaces.canopy_height(_dem(s, d), _low(s, d)), "select row, col, least(greatest(dem.value - low.value, 0e0), 60e0) as value from dem join low using (row, col)")
_algebra("chm_diff", lambda s, d: raster.difference(_dem(s, d), _low(s, d), CELLS, Raster(20.0, 210.0, 10.0, 20, 20)), "select dem.row, dem.col, dem.value - low.value as value from dem join low on dem.row = low.row - 1 and dem.col = low.col + 2")
for _how, _v in (("first", "coalesce(dem.value, low.value)"), ("last", "coalesce(low.value, dem.value)"), ("min", "least(dem.value, low.value)"), ("max", "greatest(dem.value, low.value)")):
    _algebra(f"merge_{_how}", lambda s, d, h=_how: raster.merge([_dem(s, d).where("row < 15"), _low(s, d).where("row > 5")], h), f"select coalesce(dem.row, low.row) as row, coalesce(dem.col, low.col) as col, {_v} as value from (select * from dem where row < 15) dem full join (select * from low where row > 5) low on dem.row = low.row and dem.col = low.col")
_algebra("mosaic_shifted", lambda s, d: raster.mosaic([(CELLS, _dem(s, d)), (Raster(100.0, 300.0, 10.0, 20, 20), _low(s, d))])[1],
         "select coalesce(a.row, b.row) as row, coalesce(a.col, b.col) as col, coalesce(a.value, b.value) as value from (select row + 10 as row, col, value from dem) a full join (select row, col + 10 as col, value from low) b on a.row = b.row and a.col = b.col")

_HORN = """g as (select a.row, a.col, sum(b.value * (b.col - a.col) * (case when b.row = a.row then 2 else 1 end)) / 80e0 as dzdx, sum(b.value * (a.row - b.row) * (case when b.col = a.col then 2 else 1 end)) / 80e0 as dzdy
  from dem a join dem b on b.row between a.row - 1 and a.row + 1 and b.col between a.col - 1 and a.col + 1 group by 1, 2 having count(*) = 9)"""
_terrain = f"{_DEM}, {_HORN}"
_algebra("slope", lambda s, d: raster.slope(_dem(s, d), CELLS), "select row, col, degrees(atan(sqrt(dzdx * dzdx + dzdy * dzdy))) as value from g", _terrain)
_algebra("aspect", lambda s, d: raster.aspect(_dem(s, d), CELLS), "select row, col, case when dzdx = 0 and dzdy = 0 then -1e0 else (degrees(atan2(-dzdx, -dzdy)) + 360e0) % 360e0 end as value from g", _terrain)
_algebra("hillshade", lambda s, d: raster.hillshade(_dem(s, d), CELLS), "select row, col, 255e0 * (cos(radians(45e0)) * cos(atan(sqrt(dzdx * dzdx + dzdy * dzdy))) + sin(radians(45e0)) * sin(atan(sqrt(dzdx * dzdx + dzdy * dzdy))) * cos(radians(315e0) - atan2(-dzdx, -dzdy))) as value from g", _terrain)
_algebra("pit_free", lambda s, d: raster.pit_free(_dem(s, d)), "select row, col, greatest(value, max(value) over (partition by floor(row / 2e0), floor(col / 2e0)), max(value) over (partition by floor(row / 4e0), floor(col / 4e0))) as value from dem", _DEM)
_algebra("resample_nearest", lambda s, d: raster.resample(_dem(s, d), CELLS, Raster(0.0, 200.0, 4.0, 50, 50)), "select r.i as row, c.i as col, value from dem join (select range as i from range(50)) r on floor((r.i + 5e-1) * 4e0 / 10e0) = dem.row join (select range as i from range(50)) c on floor((c.i + 5e-1) * 4e0 / 10e0) = dem.col", _DEM)
_algebra("fill_holes", lambda s, d: raster.fill_holes(_holed(s, d), FINE, 12.0),
         """select row, col, value from dem union all select row, col, value from (select h.row, h.col, d.value, row_number() over (partition by h.row, h.col order by pow(h.row - d.row, 2) + pow(h.col - d.col, 2), d.row, d.col) as k
         from (select r.range as row, c.range as col from range(50) r, range(50) c) h join dem d on pow(h.row - d.row, 2) + pow(h.col - d.col, 2) <= 9
         where not exists (select 1 from dem e where e.row = h.row and e.col = h.col)) where k = 1""", _HOLED)  # fmt: skip
_algebra("median3", lambda s, d: raster.median(_holed(s, d), FINE),
         """select a.row, a.col, quantile_cont(d.value, 0.5) as value from dem a, (select r.range - 1 as dr, c.range - 1 as dc from range(3) r, range(3) c) o
         join dem d on d.row = (case when a.row + dr < 0 then 1 when a.row + dr > 49 then 48 else a.row + dr end) and d.col = (case when a.col + dc < 0 then 1 when a.col + dc > 49 then 48 else a.col + dc end) group by 1, 2""", _HOLED)  # fmt: skip
_algebra("smooth_gaussian", lambda s, d: raster.smooth(_holed(s, d), FINE, 1.0),
         """select a.row, a.col, sum(d.value * exp(-(dr * dr + dc * dc) / 2e0)) / sum(exp(-(dr * dr + dc * dc) / 2e0)) as value from dem a, (select r.range - 4 as dr, c.range - 4 as dc from range(9) r, range(9) c) o
         join dem d on d.row = (case when a.row + dr < 0 then -1 - (a.row + dr) when a.row + dr > 49 then 99 - (a.row + dr) else a.row + dr end)
         and d.col = (case when a.col + dc < 0 then -1 - (a.col + dc) when a.col + dc > 49 then 99 - (a.col + dc) else a.col + dc end) group by 1, 2""", _HOLED)  # fmt: skip


@query(f"with {P}, {_HOLED} select min(row) as row_min, max(row) as row_max, min(col) as col_min, max(col) as col_max from dem")
def crop_bounds(spark, sf_dir):
    return raster.valid_bounds(_holed(spark, sf_dir))


@query(f"with {P}, {_DEM} select round(quantile_cont(value, 0.02), 6) as low, round(quantile_cont(value, 0.98), 6) as high from dem")
def stretch_percentiles(spark, sf_dir):
    return rounded(raster.stretch(_dem(spark, sf_dir)))


_BANDS = {"b1": "avg(intensity % 100)", "b2": "avg(intensity % 251)", "b3": "avg(intensity % 509)", "b4": "avg(intensity % 1021)", "b5": "avg(intensity % 2039)"}
_BAND_SQL = f"bands as (select row, col, {', '.join(f'{e} as {b}' for b, e in _BANDS.items())} from (select *, {C4} from points) where return_number = 1 group by 1, 2)"


def _bands(spark, sf_dir) -> DataFrame:
    cells = surfaces.in_cells(line_points(spark, sf_dir).where("return_number = 1"), FINE)
    return cells.groupBy("row", "col").agg(*[F.expr(e).alias(b) for b, e in _BANDS.items()])


for _index, _over, _under in (("ndvi", "b5 - b3", "b5 + b3"), ("ndre", "b5 - b4", "b5 + b4"), ("gndvi", "b5 - b2", "b5 + b2"), ("savi", "(b5 - b3) * 15e-1", "b5 + b3 + 5e-1"), ("vari", "b2 - b3", "b2 + b3 - b1"), ("gli", "2 * b2 - b3 - b1", "2 * b2 + b3 + b1"), ("custom", "b4 - b1", "b4 + b1")):
    _algebra(f"index_{_index}", lambda s, d, i=_index: raster.vegetation_index(_bands(s, d), i, {"a": 4, "b": 1} if i == "custom" else None), f"select row, col, least(greatest(({_over}) / ({_under}), -1e0), 1e0) as value from bands where ({_under}) <> 0", _BAND_SQL)

# --- vegetation --------------------------------------------------------------------------

_VEG = f"""t as (select *, {TILE} from points where {SEEN}), level as (select tile_col, tile_row, quantile_cont(z, 0.5) as g from t where classification = 2 group by 1, 2),
  veg as (select cast(floor(x / 10e0) as bigint) as cell_col, cast(floor(y / 10e0) as bigint) as cell_row, cast(floor(least(greatest(z - g, 0e0), 60e0)) as bigint) as bin from t join level using (tile_col, tile_row) where classification not in (2, 7, 18))"""


def _veg(spark, sf_dir) -> DataFrame:
    return metrics.vegetation_partial(metrics.vegetation_heights(tiling.with_tiles(line_points(spark, sf_dir), TILES)), 10.0)


@query(f"with {P}, {_VEG} select cell_col, cell_row, bin, count(*) as n from veg group by 1, 2, 3")
def veg_hist(spark, sf_dir):
    return _veg(spark, sf_dir).select("cell_col", "cell_row", F.posexplode("bins").alias("bin", "n")).where("n > 0").select("cell_col", "cell_row", F.col("bin").cast("long").alias("bin"), "n")


def _pct(p: int) -> str:
    return f"(select b.bin + case when b.c > 0 then least(greatest(({p / 100}e0 * w.n - b.below) / b.c, 0e0), 1e0) else 5e-1 end from cum b where b.cell_col = w.cell_col and b.cell_row = w.cell_row and b.below + b.c >= {p / 100}e0 * w.n order by b.bin limit 1) as p{p}"


_VEG_FINAL = f"""with {P}, {_VEG}, w as (select cell_col, cell_row, count(*) as n, count(*) filter (bin >= 2) as canopy, count(*) filter (bin < 2) as s0, count(*) filter (bin between 2 and 9) as s1, count(*) filter (bin >= 10) as s2 from veg group by 1, 2),
  bins as (select w.cell_col, w.cell_row, r.range as bin, count(veg.bin) as c from w cross join range(61) r left join veg on veg.cell_col = w.cell_col and veg.cell_row = w.cell_row and veg.bin = r.range group by 1, 2, 3),
  cum as (select *, coalesce(sum(c) over (partition by cell_col, cell_row order by bin rows between unbounded preceding and 1 preceding), 0) as below from bins),
  f as (select cell_col, cell_row, sum(case when c > 0 then -(c / cast(n as double)) * ln(c / cast(n as double)) else 0e0 end) as fhd from bins join w using (cell_col, cell_row) group by 1, 2),
  q as (select w.*, canopy / cast(n as double) as cover, {', '.join(_pct(p) for p in (10, 25, 50, 75, 90, 95, 99))} from w)
  select cell_col, cell_row, n as point_count, round(cover, 6) as cover, round(case when cover <= 0 then 0e0 else least(5e0, -ln(greatest(1 - cover, 1e-9)) / 5e-1) end, 6) + 0e0 as lai, round(1 - cover, 6) as vci, round(fhd, 6) as fhd,
  round((case when s0 > 0 then -(s0 / cast(n as double)) * ln(s0 / cast(n as double)) else 0e0 end) + (case when s1 > 0 then -(s1 / cast(n as double)) * ln(s1 / cast(n as double)) else 0e0 end) + (case when s2 > 0 then -(s2 / cast(n as double)) * ln(s2 / cast(n as double)) else 0e0 end), 6) + 0e0 as shannon_h,
  round(s0 / cast(n as double), 6) as low_density, round(s1 / cast(n as double), 6) as mid_density, round(s2 / cast(n as double), 6) as high_density,
  {r6('p10', 'p25', 'p50', 'p75', 'p90', 'p95', 'p99')}, round(case when p90 <> p10 then (p90 - 2 * p50 + p10) / (p90 - p10) end, 6) + 0e0 as l_skewness from q join f using (cell_col, cell_row)"""


@query(_VEG_FINAL)
def veg_metrics(spark, sf_dir):
    return rounded(metrics.vegetation_final(_veg(spark, sf_dir)))


@query(_VEG_FINAL)
def consolidate_vegetation(spark, sf_dir):
    """Finished tables of two batches as one: the same as that of the whole."""
    h = metrics.vegetation_heights(tiling.with_tiles(line_points(spark, sf_dir), TILES))
    halves = [metrics.vegetation_final(metrics.vegetation_partial(h.where(t), 10.0), bins=True) for t in (F.col("x") < 97.5, F.col("x") >= 97.5)]
    return rounded(metrics.consolidate_vegetation(*halves))


@query(f"with {P}, {_VEG} select cell_col, cell_row, bin, 2 * count(*) as n from veg group by 1, 2, 3")
def veg_hist_merged(spark, sf_dir):
    v = _veg(spark, sf_dir)
    return metrics.merge_histograms(v, v).select("cell_col", "cell_row", F.posexplode("bins").alias("bin", "n")).where("n > 0").select("cell_col", "cell_row", F.col("bin").cast("long").alias("bin"), "n")


@query(f"""with {P}, {_LOW}, veg as (select cast(floor(x / 10e0) as bigint) as cell_col, cast(floor(y / 10e0) as bigint) as cell_row, cast(floor(least(greatest(z - value, 0e0), 60e0)) as bigint) as bin
  from (select *, cast(floor((200e0 - y) / 10e0) as bigint) as row, cast(floor(x / 10e0) as bigint) as col from points where {SEEN} and classification not in (2, 7, 18)) join low using (row, col))
  select cell_col, cell_row, bin, count(*) as n from veg group by 1, 2, 3""")
def veg_dtm_normalised(spark, sf_dir):
    v = metrics.vegetation_partial(metrics.vegetation_above(line_points(spark, sf_dir), _low(spark, sf_dir), CELLS), 10.0)
    return v.select("cell_col", "cell_row", F.posexplode("bins").alias("bin", "n")).where("n > 0").select("cell_col", "cell_row", F.col("bin").cast("long").alias("bin"), "n")


# --- tiling --------------------------------------------------------------------------------


@query(f"""with {P}, near as (select c.range as tile_col, r.range as tile_row, p.x, p.y, p.z, least(greatest(floor(p.x / 50e0), 0), 3) = c.range and least(greatest(floor(p.y / 50e0), 0), 3) = r.range as core from points p, range(4) c, range(4) r
  where c.range between least(greatest(floor((p.x - 30e0) / 50e0), 0), 3) and least(greatest(floor((p.x + 30e0) / 50e0), 0), 3) and r.range between least(greatest(floor((p.y - 30e0) / 50e0), 0), 3) and least(greatest(floor((p.y + 30e0) / 50e0), 0), 3))
  select tile_col, tile_row, count(*) filter (core) as point_count, count(*) as buffered_count, min(x) filter (core) as x_min, max(x) filter (core) as x_max, min(y) filter (core) as y_min, max(y) filter (core) as y_max, min(z) filter (core) as z_min, max(z) filter (core) as z_max from near group by 1, 2""")
def tile_buffer_counts(spark, sf_dir):
    """A buffer of 30 m on tiles of 50 m: wider than half a tile."""
    return tiling.tile_counts(line_points(spark, sf_dir), TILES, 30.0)


@query(f"with {P} select {TILE}, count(*) as n, round(sum(z), 3) as z_sum from points group by 1, 2")
def tile_core_counts(spark, sf_dir):
    own = tiling.core_only(tiling.with_tiles(line_points(spark, sf_dir), TILES, 30.0))
    return own.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 3).alias("z_sum"))


_SUB = f"""s as (select {TILE}, x, y from points where not (x < 50 and y < 50) or (return_number = 1)), fine as (select tile_col, tile_row, cast(least(greatest(floor((x - tile_col * 50e0) * 16 / 50e0), 0), 15) as bigint) as a, cast(least(greatest(floor((y - tile_row * 50e0) * 16 / 50e0), 0), 15) as bigint) as b, count(*) as n from s group by 1, 2, 3, 4),
  most as (select tile_col, tile_row, level, max(m) as most from (select tile_col, tile_row, level, a // cast(pow(2, 4 - level) as bigint) as i, b // cast(pow(2, 4 - level) as bigint) as j, sum(n) as m from fine, (select range as level from range(5)) group by 1, 2, 3, 4, 5) group by 1, 2, 3),
  levels as (select tile_col, tile_row, coalesce(min(level) filter (most <= 900), 4) as level from most group by 1, 2)"""


def _sub(spark, sf_dir) -> DataFrame:
    return line_points(spark, sf_dir).where("not (x < 50 and y < 50) or return_number = 1")


@query(f"with {P}, {_SUB} select tile_col, tile_row, cast(level as integer) as level from levels")
def subdivide_levels(spark, sf_dir):
    return tiling.subdivision_levels(_sub(spark, sf_dir), TILES, 1000)


@query(f"with {P}, {_SUB} select tile_col, tile_row, cast(level as integer) as level, cast(floor((x - tile_col * 50e0) * pow(2, level) / 50e0) as bigint) as sub_col, cast(floor((y - tile_row * 50e0) * pow(2, level) / 50e0) as bigint) as sub_row, count(*) as n from s join levels using (tile_col, tile_row) group by 1, 2, 3, 4, 5")
def subtile_counts(spark, sf_dir):
    p = _sub(spark, sf_dir)
    return tiling.with_subtiles(p, TILES, tiling.subdivision_levels(p, TILES, 1000)).groupBy("tile_col", "tile_row", "level", "sub_col", "sub_row").agg(F.count(F.lit(1)).alias("n"))


#: Tiles of 25 m, dense in the west; parts of a sixteenth of their side.
_ADAPT = """s as (select x, y, least(cast(floor(x / 25e0) as bigint), 7) as c, least(cast(floor(y / 25e0) as bigint), 7) as r from points where x < 100 or classification = 6),
  fine as (select c, r, least(cast(floor((x - c * 25e0) * 16 / 25e0) as bigint), 15) as a, least(cast(floor((y - r * 25e0) * 16 / 25e0) as bigint), 15) as b, count(*) as n from s group by 1, 2, 3, 4),
  up as (select c, r, l.range as level, a // (16 >> cast(l.range as integer)) as a, b // (16 >> cast(l.range as integer)) as b, sum(n) as n from fine, range(5) l group by all),
  levels as (select c, r, coalesce(min(level) filter (most <= 450), 4) as level from (select c, r, level, max(n) as most from up group by all) group by all),
  counts as (select c, r, level, sum(n) as n from fine join levels using (c, r) group by all),
  spans as (select c, r, level, """ + " ".join(f"sum(n) over (partition by c // {k}, r // {k}) as n{k}, max(level) over (partition by c // {k}, r // {k}) as l{k}," for k in (2, 4, 8)) + """ 0 as z from counts),
  plan as (select c, r, level, case when n8 <= 800 and l8 = 0 then 8 when n4 <= 800 and l4 = 0 then 4 when n2 <= 800 and l2 = 0 then 2 else 1 end as span from spans),
  leaves as (select distinct (c // span) * span * 16 + a * (16 >> cast(level as integer)) as tile_col, (r // span) * span * 16 + b * (16 >> cast(level as integer)) as tile_row, span * (16 >> cast(level as integer)) as side from up join plan using (c, r, level)),
  near as (select tile_col, tile_row, x >= tile_col * 15625e-4 and x < (tile_col + side) * 15625e-4 and y >= tile_row * 15625e-4 and y < (tile_row + side) * 15625e-4 as core
    from leaves join s on x + 5 >= tile_col * 15625e-4 and x - 5 < (tile_col + side) * 15625e-4 and y + 5 >= tile_row * 15625e-4 and y - 5 < (tile_row + side) * 15625e-4)"""


@query(f"with {P}, {_ADAPT} select tile_col, tile_row, count(*) filter (core) as point_count, count(*) as buffered_count from near group by 1, 2 having point_count > 0")
def adaptive_tiles(spark, sf_dir):
    """Dense tiles subdivided, sparse ones merged, all with a buffer of 5 m."""
    p = line_points(spark, sf_dir).where("x < 100 or classification = 6")
    tiled = tiling.with_adaptive_tiles(p, Tiles(0.0, 0.0, 25.0, 8, 8), 5.0, 500, 800)
    return tiled.groupBy("tile_col", "tile_row").agg(F.count(F.when(F.col("is_core"), 1)).alias("point_count"), F.count(F.lit(1)).alias("buffered_count")).where("point_count > 0")


def _event_counts(spark, sf_dir) -> dict[tuple[int, int], int]:
    """Of tiles, one number each: what a tiling plan is made from."""
    rows = tiling.with_tiles(event_points(spark, sf_dir).where("x + y < 120"), Tiles(0.0, 0.0, 6.25, 16, 16)).groupBy("tile_col", "tile_row").count().collect()
    return {(r["tile_col"], r["tile_row"]): r["count"] for r in rows}


_EC = f"ec as (select least(cast(floor(x / 625e-2) as bigint), 15) as c, least(cast(floor(y / 625e-2) as bigint), 15) as r, count(*) as n from points where x + y < 120 group by 1, 2)"
_STEP = """k{k} as (select c // 2 as c, r // 2 as r, sum(n) as n, bool_and(ok) and sum(n) <= (select sum(n) / 20 from ec) as ok from k{j} group by 1, 2)"""


@query(f"""with {E}, {_EC}, k1 as (select c, r, n, true as ok from ec), {_STEP.format(k=2, j=1)}, {_STEP.format(k=4, j=2)}, {_STEP.format(k=8, j=4)},
  a as (select k1.c, k1.r, k1.n, case when k8.ok then 8 when k4.ok then 4 when k2.ok then 2 else 1 end as span from k1 join k2 on k2.c = k1.c // 2 and k2.r = k1.r // 2 join k4 on k4.c = k1.c // 4 and k4.r = k1.r // 4 join k8 on k8.c = k1.c // 8 and k8.r = k1.r // 8)
  select cast(c // span * span as bigint) as col, cast(r // span * span as bigint) as row, cast(span as bigint) as span, count(*) as members, cast(sum(n) as bigint) as point_count from a group by 1, 2, 3""")
def sparse_merge(spark, sf_dir):
    """The plan as a table, for any number of tiles; only their total comes to the driver."""
    own = tiling.with_tiles(event_points(spark, sf_dir).where("x + y < 120"), Tiles(0.0, 0.0, 6.25, 16, 16)).groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("n")).withColumn("locked", F.lit(False))
    total = own.agg(F.sum("n")).first()[0] or 0
    spans = tiling.merged_spans(own, total // 20).join(own, ["tile_col", "tile_row"])
    at = [(F.floor(F.col(c) / F.col("span")) * F.col("span")).cast("long").alias(n) for c, n in (("tile_col", "col"), ("tile_row", "row"))]
    return spans.groupBy(*at, F.col("span").cast("long").alias("span")).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("point_count"))


@query(f"""with recursive {E}, {_EC}, o as (select row_number() over (order by r, c) as k, r, c, n from ec), cap as (select cast(ceil(sum(n) / 7e0) as bigint) as cap from ec),
  b as (select k, r, c, n, n as used, cast(1 as bigint) as batch from o where k = 1 union all
  select o.k, o.r, o.c, o.n, case when b.used + o.n > cap then o.n else b.used + o.n end, case when b.used + o.n > cap then b.batch + 1 else b.batch end from b join o on o.k = b.k + 1, cap)
  select batch, r as tile_row, c as tile_col from b""")
def batches(spark, sf_dir):
    counts = _event_counts(spark, sf_dir)
    runs = tiling.batches([(r, c, n) for (c, r), n in counts.items()], -(-sum(counts.values()) // 7))
    return spark.createDataFrame([(i + 1, *key) for i, run in enumerate(runs) for key in run], "batch long, tile_row long, tile_col long")


# --- neighbours ---------------------------------------------------------------------------------

_NEAR = f"""t as (select *, {ETILE} from points), d as (select a.point_id, a.tile_col, a.tile_row, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) as d from t a join t b using (tile_col, tile_row) where a.point_id <> b.point_id),
  k as (select *, row_number() over (partition by point_id order by d) as k from d)"""
_TAGGED = "select point_id, classification"


def _tiled(spark, sf_dir) -> DataFrame:
    return tiling.with_tiles(event_points(spark, sf_dir), EVENT_TILES).drop("is_core")


@query(f"""with {E}, {_NEAR}, m as (select point_id, tile_col, tile_row, avg(d) as m from k where k <= 6 group by 1, 2, 3), s as (select *, avg(m) over (partition by tile_col, tile_row) + 2 * stddev_pop(m) over (partition by tile_col, tile_row) as lim from m)
  select point_id, case when (s.m <= s.lim + 1e-12 or classification = 2) and not withheld then classification else 7 end as classification from points join s using (point_id)""")
def sor(spark, sf_dir):
    return neighbours.statistical_outliers(_tiled(spark, sf_dir), 6, 2.0).select("point_id", "classification")


@query(f"""with {E}, {_NEAR}, m as (select point_id, count(*) filter (d <= 1.5) as n from d group by 1)
  select point_id, case when (n + 1 >= 4 or classification = 2) and not withheld then classification else 18 end as classification from points join m using (point_id)""")
def ror(spark, sf_dir):
    return neighbours.radius_outliers(_tiled(spark, sf_dir), 1.5, 4, target_class=18).select("point_id", "classification")


@query(f"with {E} select a.point_id, count(b.point_id) as neighbours from points a left join points b on a.point_id <> b.point_id and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 1.5 * 1.5 group by 1")
def radius_counts(spark, sf_dir):
    return neighbours.radius_counts(event_points(spark, sf_dir), 1.5)


_TER = "ter as (select case when y = 0 then 9 else cast(floor((100e0 - y) / 10e0) as bigint) end as row, cast(floor(x / 10e0) as bigint) as col, min(z) as value from points where not withheld and classification = 2 group by 1, 2)"
_BIL = """b as (select *, (x - 0e0) / 10e0 - 5e-1 as cf, (100e0 - y) / 10e0 - 5e-1 as rf from points),
  s as (select b.point_id, b.x, b.y, b.z, b.withheld, case when count(t.value) = 4 then sum(t.value * (case when t.row = floor(rf) then 1 - (rf - floor(rf)) else rf - floor(rf) end) * (case when t.col = floor(cf) then 1 - (cf - floor(cf)) else cf - floor(cf) end)) end as h
  from b left join ter t on t.row in (cast(floor(rf) as bigint), cast(floor(rf) as bigint) + 1) and t.col in (cast(floor(cf) as bigint), cast(floor(cf) as bigint) + 1) group by all)"""


def _terrain_cells(spark, sf_dir) -> DataFrame:
    return surfaces.dtm(event_points(spark, sf_dir), TERRAIN)


# Heights are multiples of 1e-10: of millimetres, few lie halfway between two.
for _name, _sign, _run in (("normalise_heights", "-", neighbours.normalise_heights), ("denormalise_heights", "+", neighbours.denormalise_heights)):
    query(f"with {E}, {_TER}, {_BIL} select point_id, round(case when h is not null and not withheld then z {_sign} h else z end, 3) + 0e0 as z from s", _name)(lambda s, d, f=_run: rounded(f(event_points(s, d), _terrain_cells(s, d), TERRAIN).select("point_id", "z"), 3))

# --- tables --------------------------------------------------------------------------------------


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey, '' as r_regionkey, '' as r_name from nation union all select '', '', '', cast(r_regionkey as varchar), r_name from region")
def concat_union(spark, sf_dir):
    return tables.concatenate(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region")])


@query("select cast(c_custkey as varchar) as c_custkey, c_name, c_mktsegment, '' as s_name from customer union all select '', '', '', s_name from supplier")
def consolidate_table(spark, sf_dir):
    c, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    return tables.consolidate_tables(c.select("c_custkey", "c_name", "c_mktsegment"), s.select("s_name"))


@query("select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_regionkey = 1")
def consolidate_vectors(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return tables.consolidate_vectors(n.select("n_nationkey", "n_name"), n.where("n_regionkey = 1").select("n_nationkey", "n_name"))


@query("select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority from orders order by orders.o_orderkey limit 100 offset 250")
def page_limit_offset(spark, sf_dir):
    return tables.page(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 100, 250)


@query(f"with {P} select distinct point_source_id, classification from points")
def distinct_pairs(spark, sf_dir):
    return tables.distinct_pairs(line_points(spark, sf_dir), "point_source_id", "classification")


# --- reports -----------------------------------------------------------------------------------------


@query(f"""with {P}, f as (select count(*) as point_count, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, min(z) as z_min, max(z) as z_max, min(intensity) as intensity_min, max(intensity) as intensity_max, min(gps_time) as gps_min, max(gps_time) as gps_max,
  min(scan_angle) as scan_min, max(scan_angle) as scan_max, round(avg(scan_angle), 6) as scan_mean, round(100e0 * count(*) filter (abs(scan_angle) > 30) / count(*), 6) as steep_pct, count(*) filter (return_number = 1) as first_returns,
  round(100e0 * count(*) filter (return_number = 1 and number_of_returns > 1) / count(*) filter (return_number = 1), 6) as multi_return_pct, {', '.join(f"round(100e0 * count(*) filter ({f}) / count(*), 6) as {f}_pct" for f in ("withheld", "overlap", "synthetic", "key_point"))} from points)
  select *, round((x_max - x_min) * (y_max - y_min), 6) as area, case when greatest(x_max - x_min, y_max - y_min) / least(x_max - x_min, y_max - y_min) >= 4 then 'LINEAR_CORRIDOR' else 'BLOCK_POLYGON' end as aspect, round(point_count / ((x_max - x_min) * (y_max - y_min)), 6) as density from f""")
def file_info_summary(spark, sf_dir):
    return rounded(report.with_shape(report.summary(line_points(spark, sf_dir))))


@query(f"with {P} select classification as value, count(*) as n from points group by 1")
def class_histogram(spark, sf_dir):
    return report.histogram(line_points(spark, sf_dir), "classification")


@query(f"with {P} select least(return_number, 5) as return_number, count(*) as n from points group by 1")
def return_histogram(spark, sf_dir):
    return report.return_histogram(line_points(spark, sf_dir), 5)


@query(f"with {P} " + " union all ".join(f"select '{f}' as flag, count(*) filter ({f}) as n from points" for f in ("withheld", "overlap", "synthetic", "key_point")))
def flag_census(spark, sf_dir):
    return report.flag_census(line_points(spark, sf_dir))


@query(f"""with {P}, b as (select count(*) filter (return_number = 1 and not overlap and not withheld) as n, count(*) filter (return_number = 1) as f, (max(x) - min(x)) * (max(y) - min(y)) as area from points)
  select round(n / area, 6) as usgs_npd, round(pow(n / area, -0.5), 6) as nps, pow(n / area, -0.5) <= 0.35 and n / area >= 8 as compliant, round(f / area, 4) as npd_first from b""")
def usgs_density(spark, sf_dir):
    return report.usgs_density(line_points(spark, sf_dir))


@query(f"""with {P}, flat as (select floor(x / 5e0) as cx, floor(y / 5e0) as cy, point_source_id, avg(z / 100e0) as m from points group by 1, 2, 3 having count(*) >= 5 and max(z / 100e0) - min(z / 100e0) <= 0.5)
  select count(*) as pairs, round(sqrt(avg(pow(a.m - b.m, 2))), 6) as rmsdz, coalesce(round(sqrt(avg(pow(a.m - b.m, 2))), 6) <= 0.08, false) as ok from flat a join flat b on a.cx = b.cx and a.cy = b.cy and a.point_source_id < b.point_source_id""")
def strip_rmsd(spark, sf_dir):
    return report.strip_agreement(line_points(spark, sf_dir).withColumn("z", F.col("z") / F.lit(100.0)))


# --- files: what is written is read again --------------------------------------------------------------


def _path(spark, name: str) -> str:
    """A new place in the shared folder, which these formats reach as files."""
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError("these formats need a shared folder that is mounted")
    return f"{where.path}/{uuid.uuid4().hex}-{name}"


_LAS = ("intensity", "return_number", "number_of_returns", "classification", "point_source_id")
_FLAGS = ("withheld", "overlap", "synthetic", "key_point")


def _las(spark, sf_dir, where: str = "true") -> str:
    path = _path(spark, "survey.las")
    las.write_las(line_points(spark, sf_dir).where(where), path)
    return path


@query(f"with {P} select {', '.join(f'cast(round({c} * 1000) as bigint) as {c}' for c in 'xyz')}, {', '.join(f'cast({c} as bigint) as {c}' for c in _LAS)}, cast(scan_angle as bigint) as scan_angle, gps_time, {', '.join(_FLAGS)} from points")
def las_round_trip(spark, sf_dir):
    """A survey as a LAS file, in millimetres."""
    got = las.read_las(spark, _las(spark, sf_dir))
    return got.select(*[F.round(F.col(c) * 1000).cast("long").alias(c) for c in "xyz"], *[F.col(c).cast("long").alias(c) for c in _LAS], F.round("scan_angle").cast("long").alias("scan_angle"), "gps_time", *_FLAGS)


@query(f"with {P} select src, count(*) as n, count(distinct point_id // 1099511627776) as files, count(distinct point_id) as ids from (select case when x < 100 then 0 else 1 end as src, (case when x < 100 then 0 else 1099511627776 end) + row_number() over (partition by x < 100) as point_id from points) group by 1")
def las_folder_ids(spark, sf_dir):
    """Two files of a folder: ids are unique over both."""
    folder = _path(spark, "folder")
    os.makedirs(folder)
    for i, where in enumerate(("x < 100", "x >= 100")):
        las.write_las(line_points(spark, sf_dir).where(where), f"{folder}/{i}.las")
    got = las.read_las(spark, folder).select(F.substring("src", 1, 1).cast("int").alias("src"), "point_id")
    return got.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.shiftright("point_id", las.FILE_BITS)).alias("files"), F.countDistinct("point_id").alias("ids"))


@query(f"with {P}, h as (select x < 100 as west, count(*) as n, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from points group by 1) select cast(sum(n) as bigint) as points, round((max(x1) - min(x0)) * (max(y1) - min(y0)), 6) as area from h where greatest(abs(x0), abs(x1)) > 180 or greatest(abs(y0), abs(y1)) > 90")
def las_union_area(spark, sf_dir):
    """Points and the box around two files, by their headers."""
    heads = [las.read_header(_las(spark, sf_dir, w)) for w in ("x < 100", "x >= 100")]
    n, area = las.union_area(heads)
    return spark.createDataFrame([(n, round(area, 6))], "points long, area double")


@query(f"with {P}, {_CELL} select row, col, round(min(z), 6) + 0e0 as value from cells where {SEEN} and classification = 2 group by 1, 2")
def geotiff_round_trip(spark, sf_dir):
    path = _path(spark, "dtm.tif")
    grids.write_geotiff(_low(spark, sf_dir), CELLS, path)
    return rounded(grids.read_geotiff(spark, path)[1].select("row", "col", "value"))


@query(f"with {P}, {_CELL} select row, col, round(avg(z), 6) + 0e0 as value from cells where {SEEN} group by 1, 2")
def ascii_grid_round_trip(spark, sf_dir):
    path = _path(spark, "dsm.asc")
    grids.write_ascii(surfaces.dsm(line_points(spark, sf_dir), CELLS, "mean"), CELLS, path)
    return rounded(grids.read_ascii(spark, path)[1].select("row", "col", "value"))


@query("select cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_nationkey as varchar) as s_nationkey from supplier")
def csv_round_trip(spark, sf_dir):
    path = _path(spark, "suppliers")
    vectors.write_csv_twin(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey"), path)
    return vectors.read_csv(spark, path)


@query(f"with {P}, partial as ({_PARTIAL}), final as ({_FINAL}) select gid, cast(point_count as double) as point_count, round(z_mean, 6) as z_mean, cast(93 as integer) as geom_bytes from final")
def gpkg_round_trip(spark, sf_dir):
    path = _path(spark, "cells.gpkg")
    vectors.write_gpkg(metrics.grid_metrics(line_points(spark, sf_dir), 10.0).select("cell_col", "cell_row", "gid", "point_count", "z_mean"), path, res=10.0)
    return vectors.read_gpkg(spark, path).select("gid", "point_count", F.round("z_mean", 6).alias("z_mean"), F.length("geom").alias("geom_bytes"))


@query("select cast(n_nationkey as varchar) as key, n_name as name, 'Point' as kind from nation")
def geojson_read(spark, sf_dir):
    path = _path(spark, "nations.json")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # the table has 25 rows
    features = [{"type": "Feature", "properties": {"key": r["n_nationkey"], "name": r["n_name"]}, "geometry": {"type": "Point", "coordinates": [r["n_nationkey"], 0]}} for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    return vectors.read_geojson(spark, path).select("key", "name", F.get_json_object("geometry", "$.type").alias("kind"))


@query(f"with {P}, p as (select *, {TILE} from points) select tile_col, tile_row, count(*) as n, round(sum(z), 3) as z_sum from p group by 1, 2")
def export_points(spark, sf_dir):
    """Buffered tiles of two halves as one table, without their buffers."""
    tiled = tiling.with_tiles(line_points(spark, sf_dir), TILES, 5.0)
    path = _path(spark, "export")
    sinks.export_points([tiled.where("x < 100"), tiled.where("x >= 100")], path)
    return spark.read.parquet(path).groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 3).alias("z_sum"))


@query(f"with {P} select count(*) as point_count, round(min(z), 6) as z_min, round(max(z), 6) as z_max, max(gps_time) as gps_max from points")
def file_info_json(spark, sf_dir):
    path = _path(spark, "info.json")
    vectors.write_json(report.with_shape(report.summary(line_points(spark, sf_dir))).first().asDict(), path)
    return spark.read.json(path, multiLine=True).select("point_count", F.round("z_min", 6).alias("z_min"), F.round("z_max", 6).alias("z_max"), F.col("gps_max").cast("double").alias("gps_max"))


# --- graphs, queues, streams ----------------------------------------------------------------------


def _node(name: str, spark, **given) -> DataFrame:
    return NODES[name].run(spark, **given, **{k: v for k, v in NODES[name].defaults.items() if k not in given})["raster"][1]


_cells("consolidate_dtm", lambda p: _node("consolidate_dtm_mosaic", p.sparkSession, rasters=[(CELLS, surfaces.dtm(p.where(t), CELLS)) for t in ("x < 100", "x >= 100")]), f"select row, col, min(z) as value from cells where {SEEN} and classification = 2 group by 1, 2")
_cells("consolidate_dsm", lambda p: _node("consolidate_dsm_mosaic", p.sparkSession, rasters=[(CELLS, surfaces.dsm(p.where(t), CELLS)) for t in ("x < 100", "x >= 100")]), f"select row, col, max(z) as value from cells where {SEEN} group by 1, 2")
_cells("consolidate_chm", lambda p: _node("consolidate_chm_mosaic", p.sparkSession, rasters=[(CELLS, surfaces.canopy_height(surfaces.dsm(p.where(t), CELLS), surfaces.dtm(p.where(t), CELLS), 0.0, 60.0)) for t in ("x < 100", "x >= 100")]),
       f"select row, col, least(greatest(d - g, 0e0), 60e0) as value from (select row, col, max(z) as d, min(z) filter (classification = 2) as g from cells where {SEEN} group by 1, 2) where g is not null")

_STEPS = {
    "format": "survey-graph", "version": 2,
    "nodes": [{"iid": "a", "id": "load_points", "config": {"tile_size": 50.0, "buffer": 5.0}}, {"iid": "b", "id": "class_filter", "config": {"classes": "2,5"}}, {"iid": "c", "id": "grid_metrics", "config": {"res": 10.0}}],
    "edges": [{"src": "a", "dst": "b", "out_type": "point_cloud", "in_type": "point_cloud"}, {"src": "b", "dst": "c", "out_type": "point_cloud", "in_type": "point_cloud"}],
}


def _table_of(spark, sf_dir, where: str) -> str:
    path = _path(spark, "points.parquet")
    line_points(spark, sf_dir).where(where).write.parquet(path)
    return path


_CHOSEN = f"with {P.replace('from lineitem)', 'from lineitem), chosen as (select * from points where classification in (2, 5))')}, partial as ({_PARTIAL.replace('from points', 'from chosen')}), final as ({_FINAL}) select {_replace(_DOUBLES)} from final"


@query(_CHOSEN)
def graph_project(spark, sf_dir):
    """A project of three steps: load, keep two classes, metrics."""
    g = over_files(Graph.parse(_STEPS), [_table_of(spark, sf_dir, "true")])[0]
    return rounded(g.compile(spark)["c"]["table"].drop(*metrics.SUMS))


@query(_CHOSEN)
def file_queue(spark, sf_dir):
    """The same project once for each of two files, and its tables consolidated."""
    files = [_table_of(spark, sf_dir, w) for w in ("x < 97.5", "x >= 97.5")]
    parts = [g.compile(spark)["c"]["table"] for g in over_files(Graph.parse(_STEPS), [*files, files[0]])]
    return rounded(metrics.consolidate_grid(*parts, res=10.0))


@query(f"with {P}, partial as ({_PARTIAL}), final as ({_FINAL}) select {_replace(_DOUBLES)} from final")
def stream_metrics(spark, sf_dir):
    """A folder of point tables as a stream of micro-batches, whose partials add up."""
    points = line_points(spark, sf_dir)
    folder, out = _path(spark, "arrivals"), _path(spark, "partials")
    points.repartition(3).write.parquet(folder)
    queue.accumulate(queue.watch(spark, folder, points.schema, 1), out, f"{out}-checkpoint", 10.0).awaitTermination()
    return rounded(queue.current(spark, out, 10.0))


@query(f"with {P}, partial as ({_PARTIAL}), final as ({_FINAL}) select gid, point_count, row_number() over (order by gid) - 1 as rank from final")
def order_by_gid(spark, sf_dir):
    """Keyed tables are in the order of gid as text."""
    return tables.ranked(metrics.grid_metrics(line_points(spark, sf_dir), 10.0).select("gid", "point_count"), ["gid"])


@query(f"with {P}, f as (select count(*) as n, 40000e0 as area from points), t as (select *, cast(ceil(area / 2500e0) as bigint) as tiles from f), p as (select *, cast(ceil(n / cast(tiles as double)) as bigint) as per_tile from t) select tiles, per_tile, 4 * per_tile * 64 as peak_bytes, cast(area * 12 as bigint) as mosaic_bytes, greatest(4 * per_tile * 64, area * 12) < 7e5 as fits, least(greatest(n // 3000, 50000), 2000000) as floor from p")
def preflight(spark, sf_dir):
    """What a run on the survey would need, and the floor for merging tiles."""
    n = line_points(spark, sf_dir).count()
    p = tiling.preflight(n, 40_000.0, 50.0, 4, 1_000_000)
    return spark.createDataFrame([(p.tiles, p.per_tile, p.peak_bytes, p.mosaic_bytes, p.fits, tiling.suggested_floor(n))], "tiles long, per_tile long, peak_bytes long, mosaic_bytes long, fits boolean, floor long")


# --- ground filters: iterative, beyond SQL; tests hold them against scenes of known ground -----------

for _method in ground.KERNELS:
    query(name=f"ground_{_method}")(lambda s, d, m=_method: ground.classify_ground(_tiled(s, d), m).groupBy("tile_col", "tile_row", "classification").agg(F.count(F.lit(1)).alias("n")))
