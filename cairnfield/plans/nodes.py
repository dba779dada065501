"""The steps of a graph: what they take, give and are set by, and the operator that runs them.

A step's function gets its inputs by port name and its settings, and returns its outputs by port
name. All values are lazy: DataFrames, or rasters as (Raster, DataFrame).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import Raster, Tiles
from ..operators import ground, metrics, neighbours, points, raster, surfaces, tables, tiling
from ..operators.tables import consolidate_tables, consolidate_vectors


@dataclass(frozen=True)
class Node:
    id: str
    inputs: dict[str, str]
    outputs: dict[str, str]
    defaults: dict[str, Any]
    run: Callable[..., dict[str, Any]]
    many: frozenset[str] = field(default_factory=frozenset)  # inputs that take any number of edges
    optional: frozenset[str] = field(default_factory=frozenset)


NODES: dict[str, Node] = {}


def node(id: str, inputs: dict[str, str], outputs: dict[str, str], many: tuple[str, ...] = (), optional: tuple[str, ...] = (), **defaults):
    def keep(run):
        NODES[id] = Node(id, inputs, outputs, defaults, run, frozenset(many), frozenset(optional))
        return run

    return keep


def cover(df, res: float) -> Raster:
    """The raster of a point table's extent; one row comes to the driver."""
    b = df.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return Raster.over(*[float(v or 0) for v in b], res)


PTS = {"points": "point_cloud"}


def _points_node(id: str, run, **defaults) -> None:
    node(id, PTS, PTS, **defaults)(lambda spark, points, **s: {"points": run(points, **s)})


@node("load_points", {}, PTS, path="", tile_size=100.0, buffer=10.0, max_points_per_tile=0, merge_sparse_below=0)
def _load(spark: SparkSession, path: str, tile_size: float, buffer: float, max_points_per_tile: int, merge_sparse_below: int) -> dict:
    if path.endswith(".las"):
        from ..sources.las import read_las

        df = read_las(spark, path)
    else:
        df = spark.read.parquet(path)
    b = df.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    tiles = Tiles.over(*[float(v or 0) for v in b], tile_size)
    if max_points_per_tile or merge_sparse_below:
        return {"points": tiling.with_adaptive_tiles(df, tiles, buffer, max_points_per_tile, merge_sparse_below)}
    return {"points": tiling.with_tiles(df, tiles, buffer)}


_points_node("elevation_range", points.elevation_range, low=-100.0, high=100_000.0, action="classify", target_class=7, protect_ground=True)
_points_node("intensity_range", points.intensity_range, low=0.0, high=65_535.0, action="classify", target_class=7, protect_ground=True)
_points_node("scan_angle", points.scan_angle_range, low=-90.0, high=90.0, action="classify", target_class=7, protect_ground=True)
_points_node("return_filter", points.by_return, mode="first")
_points_node("class_filter", points.by_class, classes="2", mode="keep")
_points_node("flag_filter", points.by_flags, mode="remove_overlap")
_points_node("clip_polygon", points.clip_polygon, polygon="", buffer=0.0)
_points_node("noise_sor", neighbours.statistical_outliers, k=6, multiplier=3.0, action="classify", target_class=7)
_points_node("noise_ror", neighbours.radius_outliers, radius=5.0, least=3, action="classify", target_class=18)
_points_node("decimate", lambda p, **s: points.decimate(p, by=("tile_col", "tile_row"), **s), mode="ratio", ratio=25.0, target=500_000, strategy="nth")
node("classify_ground", PTS, {"points": "classified_point_cloud"}, method="pmf")(lambda spark, points, method: {"points": ground.classify_ground(points, method)})


def _raster_node(id: str, output: str, run, **defaults) -> None:
    """fill (metres), sigma (cells) and median (cells) finish the raster, which is then cropped."""

    def go(spark, points, res, fill, sigma, median, **s):
        r = cover(points, res)
        cells = run(points, r, **s)
        return {"raster": raster.finish(cells, r, fill, sigma, median) if fill or sigma or median else (r, cells)}

    node(id, PTS, {"raster": output}, **({"fill": 0.0, "sigma": 0.0, "median": 0} | defaults))(go)


_raster_node("generate_dtm", "dtm_mosaic", lambda p, r, how: surfaces.dtm(p, r, how, ("tile_col", "tile_row")), res=1.0, how="min", fill=3.0, sigma=1.0)
_raster_node("generate_dsm", "dsm_mosaic", lambda p, r, how: surfaces.dsm(p, r, how), res=1.0, how="max", fill=1.5, sigma=0.5)
_raster_node("canopy_penetration", "canopy_penetration", lambda p, r: surfaces.canopy_penetration(p.where("is_core"), r), res=1.0)
_raster_node("flightline_coverage", "coverage_raster", lambda p, r, mode: surfaces.flightline_coverage(p.where("is_core"), r, mode), res=1.0, mode="coverage")
_raster_node("intensity_ortho", "intensity_ortho", lambda p, r, normalise, most_angle: surfaces.intensity_ortho(p, r, normalise, most_angle), res=0.5, normalise=True, most_angle=60.0, median=3)


@node("generate_chm", {"dsm": "dsm_mosaic", "dtm": "dtm_mosaic"}, {"raster": "chm_mosaic"}, low=0.0, high=60.0, pit_free=False)
def _chm(spark, dsm, dtm, low, high, pit_free):
    (r, top), (r2, bottom) = dsm, dtm
    cells = surfaces.canopy_height(top, raster.shift(bottom, *r.offset_of(r2)), low, high)
    return {"raster": (r, raster.pit_free(cells) if pit_free else cells)}


@node("chm_difference", {"a": "chm_mosaic", "b": "chm_mosaic"}, {"raster": "raster"})
def _difference(spark, a, b):
    return {"raster": (a[0], raster.difference(a[1], b[1], a[0], b[0]))}


for _kind in ("dtm_mosaic", "dsm_mosaic", "chm_mosaic", "raster"):
    node(f"merge_{_kind}", {"rasters": _kind}, {"raster": _kind}, many=("rasters",), how="first")(lambda spark, rasters, how: {"raster": raster.mosaic(rasters, how)})
    node(f"consolidate_{_kind}", {"rasters": _kind}, {"raster": _kind}, many=("rasters",))(lambda spark, rasters: {"raster": raster.mosaic(rasters, "first")})
for _name in ("slope", "aspect", "hillshade"):
    node(f"terrain_{_name}", {"dtm": "dtm_mosaic"}, {"raster": "raster"})(lambda spark, dtm, f=getattr(raster, _name): {"raster": (dtm[0], f(dtm[1], dtm[0]))})


@node("grid_metrics", PTS, {"table": "grid_metrics"}, res=1.0)
def _grid(spark, points, res):
    return {"table": metrics.grid_metrics(points, res, sums=True)}


@node("grid_vegetation", PTS, {"table": "grid_vegetation"}, res=1.0, canopy_threshold=2.0, extinction=0.5)
def _vegetation(spark, points, res, canopy_threshold, extinction):
    return {"table": metrics.vegetation_final(metrics.vegetation_partial(metrics.vegetation_heights(points), res), canopy_threshold, extinction, bins=True)}


@node("consolidate_grid_metrics", {"tables": "grid_metrics"}, {"table": "grid_metrics"}, many=("tables",), res=1.0)
def _consolidate(spark, tables, res):
    return {"table": metrics.consolidate_grid(*tables, res=res, sums=True)}


@node("input_table", {}, {"table": "table_csv"}, path="")
def _table(spark, path):
    from ..sources.vectors import read_csv

    return {"table": read_csv(spark, path)}


@node("input_gpkg", {}, {"table": "table_gpkg"}, path="", layer="")
def _gpkg(spark, path, layer):
    from ..sources.vectors import read_gpkg

    return {"table": read_gpkg(spark, path, layer=layer or None)}


@node("input_raster_dtm", {}, {"raster": "dtm_mosaic"}, path="")
@node("input_raster_dsm", {}, {"raster": "dsm_mosaic"}, path="")
@node("input_raster_chm", {}, {"raster": "chm_mosaic"}, path="")
@node("input_raster", {}, {"raster": "raster"}, path="")
def _raster(spark, path):
    from ..sources.grids import read_ascii, read_geotiff

    r, cells, *_ = (read_ascii if path.endswith(".asc") else read_geotiff)(spark, path)
    return {"raster": (r, cells.where("band = 1").drop("band"))}


@node("input_multispectral", {}, {"raster": "raster"}, path="")
def _multispectral(spark, path):
    """A raster whose table has a column for each band."""
    from ..sources.grids import read_geotiff

    r, cells, _ = read_geotiff(spark, path)
    n = cells.agg(F.max("band")).first()[0] or 0
    if n < 2:
        raise ValueError("a multispectral raster has two bands at least")
    return {"raster": (r, cells.groupBy("row", "col").pivot("band", list(range(1, n + 1))).agg(F.first("value")).toDF("row", "col", *[f"b{i + 1}" for i in range(n)]))}


@node("vegetation_index", {"bands": "raster"}, {"raster": "raster"}, index="ndvi", blue=1, green=2, red=3, edge=4, nir=5, a=1, b=2, soil=0.5)
def _index(spark, bands, index, soil, **use):
    return {"raster": (bands[0], raster.vegetation_index(bands[1], index, use, soil))}


@node("file_info", PTS, {"table": "table"})
def _info(spark, points):
    from ..operators import report

    return {"table": report.with_shape(report.summary(points.where("is_core")))}


for _kind in ("table", "vector"):
    node(f"consolidate_{_kind}", {"tables": _kind}, {"table": _kind}, many=("tables",))(lambda spark, tables, f=_kind: {"table": (consolidate_vectors if f == "vector" else consolidate_tables)(*tables)})


@node("consolidate_vegetation", {"tables": "grid_vegetation"}, {"table": "grid_vegetation"}, many=("tables",), canopy_threshold=2.0, extinction=0.5)
def _consolidate_vegetation(spark, tables, canopy_threshold, extinction):
    return {"table": metrics.consolidate_vegetation(*tables, canopy_threshold=canopy_threshold, extinction=extinction, bins=True)}


@node("export_points", PTS, {}, path="", crop_buffer=True)
def _export_points(spark, points, path, crop_buffer):
    from ..sources.sinks import export_points

    if path:
        export_points([points], path, crop_buffer)
    return {}


@node("concatenate_tables", {"tables": "table"}, {"table": "table"}, many=("tables",))
def _concatenate(spark, tables_=None, tables=()):
    from ..operators.tables import concatenate

    return {"table": concatenate(*tables)}


@node("normalise_heights", {"points": "point_cloud", "dtm": "dtm_mosaic"}, PTS)
def _normalise(spark, points, dtm):
    return {"points": neighbours.normalise_heights(points.where("is_core"), dtm[1], dtm[0])}


@node("denormalise_heights", {"points": "point_cloud", "dtm": "dtm_mosaic"}, PTS)
def _denormalise(spark, points, dtm):
    return {"points": neighbours.denormalise_heights(points.where("is_core"), dtm[1], dtm[0])}


@node("export", {"any": "table"}, {}, optional=("any",), path="")
def _export(spark, path, any=None):
    if any is not None:
        tables.as_text(any).write.mode("overwrite").csv(path, header=True)
    return {}
