"""Rasters out of points: terrain, surface, canopy, penetration, coverage, intensity.

A raster is a table (row, col, value). All of them are global aggregates, so tile borders
leave no seam; where a rule speaks of tiles (no ground in a tile), the tile's columns say so.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import Raster
from .metrics import kept
from .points import GROUND

Reducer = Literal["min", "max", "mean", "median", "idw"]
KEY = ["row", "col"]


def in_cells(points: DataFrame, raster: Raster) -> DataFrame:
    """points with the row and col of their cell; a point on the far edge belongs to the last cell."""
    row = F.when(F.col("y") == raster.south, raster.height - 1).otherwise(raster.row(F.col("y")))
    col = F.when(F.col("x") == raster.east, raster.width - 1).otherwise(raster.col(F.col("x")))
    return points.withColumns({"row": row.cast("long"), "col": col.cast("long")}).where(raster.inside(F.col("row"), F.col("col")))


def reduce_cells(cells: DataFrame, value: str = "z", how: Reducer = "min") -> DataFrame:
    """One value a cell. "idw" weighs values by their distance from the cell's mean value:
    the weight is 1 / max((v - mean)^2, 1e-6), no place enters it."""
    v = F.col(value).cast("double")
    if how == "idw":
        mean = F.avg(v).over(Window.partitionBy(*KEY))
        rows = cells.select(*KEY, v.alias("v"), mean.alias("m"))
        w = 1 / F.greatest(F.pow(F.col("v") - F.col("m"), F.lit(2.0)), F.lit(1e-6))
        return rows.groupBy(*KEY).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("value"))
    by = {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "median": F.percentile(v, 0.5)}[how]
    return cells.groupBy(*KEY).agg(by.alias("value"))


def dtm(points: DataFrame, raster: Raster, how: Reducer = "min", tile: tuple[str, ...] = ()) -> DataFrame:
    """From ground points. Given a tile's columns, a tile without ground uses all its points."""
    points = kept(points)
    ground = F.col("classification") == GROUND
    if tile:
        # Which tiles lack ground is one row a tile; joining it avoids a window over whole tiles.
        bare = points.groupBy(*tile).agg(F.max(ground).alias("__has")).where(~F.col("__has"))
        rest = points.join(bare.drop("__has"), list(tile), "left_semi")
        points = points.where(ground).unionByName(rest)
    else:
        points = points.where(ground)
    return reduce_cells(in_cells(points, raster), "z", how)


def dsm(points: DataFrame, raster: Raster, how: Reducer = "max") -> DataFrame:
    return reduce_cells(in_cells(kept(points), raster), "z", how)


def canopy_height(surface: DataFrame, terrain: DataFrame, low: float = 0.0, high: float = 60.0) -> DataFrame:
    """surface - terrain where both have a value, clipped."""
    both = surface.select(*KEY, F.col("value").alias("s")).join(terrain.select(*KEY, F.col("value").alias("t")), KEY)
    return both.select(*KEY, F.least(F.greatest(F.col("s") - F.col("t"), F.lit(float(low))), F.lit(float(high))).alias("value"))


def canopy_penetration(points: DataFrame, raster: Raster, tile: tuple[str, ...] = ("tile_col", "tile_row")) -> DataFrame:
    """Share of ground points of each cell; a tile without any ground has no value anywhere."""
    cells = in_cells(kept(points), raster)
    ground = F.count(F.when(F.col("classification") == GROUND, 1))
    each = cells.groupBy(*tile, *KEY).agg(ground.alias("g"), F.count(F.lit(1)).alias("n"))
    bare = each.groupBy(*tile).agg(F.sum("g").alias("s")).where(F.col("s") > 0).drop("s")
    return each.join(bare, list(tile), "left_semi").groupBy(*KEY).agg(F.least(F.sum("g") / F.sum("n"), F.lit(1.0)).alias("value"))


def flightline_coverage(points: DataFrame, raster: Raster, mode: Literal["coverage", "density"] = "coverage") -> DataFrame:
    """Distinct flight lines of each cell, or its number of points; withheld points count too."""
    value = F.count_distinct("point_source_id") if mode == "coverage" else F.count(F.lit(1))
    return in_cells(points, raster).groupBy(*KEY).agg(value.cast("double").alias("value"))


def intensity_ortho(points: DataFrame, raster: Raster, normalise: bool = True, most_angle: float = 60.0) -> DataFrame:
    """Mean intensity, with normalise divided by the cosine of the scan angle; steeper angles are left out."""
    points = kept(points)
    i = F.col("intensity").cast("double")
    if normalise and "scan_angle" in points.columns:
        points = points.where(F.abs("scan_angle") <= most_angle)
        i = i / F.greatest(F.cos(F.radians("scan_angle")), F.lit(_cos(most_angle)))
    return in_cells(points, raster).groupBy(*KEY).agg(F.avg(i).alias("value"))


def _cos(angle: float) -> float:
    import math

    return math.cos(math.radians(angle))
