"""Operators on a point's neighbours: outliers by distance, and heights sampled from a raster."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import Raster
from .points import clean

#: Points of a search cell, about.
_PER_CELL = 24


def nearest_distances(xyz: np.ndarray, k: int) -> np.ndarray:
    """n x k distances to the k nearest other points, in order; infinite where there are fewer.

    Points are bucketed by (x, y). A distance no greater than the cells' side is final after the
    3 x 3 cells around; points with others left go on with cells twice as large.
    """
    n = len(xyz)
    out = np.full((n, k), np.inf)
    if n < 2 or k < 1:
        return out
    low = xyz[:, :2].min(0)
    extent = float((xyz[:, :2].max(0) - low).max()) or 1.0
    side = max(extent / max(1.0, np.sqrt(n / max(_PER_CELL, k))), 1e-9)
    todo = np.arange(n)
    while len(todo):
        whole = side >= extent
        cell = np.floor((xyz[:, :2] - low) / side).astype(np.int64)
        width = int(cell[:, 0].max()) + 3
        key = (cell[:, 1] + 1) * width + cell[:, 0] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        mine = todo[np.argsort(key[todo], kind="stable")]
        for group in np.split(mine, np.flatnonzero(np.diff(key[mine])) + 1):
            home = key[group[0]]
            near = [order[np.searchsorted(ordered, home + dr * width - 1) : np.searchsorted(ordered, home + dr * width + 1, "right")] for dr in (-1, 0, 1)]
            near = np.concatenate(near)
            for lo in range(0, len(group), 512):
                own = group[lo : lo + 512]
                d = np.sqrt(((xyz[own][:, None] - xyz[near][None]) ** 2).sum(2))
                d[own[:, None] == near[None]] = np.inf
                m = min(k, d.shape[1])
                out[own, :m] = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1)
        todo = todo[out[todo, -1] > side] if not whole else todo[:0]
        side *= 2
    return out


def _tagged(points: DataFrame, tile: tuple[str, ...], keep: Callable[[np.ndarray], np.ndarray], **how) -> DataFrame:
    """Groups are tiles, whose size is bounded by subdivision; keep sees one tile's coordinates.

    Without tile columns all points are one tile: for clouds that fit one task.
    """

    def run(tile_points: pd.DataFrame) -> pd.DataFrame:
        return tile_points.assign(__keep=keep(tile_points[["x", "y", "z"]].to_numpy(np.float64)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", `__keep` boolean"
    rows = points.groupBy(*(tile or [F.lit(0).alias("__all")])).applyInPandas(run, schema)
    return clean(rows, F.col("__keep"), **how).drop("__keep")


def statistical_outliers(points: DataFrame, k: int = 6, multiplier: float = 3.0, tile: tuple[str, ...] = ("tile_col", "tile_row"), **how) -> DataFrame:
    """Keeps points whose mean distance to their k nearest is at most mean + multiplier * population deviation of their tile."""

    def keep(xyz: np.ndarray) -> np.ndarray:
        if len(xyz) < 2:
            return np.ones(len(xyz), bool)
        mean = nearest_distances(xyz, min(k, len(xyz) - 1)).mean(1)
        return mean <= mean.mean() + multiplier * mean.std()

    return _tagged(points, tile, keep, **how)


def radius_outliers(points: DataFrame, radius: float = 5.0, least: int = 3, tile: tuple[str, ...] = ("tile_col", "tile_row"), **how) -> DataFrame:
    """Keeps points with least points, themselves included, within radius."""

    def keep(xyz: np.ndarray) -> np.ndarray:
        if least <= 1 or len(xyz) <= 1:
            return np.ones(len(xyz), bool)
        if least > len(xyz):
            return np.zeros(len(xyz), bool)
        return nearest_distances(xyz, least - 1)[:, -1] <= radius

    return _tagged(points, tile, keep, **how)


def radius_counts(points: DataFrame, radius: float, key: str = "point_id") -> DataFrame:
    """key, neighbours: other points within radius, by built-in operators: cells of the radius, an equi-join on the
    cell, then the exact distance. Work grows with density, so prefer radius_outliers where it is high."""
    at = [F.floor(F.col(c) / radius).cast("long") for c in "xy"]
    left = points.select(F.col(key).alias("__id"), *[F.col(c).alias(f"__{c}") for c in "xyz"], at[0].alias("__cx"), at[1].alias("__cy"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in itertools.product((-1, 0, 1), repeat=2)])
    right = points.select(key, "x", "y", "z", at[0].alias("cx"), at[1].alias("cy"), F.explode(around).alias("o"))
    right = right.select(key, "x", "y", "z", (F.col("cx") + F.col("o.i")).alias("__cx"), (F.col("cy") + F.col("o.j")).alias("__cy"))
    far = sum((F.pow(F.col(c) - F.col(f"__{c}"), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    pairs = right.join(left, ["__cx", "__cy"]).where((F.col(key) != F.col("__id")) & (far <= radius * radius))
    found = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("neighbours"))
    return points.select(key).join(found, key, "left").select(key, F.coalesce("neighbours", F.lit(0).cast("long")).alias("neighbours"))


def quads(cells: DataFrame) -> DataFrame:
    """row, col, v00, v01, v10, v11: each 2 x 2 block of cells that all have a value, by its first cell."""
    corners = list(itertools.product((0, 1), repeat=2))
    each = F.array(*[F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.lit(2 * i + j).alias("k")) for i, j in corners])
    rows = cells.where(F.col("value").isNotNull()).select("value", F.explode(each).alias("o")).select("o.row", "o.col", "o.k", "value")
    values = [F.max(F.when(F.col("k") == 2 * i + j, F.col("value"))).alias(f"v{i}{j}") for i, j in corners]
    return rows.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), *values).where(F.col("n") == 4).drop("n")


def bilinear(points: DataFrame, cells: DataFrame, raster: Raster, name: str = "sampled") -> DataFrame:
    """points with the raster's height at each; null unless all four cell centres around have a value.

    Blocks of four cells are rows of their own, so points take one equi-join on the block, no copy and no key.
    """
    cf, rf = (F.col("x") - raster.west) / raster.res - 0.5, (raster.north - F.col("y")) / raster.res - 0.5
    base = points.select("*", F.floor(cf).cast("long").alias("__col"), F.floor(rf).cast("long").alias("__row"), (cf - F.floor(cf)).alias("__fx"), (rf - F.floor(rf)).alias("__fy"))
    around = quads(cells).withColumnsRenamed({c: f"__{c}" for c in ("row", "col", "v00", "v01", "v10", "v11")})
    fx, fy = F.col("__fx"), F.col("__fy")
    upper = F.col("__v00") * (1 - fx) + F.col("__v01") * fx
    lower = F.col("__v10") * (1 - fx) + F.col("__v11") * fx
    found = base.join(around, ["__row", "__col"], "left")
    return found.select(*[F.col(f"`{c}`") for c in points.columns], (upper * (1 - fy) + lower * fy).alias(name))


def _moved(points: DataFrame, cells: DataFrame, raster: Raster, sign: int) -> DataFrame:
    rows = bilinear(points, cells, raster, "__h")
    move = F.col("__h").isNotNull()
    if "withheld" in points.columns:
        move = move & ~F.coalesce(F.col("withheld"), F.lit(False))
    return rows.withColumn("z", F.when(move, F.col("z") + sign * F.col("__h")).otherwise(F.col("z"))).drop("__h")


def normalise_heights(points: DataFrame, cells: DataFrame, raster: Raster) -> DataFrame:
    """z above the terrain; points outside it, and withheld ones, keep their z."""
    return _moved(points, cells, raster, -1)


def denormalise_heights(points: DataFrame, cells: DataFrame, raster: Raster) -> DataFrame:
    return _moved(points, cells, raster, 1)
