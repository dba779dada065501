"""Algebra, mosaics, stencils and terrain of rasters held as tables (row, col, value).

Stencils scatter each cell to the cells that need it and aggregate there: no halo, no
tile borders, and absent cells cost nothing.
"""

from __future__ import annotations

import itertools
import math
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import Raster

KEY = ["row", "col"]
_V = F.col


def _offsets(pairs: list[tuple]) -> Column:
    """An array of (dr, dc, w) structs."""
    return F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(float(w)).alias("w")) for r, c, w in pairs])


def scatter(cells: DataFrame, pairs: list[tuple], raster: Raster | None = None) -> DataFrame:
    """row, col, value, dr, dc, w: each cell's value at the cell that sees it at (dr, dc)."""
    rows = cells.select(*KEY, "value", F.explode(_offsets(pairs)).alias("o"))
    out = rows.select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "value", "o.dr", "o.dc", "o.w")
    return out.where(raster.inside(F.col("row"), F.col("col"))) if raster else out


def shift(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    return cells.select((F.col("row") + rows).alias("row"), (F.col("col") + cols).alias("col"), "value")


def difference(a: DataFrame, b: DataFrame, raster_a: Raster | None = None, raster_b: Raster | None = None) -> DataFrame:
    """a - b on a's cells, where both have a value. Rasters on different lattices are refused."""
    if raster_a and raster_b:
        b = shift(b, *raster_a.offset_of(raster_b))
    return a.select(*KEY, F.col("value").alias("a")).join(b.select(*KEY, F.col("value").alias("b")), KEY).select(*KEY, (F.col("a") - F.col("b")).alias("value"))


Index = Literal["ndvi", "ndre", "gndvi", "savi", "vari", "gli", "custom"]


def vegetation_index(bands: DataFrame, index: Index = "ndvi", use: dict[str, int] | None = None, soil: float = 0.5) -> DataFrame:
    """An index of columns b1, b2, ... of a (row, col, b1, ...) table, clipped to -1..1.

    use names the 1-based bands (defaults: blue 1, green 2, red 3, edge 4, nir 5; custom takes a and b).
    A null band or a zero denominator gives no cell.
    """
    at = {"blue": 1, "green": 2, "red": 3, "edge": 4, "nir": 5} | (use or {})

    def band(name: str) -> Column:
        if f"b{at[name]}" not in bands.columns:
            raise ValueError(f"band {at[name]} ({name}) isn't there")
        return F.col(f"b{at[name]}").cast("double")

    def ratio(a: str, b: str) -> tuple[Column, Column]:
        return band(a) - band(b), band(a) + band(b)

    if index in ("ndvi", "ndre", "gndvi", "custom"):
        over, under = ratio(*{"ndvi": ("nir", "red"), "ndre": ("nir", "edge"), "gndvi": ("nir", "green"), "custom": ("a", "b")}[index])
    elif index == "savi":
        over, under = ratio("nir", "red")
        over, under = over * (1 + soil), under + soil
    elif index == "vari":
        over, under = band("green") - band("red"), band("green") + band("red") - band("blue")
    else:
        over, under = 2 * band("green") - band("red") - band("blue"), 2 * band("green") + band("red") + band("blue")
    value = F.when(under != 0, F.least(F.greatest(over / under, F.lit(-1.0)), F.lit(1.0)))
    return bands.select(*KEY, value.alias("value")).where(F.col("value").isNotNull())


def merge(parts: list[DataFrame], how: Literal["first", "last", "min", "max"] = "first") -> DataFrame:
    """One raster of several on one lattice; first and last go by the order given."""
    rows = None
    for i, p in enumerate(parts):
        p = p.select(*KEY, "value", F.lit(i).alias("prio"))
        rows = p if rows is None else rows.unionByName(p)
    value = {"first": F.min_by("value", "prio"), "last": F.max_by("value", "prio"), "min": F.min("value"), "max": F.max("value")}[how]
    return rows.where(F.col("value").isNotNull()).groupBy(*KEY).agg(value.alias("value"))


def mosaic_plan(parts: list[Raster]) -> list[str | None]:
    """Why each raster can't join the first one's mosaic; None where it can."""
    out: list[str | None] = []
    for p in parts:
        if p.crs != parts[0].crs:
            out.append("another coordinate system")
            continue
        try:
            parts[0].offset_of(p)
            out.append(None)
        except ValueError as e:
            out.append(str(e))
    return out


def mosaic(parts: list[tuple[Raster, DataFrame]], how: Literal["first", "last", "min", "max"] = "first") -> tuple[Raster, DataFrame]:
    """Parts of different extents, moved to one raster that covers them all."""
    metas = [m for m, _ in parts]
    if reasons := [r for r in mosaic_plan(metas) if r]:
        raise ValueError("; ".join(reasons))
    whole = Raster.over(min(m.west for m in metas), min(m.south for m in metas), max(m.east for m in metas), max(m.north for m in metas), metas[0].res, (metas[0].west, metas[0].north), metas[0].crs)
    return whole, merge([shift(df, *whole.offset_of(m)) for m, df in parts], how)


def _disc(reach: float) -> list[tuple]:
    n = int(math.floor(reach))
    return [(r, c, r * r + c * c) for r, c in itertools.product(range(-n, n + 1), repeat=2) if 0 < r * r + c * c <= reach * reach + 1e-9]


def fill_holes(cells: DataFrame, raster: Raster, most: float) -> DataFrame:
    """Absent cells within ``most`` metres of a value take the nearest one; ties go to the least (row, col)."""
    pairs = _disc(most / raster.res)
    if not pairs:
        return cells
    seen = scatter(cells, pairs, raster)
    nearest = F.min_by("value", F.struct(F.col("w"), F.col("row") + F.col("dr"), F.col("col") + F.col("dc")))
    holes = seen.groupBy(*KEY).agg(nearest.alias("value")).join(cells, KEY, "left_anti")
    return cells.select(*KEY, "value").unionByName(holes.select(*KEY, "value"))


def _reflect(at: Column, n: int) -> Column:
    """Half-sample reflection: -1 is 0, n is n - 1, any number of times."""
    m = F.pmod(at, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def smooth(cells: DataFrame, raster: Raster, sigma: float) -> DataFrame:
    """Gaussian over present cells only, weights renormalised; two passes, along rows and along columns.

    Cut at four sigma; edges are reflected. Absent cells stay absent.
    """
    reach = int(4 * sigma + 0.5)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    taps = [t / sum(taps) for t in taps]
    # What a cell at distance k sees is what lies there after reflection, so each cell also
    # scatters its mirror images.
    def along(rows: DataFrame, axis: str, n: int) -> DataFrame:
        spread = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("w")) for k, t in zip(range(-reach, reach + 1), taps, strict=True)])).alias("o")
        other = "col" if axis == "row" else "row"
        turns = math.ceil(reach / n)
        images = [F.col(axis)]
        for t in range(1, turns + 1):
            for sign in (-t, t):
                mirrored = F.col(axis) + sign * n if t % 2 == 0 else (sign * n + n - 1 - F.col(axis))
                images.append(mirrored)
        seen = rows.select(other, "num", "den", F.explode(F.array(*images)).alias("at")).select(other, "num", "den", "at", spread)
        seen = seen.select(other, (F.col("at") - F.col("o.k")).alias(axis), (F.col("num") * F.col("o.w")).alias("num"), (F.col("den") * F.col("o.w")).alias("den"))
        seen = seen.where((F.col(axis) >= 0) & (F.col(axis) < n))
        return seen.groupBy(*KEY).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))

    rows = cells.select(*KEY, F.col("value").cast("double").alias("num"), F.lit(1.0).alias("den"))
    rows = along(along(rows, "row", raster.height), "col", raster.width)
    smoothed = rows.select(*KEY, (F.col("num") / F.col("den")).alias("value"))
    return smoothed.join(cells.select(*KEY), KEY, "left_semi")


def median(cells: DataFrame, raster: Raster, size: int = 3) -> DataFrame:
    """Median of the present cells of a size x size window; beyond an edge lies the mirror image without the edge itself."""
    half = size // 2
    square = [(r, c, 1) for r, c in itertools.product(range(-half, half + 1), repeat=2)]

    def images(axis: str, n: int) -> Column:
        at = F.col(axis)
        mirrored = [F.when((at > 0) & (at <= half), -at), F.when((at < n - 1) & (at >= n - 1 - half), 2 * (n - 1) - at)]
        return F.filter(F.array(at, *mirrored), lambda v: v.isNotNull())

    rows = cells.select(F.explode(images("row", raster.height)).alias("row"), "col", "value")
    rows = rows.select("row", F.explode(images("col", raster.width)).alias("col"), "value")
    seen = scatter(rows, square, raster).groupBy(*KEY).agg(F.percentile("value", 0.5).alias("value"))
    return seen.join(cells.select(*KEY), KEY, "left_semi")


def gradients(cells: DataFrame, raster: Raster, z_factor: float = 1.0) -> DataFrame:
    """row, col, dzdx, dzdy by Horn's weights; only where the 3 x 3 window is complete. North is the smaller row."""
    x = {(r, c): c * (2 if r == 0 else 1) for r, c in itertools.product((-1, 0, 1), repeat=2)}
    y = {(r, c): -r * (2 if c == 0 else 1) for r, c in itertools.product((-1, 0, 1), repeat=2)}
    pairs = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(float(x[r, c])).alias("wx"), F.lit(float(y[r, c])).alias("wy")) for r, c in x])
    rows = cells.select(*KEY, F.col("value").cast("double").alias("value"), F.explode(pairs).alias("o"))
    rows = rows.select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), (F.col("value") * F.col("o.wx")).alias("x"), (F.col("value") * F.col("o.wy")).alias("y"))
    full = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).where(F.col("n") == 9)
    unit = F.lit(z_factor / (8 * raster.res))
    return full.select(*KEY, (F.col("x") * unit).alias("dzdx"), (F.col("y") * unit).alias("dzdy"))


def _steepness() -> Column:
    return F.atan(F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy")))


def slope(cells: DataFrame, raster: Raster, z_factor: float = 1.0) -> DataFrame:
    """Degrees."""
    return gradients(cells, raster, z_factor).select(*KEY, F.degrees(_steepness()).alias("value"))


def aspect(cells: DataFrame, raster: Raster) -> DataFrame:
    """Degrees clockwise from north that the slope faces; -1 where it is flat."""
    g = gradients(cells, raster)
    facing = F.degrees(F.atan2(-F.col("dzdx"), -F.col("dzdy")))
    flat = (F.col("dzdx") == 0) & (F.col("dzdy") == 0)
    return g.select(*KEY, F.when(flat, F.lit(-1.0)).otherwise(F.pmod(facing + 360.0, F.lit(360.0))).alias("value"))


def hillshade(cells: DataFrame, raster: Raster, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    """255 (cos Z cos S + sin Z sin S cos(azimuth - aspect)); not clamped at zero."""
    g = gradients(cells, raster, z_factor)
    zenith = math.radians(90 - altitude)
    facing = F.atan2(-F.col("dzdx"), -F.col("dzdy"))
    lit = F.lit(math.cos(zenith)) * F.cos(_steepness()) + F.lit(math.sin(zenith)) * F.sin(_steepness()) * F.cos(F.lit(math.radians(azimuth)) - facing)
    return g.select(*KEY, (255 * lit).alias("value"))


def pit_free(cells: DataFrame, factors: tuple[int, ...] = (2, 4)) -> DataFrame:
    """Each cell raised to the greatest value of its block, at 2 x 2 and 4 x 4 cells."""
    value = F.col("value")
    for f in factors:
        block = Window.partitionBy(F.floor(F.col("row") / f), F.floor(F.col("col") / f))
        cells = cells.select(*KEY, value.alias("value"), F.max("value").over(block).alias(f"__{f}"), *[c for c in cells.columns if c.startswith("__")])
    return cells.select(*KEY, F.greatest("value", *[f"__{f}" for f in factors]).alias("value"))


def valid_bounds(cells: DataFrame) -> DataFrame:
    """row_min, row_max, col_min, col_max of the cells that have a value."""
    here = cells.where(F.col("value").isNotNull())
    return here.agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))


def crop(cells: DataFrame, raster: Raster) -> tuple[Raster, DataFrame]:
    """To the valid bounds; four numbers come to the driver."""
    b = valid_bounds(cells).first()
    if b["row_min"] is None:
        return raster, cells
    small = raster.cropped(b["row_min"], b["col_min"], b["row_max"] - b["row_min"] + 1, b["col_max"] - b["col_min"] + 1)
    return small, shift(cells.where(F.col("value").isNotNull()), -b["row_min"], -b["col_min"])


def resample(cells: DataFrame, source: Raster, target: Raster) -> DataFrame:
    """Nearest neighbour: each target cell takes the source cell that holds its centre.

    Each source cell makes the target cells whose centres it holds, so nothing is shuffled.
    """
    k = source.res / target.res

    def spans(at: Column, start: float) -> Column:
        # Target centres i + 0.5 in units of target cells, from this source cell's near to its far edge.
        lo, hi = F.ceil(start + at * k - 0.5).cast("long"), F.ceil(start + (at + 1) * k - 0.5).cast("long") - 1
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    row0, col0 = (target.north - source.north) / target.res, (source.west - target.west) / target.res
    rows = cells.select(F.explode(spans(F.col("row"), row0)).alias("row"), F.col("col").alias("__c"), "value")
    rows = rows.select("row", F.explode(spans(F.col("__c"), col0)).alias("col"), "value")
    return rows.where(target.inside(F.col("row"), F.col("col")))


def finish(cells: DataFrame, raster: Raster, fill: float = 0.0, sigma: float = 0.0, median_size: int = 0) -> tuple[Raster, DataFrame]:
    """Fill, smooth, median, then crop: the order in which a mosaic is finished."""
    if fill > 0:
        cells = fill_holes(cells, raster, fill)
    if sigma > 0:
        cells = smooth(cells, raster, sigma)
    if median_size > 1:
        cells = median(cells, raster, median_size)
    return crop(cells, raster)


def stretch(cells: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The values between which a preview spreads its colours."""
    p = F.percentile("value", F.array(F.lit(low), F.lit(high)))
    return cells.agg(p.alias("p")).select(F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))
