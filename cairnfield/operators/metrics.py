"""Per-cell metrics of the grid lattice: partial sums, their merge, the finished figures.

Partials add up across tiles, batches and surveys; a dimension that a table lacks gives
null partials, which null nothing else: sums skip them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import Raster, grid_cell
from .points import GROUND, NOISE, has

#: Classes that are counted one by one; the dominant class is the first of the commonest.
CLASSES = (0, 1, 2, 3, 4, 5, 6, 7, 9, 17, 18)
VEGETATION, BUILDING, WATER = (3, 4, 5), 6, 9
BINS = 61
KEY = ["cell_col", "cell_row"]


def _count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def kept(points: DataFrame) -> DataFrame:
    """Without withheld points and without a tile's buffer."""
    if has(points, "withheld"):
        points = points.where(~F.coalesce(F.col("withheld"), F.lit(False)))
    return points.where("is_core") if has(points, "is_core") else points


def grid_partial(points: DataFrame, res: float = 1.0) -> DataFrame:
    col, row = grid_cell(F.col("x"), F.col("y"), res)
    z, i = F.col("z").cast("double"), F.col("intensity").cast("double") if has(points, "intensity") else F.lit(None).cast("double")
    c = F.col("classification") if has(points, "classification") else F.lit(None).cast("int")
    returns = has(points, "return_number", "number_of_returns")
    first = _count(F.col("return_number") == 1) if returns else F.lit(None).cast("long")
    last = _count(F.col("return_number") == F.col("number_of_returns")) if returns else F.lit(None).cast("long")
    classes = [_count(c == k).alias(f"class_{k}") for k in CLASSES]
    return kept(points).groupBy(col.alias("cell_col"), row.alias("cell_row")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(z).alias("z_sum"), F.sum(z * z).alias("z_sumsq"), F.min(z).alias("z_min"), F.max(z).alias("z_max"),
        _count(c == GROUND).alias("ground"), _count(c.isin(*NOISE)).alias("noise"),
        F.count(i).alias("i_n"), F.sum(i).alias("i_sum"), F.sum(i * i).alias("i_sumsq"), F.min(i).alias("i_min"), F.max(i).alias("i_max"),
        first.alias("first_ret"), last.alias("last_ret"), *classes,
    )


def merge_partials(*parts: DataFrame) -> DataFrame:
    """Partials of several tables as one."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    how = {"z_min": F.min, "z_max": F.max, "i_min": F.min, "i_max": F.max}
    return rows.groupBy(*KEY).agg(*[how.get(c, F.sum)(c).alias(c) for c in rows.columns if c not in KEY])


def _deviation(sumsq: Column, mean: Column, n: Column) -> Column:
    return F.sqrt(F.greatest(sumsq / n - mean * mean, F.lit(0.0)))


#: Sums that a finished table carries for consolidation; others are among its columns already.
SUMS = ("z_sum", "z_sumsq", "i_n", "i_sum", "i_sumsq", "first_ret", "last_ret", *(f"class_{k}" for k in CLASSES))
_CARRIED = {"n": "point_count", "ground": "ground_count", "noise": "noise_count", "i_min": "intensity_min", "i_max": "intensity_max", "z_min": "z_min", "z_max": "z_max"}


def grid_final(partial: DataFrame, res: float = 1.0, sums: bool = False) -> DataFrame:
    """Density, moments, shares; population deviations. With sums, the additive columns as well."""
    n = F.col("n")
    some = F.nullif(F.col("i_n"), F.lit(0))
    z_mean, i_mean = F.col("z_sum") / n, F.col("i_sum") / some
    most = F.greatest(*[F.col(f"class_{k}") for k in CLASSES])
    dominant = F.coalesce(*[F.when(F.col(f"class_{k}") == most, F.lit(k)) for k in CLASSES])

    def share(*classes: int) -> Column:
        return F.reduce(F.array(*[F.col(f"class_{k}") for k in classes]), F.lit(0).cast("long"), lambda a, b: a + b) / n

    return partial.select(
        *KEY, F.concat_ws("_", *KEY).alias("gid"), n.alias("point_count"), (n / F.lit(float(res * res))).alias("density"),
        z_mean.alias("z_mean"), _deviation(F.col("z_sumsq"), z_mean, n).alias("z_std"), "z_min", "z_max", (F.col("z_max") - F.col("z_min")).alias("z_range"),
        F.col("ground").alias("ground_count"), (F.col("ground") / n).alias("ground_cover"),
        i_mean.alias("intensity_mean"), _deviation(F.col("i_sumsq"), i_mean, some).alias("intensity_std"), F.col("i_min").alias("intensity_min"), F.col("i_max").alias("intensity_max"),
        F.col("noise").alias("noise_count"), dominant.alias("dominant_class"), (F.col("first_ret") / n).alias("first_return_cover"), (F.col("last_ret") / n).alias("last_return_cover"),
        share(*VEGETATION).alias("veg_cover"), share(BUILDING).alias("building_cover"), share(WATER).alias("water_cover"),
        *(SUMS if sums else ()),
    )


def grid_metrics(points: DataFrame, res: float = 1.0, sums: bool = False) -> DataFrame:
    return grid_final(grid_partial(points, res), res, sums)


def consolidate_grid(*finals: DataFrame, res: float = 1.0, sums: bool = False) -> DataFrame:
    """Finished tables of several batches, made with their sums, as one: partials again, merged and finished."""
    parts = [f.select(*KEY, *[F.col(c).alias(p) for p, c in _CARRIED.items()], *SUMS) for f in finals]
    return grid_final(merge_partials(*parts), res, sums)


def vegetation_heights(points: DataFrame, tile: tuple[str, ...] = ("tile_col", "tile_row"), classes: tuple[int, ...] = ()) -> DataFrame:
    """points that count as vegetation, with h above the median ground height of their tile's core.

    Tiles without ground give no rows. Ground never counts; without a list neither does noise.
    """
    points = kept(points)
    wanted = F.col("classification").isin(*[c for c in classes if c != GROUND]) if classes else ~F.col("classification").isin(GROUND, *NOISE)
    level = points.where(F.col("classification") == GROUND).groupBy(*tile).agg(F.percentile("z", 0.5).alias("__ground"))
    return points.where(wanted).join(level, list(tile)).withColumn("h", F.col("z") - F.col("__ground")).drop("__ground")


def vegetation_above(points: DataFrame, terrain: DataFrame, raster: Raster, classes: tuple[int, ...] = ()) -> DataFrame:
    """As vegetation_heights, but above a terrain raster: the cell that holds the point. Points without one are left out."""
    points = kept(points)
    wanted = F.col("classification").isin(*[c for c in classes if c != GROUND]) if classes else ~F.col("classification").isin(GROUND, *NOISE)
    at = points.where(wanted).select("*", raster.row(F.col("y")).alias("__row"), raster.col(F.col("x")).alias("__col"))
    level = terrain.select(F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("value").alias("__ground"))
    return at.join(level, ["__row", "__col"]).withColumn("h", F.col("z") - F.col("__ground")).drop("__row", "__col", "__ground")


def vegetation_partial(heights: DataFrame, res: float = 1.0) -> DataFrame:
    """Counts of one-metre height bins 0..60 of each cell, as an array; lower and higher heights are clipped."""
    col, row = grid_cell(F.col("x"), F.col("y"), res)
    h = F.floor(F.least(F.greatest(F.col("h"), F.lit(0.0)), F.lit(60.0))).cast("int")
    each = heights.groupBy(col.alias("cell_col"), row.alias("cell_row"), h.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return bins_as_array(each)


def _bins() -> Column:
    """Counts by bin in the map m as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0).cast("long")))


def bins_as_array(rows: DataFrame) -> DataFrame:
    """(cell, bin, c) as (cell, bins); repeated bins add up. At most 61 rows meet for each cell."""
    each = rows.groupBy(*KEY, "bin").agg(F.sum("c").alias("c")).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    return each.select(*KEY, _bins().alias("bins"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return bins_as_array(rows.select(*KEY, F.posexplode("bins").alias("bin", "c")).where(F.col("c") > 0))


PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def consolidate_vegetation(*finals: DataFrame, canopy_threshold: float = 2.0, extinction: float = 0.5, bins: bool = False) -> DataFrame:
    """Finished tables of several batches, made with their bins, as one: a cell's bins add up."""
    return vegetation_final(merge_histograms(*[f.select(*KEY, "bins") for f in finals]), canopy_threshold, extinction, bins)


def vegetation_final(partial: DataFrame, canopy_threshold: float = 2.0, extinction: float = 0.5, bins: bool = False) -> DataFrame:
    """Cover, leaf area, height diversity, strata and percentiles of each cell's height bins; with bins, those as well.

    A percentile is the bin in which that part of the points falls, plus the fraction of that bin's
    points below it. Empty bins play no part, so only bins with points are laid out as rows.
    """
    rows = partial.select(*KEY, F.posexplode("bins").alias("bin", "c")).where(F.col("c") > 0)
    cell = Window.partitionBy(*KEY)
    before = F.sum("c").over(cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(*KEY, "bin", "c", F.sum("c").over(cell).alias("n"), F.coalesce(before, F.lit(0)).alias("below"))
    c, n, bin_ = F.col("c"), F.col("n"), F.col("bin")

    def count(test: Column) -> Column:
        return F.sum(F.when(test, c).otherwise(0))

    def at(p: int) -> Column:
        return F.min(F.when(F.col("below") + c >= F.lit(p / 100.0) * n, F.struct("bin", "below", "c"))).alias(f"__{p}")

    strata = {"low": bin_ < 2, "mid": (bin_ >= 2) & (bin_ < 10), "high": bin_ >= 10}
    kept = [F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m")] if bins else []
    sums = rows.groupBy(*KEY).agg(*kept, F.first("n").alias("n"), count(bin_ >= int(canopy_threshold)).alias("canopy"), F.sum(-(c / n) * F.ln(c / n)).alias("fhd"), *[count(t).alias(k) for k, t in strata.items()], *map(at, PERCENTILES))

    def value(p: int) -> Column:
        part = (F.lit(p / 100.0) * n - F.col(f"__{p}.below")) / F.col(f"__{p}.c")
        return (F.col(f"__{p}.bin") + F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))).alias(f"p{p}")

    def entropy(k: str) -> Column:
        return F.when(F.col(k) > 0, -(F.col(k) / n) * F.ln(F.col(k) / n)).otherwise(F.lit(0.0))

    held = [_bins().alias("bins")] if bins else []
    out = sums.select(*KEY, *held, "n", "fhd", *strata, (F.col("canopy") / n).alias("cover"), *map(value, PERCENTILES))
    cover = F.col("cover")
    lai = F.when(cover <= 0, F.lit(0.0)).otherwise(F.least(F.lit(5.0), -F.ln(F.greatest(1 - cover, F.lit(1e-9))) / F.lit(extinction)))
    spread = F.col("p90") - F.col("p10")
    return out.select(
        *KEY, n.alias("point_count"), cover, lai.alias("lai"), (1 - cover).alias("vci"), "fhd", (entropy("low") + entropy("mid") + entropy("high")).alias("shannon_h"),
        *[(F.col(k) / n).alias(f"{k}_density") for k in strata], *[f"p{p}" for p in PERCENTILES],
        F.when(spread != 0, (F.col("p90") - 2 * F.col("p50") + F.col("p10")) / spread).alias("l_skewness"),
        *(["bins"] if bins else []),
    )
