"""Survey reports: file facts, densities, agreement of flight lines, quality verdicts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .points import has

#: Limits of a compliant survey.
NPS_LIMIT, NPD_LIMIT = 0.35, 8.0
STRIP_LIMIT, STRIP_CELL, STRIP_POINTS, STRIP_RANGE = 0.08, 5.0, 5, 0.5
WITHHELD_ALERT = 0.02
LINEAR_RATIO = 4.0


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _share(test: Column, of: Column | None = None) -> Column:
    return 100.0 * F.count(F.when(test, 1)) / (of if of is not None else F.count(F.lit(1)))


def summary(points: DataFrame) -> DataFrame:
    """One row: extent, ranges, returns, densities; one pass. A dimension that isn't there gives no column."""
    n = F.count(F.lit(1))
    aggs = [n.alias("point_count")]
    for c in ("x", "y", "z"):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    if has(points, "intensity"):
        aggs += [F.min("intensity").alias("intensity_min"), F.max("intensity").alias("intensity_max")]
    if has(points, "gps_time"):
        aggs += [F.min("gps_time").alias("gps_min"), F.max("gps_time").alias("gps_max")]
    if has(points, "scan_angle"):
        aggs += [F.min("scan_angle").alias("scan_min"), F.max("scan_angle").alias("scan_max"), F.round(F.avg("scan_angle"), 6).alias("scan_mean"), F.round(_share(F.abs("scan_angle") > 30), 6).alias("steep_pct")]
    if has(points, "return_number", "number_of_returns"):
        first = F.count(F.when(F.col("return_number") == 1, 1))
        # Of first returns, not of all.
        aggs += [first.alias("first_returns"), F.round(F.try_divide(100.0 * F.count(F.when((F.col("return_number") == 1) & (F.col("number_of_returns") > 1), 1)), first), 6).alias("multi_return_pct")]
    for flag in ("withheld", "overlap", "synthetic", "key_point"):
        if has(points, flag):
            aggs.append(F.round(_share(_true(flag)), 6).alias(f"{flag}_pct"))
    return points.agg(*aggs)


def with_shape(facts: DataFrame) -> DataFrame:
    """area of the bounding box, aspect label, density per square metre."""
    dx, dy = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    ratio = F.try_divide(F.greatest(dx, dy), F.least(dx, dy))
    label = F.when(F.coalesce(ratio, F.lit(math.inf)) >= LINEAR_RATIO, "LINEAR_CORRIDOR").otherwise("BLOCK_POLYGON")
    return facts.withColumns({"area": dx * dy, "aspect": label, "density": F.round(F.try_divide(F.col("point_count"), dx * dy), 6)})


def histogram(points: DataFrame, column: str, name: str = "value") -> DataFrame:
    return points.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def return_histogram(points: DataFrame, most: int = 15) -> DataFrame:
    return points.groupBy(F.least(F.col("return_number"), F.lit(most)).alias("return_number")).agg(F.count(F.lit(1)).alias("n"))


def flag_census(points: DataFrame) -> DataFrame:
    """flag, n: of the flags that the table has, one pass."""
    flags = [f for f in ("withheld", "overlap", "synthetic", "key_point") if has(points, f)]
    counts = points.agg(*[F.count(F.when(_true(f), 1)).alias(f) for f in flags])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, flags)), F.array(*flags))).alias("flag", "n"))


def usgs_density(points: DataFrame) -> DataFrame:
    """usgs_npd: first returns that are neither overlap nor withheld, per square metre; nps; compliant."""
    fine = F.col("return_number") == 1
    for flag in ("overlap", "withheld"):
        if has(points, flag):
            fine = fine & ~_true(flag)
    box = points.agg(F.count(F.when(fine, 1)).alias("n"), F.count(F.when(F.col("return_number") == 1, 1)).alias("first"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    npd = F.try_divide(F.col("n"), F.col("area"))
    rows = box.select("first", "area", npd.alias("npd"))
    nps = F.when(F.col("npd") > 0, F.pow("npd", F.lit(-0.5)))
    return rows.select(F.round("npd", 6).alias("usgs_npd"), F.round(nps, 6).alias("nps"), F.coalesce((nps <= NPS_LIMIT) & (F.col("npd") >= NPD_LIMIT), F.lit(False)).alias("compliant"), F.round(F.try_divide(F.col("first"), F.col("area")), 4).alias("npd_first"))


def strip_agreement(points: DataFrame, cell: float = STRIP_CELL) -> DataFrame:
    """pairs, rmsdz, ok: of the mean heights of two flight lines in a cell where both have enough flat points.

    Sums over each cell's lines give the sum over its pairs without making them:
    sum_{i<j} (m_i - m_j)^2 = k sum m^2 - (sum m)^2.
    """
    at = [F.floor(F.col(c) / cell).cast("long").alias(f"c{c}") for c in "xy"]
    lines = points.groupBy(*at, "point_source_id").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("m"), (F.max("z") - F.min("z")).alias("range"))
    flat = lines.where((F.col("n") >= STRIP_POINTS) & (F.col("range") <= STRIP_RANGE))
    m = F.col("m")
    centre = F.col("m") - F.col("m0")
    flat = flat.join(flat.groupBy("cx", "cy").agg(F.min(m).alias("m0"), F.count(F.lit(1)).alias("k")).where(F.col("k") > 1), ["cx", "cy"])
    cells = flat.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("k"), F.sum(centre).alias("s"), F.sum(centre * centre).alias("q"))
    total = cells.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).cast("long").alias("pairs"), F.sum(F.col("k") * F.col("q") - F.col("s") * F.col("s")).alias("sq"))
    rms = F.when(F.col("pairs") > 0, F.sqrt(F.greatest(F.try_divide("sq", "pairs"), F.lit(0.0))))
    return total.select("pairs", F.round(rms, 6).alias("rmsdz"), F.coalesce(F.round(rms, 6) <= STRIP_LIMIT, F.lit(False)).alias("ok"))


def alerts(facts: dict, classes: dict[int, int], minor_version: int = 4) -> list[str]:
    """Remarks on a summary row and a class histogram."""
    out = []
    if facts.get("withheld_pct", 0) > 100 * WITHHELD_ALERT:
        out.append("many withheld points")
    if minor_version >= 4 and any(classes.get(c) for c in (8, 12)):
        out.append("reserved classes in use")
    if facts.get("overlap_pct", 0) >= 1 or facts.get("withheld_pct", 0) >= 1:
        out.append("flagged points: filter them before making products")
    return out


@dataclass(frozen=True)
class Criterion:
    name: str
    verdict: str
    detail: str = ""


def quality(failed_tasks: int = 0, missing: tuple[str, ...] = (), crs: tuple[str, ...] = (), empty: tuple[str, ...] = (), untraced: tuple[str, ...] = (), warnings: int = 0, warnings_fail: bool = False) -> tuple[str, list[Criterion]]:
    """PASS or FAIL, and the criteria; positional accuracy can't be judged without check points."""
    rows = [
        Criterion("tasks", "FAIL" if failed_tasks else "PASS", f"{failed_tasks} failed"),
        Criterion("products", "FAIL" if missing else "PASS", ", ".join(missing)),
        Criterion("one coordinate system", "FAIL" if len(set(crs)) > 1 else "PASS", ", ".join(sorted(set(crs)))),
        Criterion("no empty product", "FAIL" if empty else "PASS", ", ".join(empty)),
        Criterion("inputs are traced", "FAIL" if untraced else "PASS", ", ".join(untraced)),
        Criterion("warnings", "FAIL" if warnings and warnings_fail else "PASS", str(warnings)),
        Criterion("positional accuracy", "na"),
    ]
    return ("FAIL" if any(r.verdict == "FAIL" for r in rows) else "PASS"), rows
