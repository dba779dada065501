"""Filters and taggers of point tables.

A predicate says which points are kept. ``clean`` drops the others or tags them as
noise. Ground points (class 2) are protected unless asked otherwise; withheld points
are never kept, so tagging tags them too. A dimension that a table lacks
leaves the table as it is, which the caller can see from ``has``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import wkt
from .tables import ranked

GROUND, LOW_NOISE, HIGH_NOISE = 2, 7, 18
NOISE = (LOW_NOISE, HIGH_NOISE)
#: Classes that a tagger may not write: ground, model key points, overlap.
RESERVED = (2, 8, 12)


def has(points: DataFrame, *dims: str) -> bool:
    return set(dims) <= set(points.columns)


def clean(points: DataFrame, keep: Column, action: Literal["remove", "classify"] = "classify", target_class: int = LOW_NOISE, protect_ground: bool = True) -> DataFrame:
    """Drop what isn't kept, or give it target_class."""
    if action == "classify" and target_class in RESERVED:
        raise ValueError(f"class {target_class} isn't a noise class")
    keep = F.coalesce(keep, F.lit(False))
    if protect_ground and has(points, "classification"):
        keep = keep | (F.col("classification") == GROUND)
    if has(points, "withheld"):
        keep = keep & ~F.coalesce(F.col("withheld"), F.lit(False))
    if action == "remove":
        return points.where(keep)
    kind = points.schema["classification"].dataType
    return points.withColumn("classification", F.when(keep, F.col("classification")).otherwise(F.lit(target_class)).cast(kind))


def elevation_range(points: DataFrame, low: float = -100, high: float = 100_000, **how) -> DataFrame:
    return clean(points, F.col("z").between(low, high), **how)


def intensity_range(points: DataFrame, low: float = 0, high: float = 65_535, **how) -> DataFrame:
    if not has(points, "intensity"):
        return points
    return clean(points, F.col("intensity").between(min(max(low, 0), 65_535), min(max(high, 0), 65_535)), **how)


def scan_angle_range(points: DataFrame, low: float = -90, high: float = 90, **how) -> DataFrame:
    """scan_angle holds degrees; ``degrees`` turns raw values into them at load time."""
    if not has(points, "scan_angle"):
        return points
    return clean(points, F.col("scan_angle").between(low, high), **how)


def degrees(points: DataFrame, raw: bool) -> DataFrame:
    """Scan angles of newer files count steps of 0.006 degrees."""
    return points.withColumn("scan_angle", F.col("scan_angle") * F.lit(0.006)) if raw else points


def by_return(points: DataFrame, mode: Literal["first", "last", "single", "multiple"] = "first") -> DataFrame:
    if not has(points, "return_number", "number_of_returns"):
        return points
    which, of = F.col("return_number"), F.col("number_of_returns")
    keep = {"first": which == 1, "last": which == of, "single": of == 1, "multiple": of > 1}[mode]
    return clean(points, keep, action="remove", protect_ground=False)


def class_list(text: str) -> list[int]:
    """"2, 5" as numbers; anything else than classes 0 to 255 is refused."""
    classes = [int(part) for part in text.split(",") if part.strip()]
    if any(not 0 <= c <= 255 for c in classes):
        raise ValueError(f"classes are 0 to 255: {text!r}")
    return classes


def by_class(points: DataFrame, classes: str = "2", mode: Literal["keep", "remove"] = "keep") -> DataFrame:
    member = F.col("classification").isin(class_list(classes))
    return clean(points, member if mode == "keep" else ~member, action="remove", protect_ground=False)


def by_flags(points: DataFrame, mode: Literal["remove_overlap", "remove_synthetic", "remove_all_qa", "only_overlap"] = "remove_overlap") -> DataFrame:
    dims = {"remove_overlap": ["overlap"], "only_overlap": ["overlap"], "remove_synthetic": ["synthetic"], "remove_all_qa": [d for d in ("overlap", "synthetic", "withheld") if has(points, d)]}[mode]
    if not dims or not has(points, *dims):
        return points
    marked = F.reduce(F.array(*[F.coalesce(F.col(d), F.lit(False)) for d in dims]), F.lit(False), lambda a, b: a | b)
    return clean(points, marked if mode == "only_overlap" else ~marked, action="remove", protect_ground=False)


def decimate(points: DataFrame, order: str = "point_id", by: tuple[str, ...] = (), mode: Literal["ratio", "adaptive"] = "ratio", ratio: float = 25, target: int = 500_000, strategy: Literal["nth", "random"] = "nth", seed: int = 0, salt: Column | None = None) -> DataFrame:
    """Every step-th point of each tile (columns by), or as many at random; key points stay.

    order is unique within a tile. salt is the number that random draws sort by (a hash of seed and
    order unless given). Ratio 100 and more keeps all; 0 keeps one.
    """
    if mode == "ratio" and ratio >= 100:
        return points
    draw = salt if salt is not None else F.xxhash64(F.lit(seed), *by, order)
    points = points.withColumn("__draw", draw)
    ordering = [order] if strategy == "nth" else ["__draw", order]
    if by:
        tile = Window.partitionBy(*by)
        n = F.count(F.lit(1)).over(tile)
        at = F.row_number().over(tile.orderBy(*ordering)) - 1
    else:
        # Without tiles all points are one; they are ranked without meeting in one task.
        points = ranked(points, ordering, "__rank")
        n, at = F.lit(points.count()), F.col("__rank")
    if mode == "ratio":
        step = F.lit(max(2, round(100 / ratio))).cast("long") if ratio > 0 else n
    else:
        step = F.greatest(F.lit(1), F.ceil(n / target)).cast("long")
    columns = [c for c in points.columns if not c.startswith("__")]
    rows = points.select(*columns, at.cast("long").alias("__at"), step.alias("__step"), n.alias("__n"))
    keep = F.col("__at") % F.col("__step") == 0 if strategy == "nth" else F.col("__at") < F.ceil(F.col("__n") / F.col("__step"))
    if has(points, "key_point"):
        keep = keep | F.coalesce(F.col("key_point"), F.lit(False))
    return rows.where(keep).select(*columns)


def sample(points: DataFrame, k: int, score: Column, order: str = "point_id") -> DataFrame:
    """The k points of the lowest score: a top-k that merges, never a full sort."""
    return points.orderBy(score, order).limit(k)


def stratified_sample(points: DataFrame, by: tuple[str, ...], budget: int, strata: int, score: Column, order: str = "point_id") -> DataFrame:
    """budget // strata points of each tile, of the lowest score."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(score, order))
    return points.withColumn("__at", at).where(F.col("__at") <= max(1, budget // max(1, strata))).drop("__at")


def clip_polygon(points: DataFrame, polygon: str, buffer: float = 0.0) -> DataFrame:
    """Points that a WKT polygon covers, its border included, or that lie within buffer of it.

    The bounding box reaches the scan as a filter; the exact test is vectorised over Arrow batches.
    """
    rings = wkt.polygons(polygon)
    x0, y0, x1, y1 = wkt.bounds(rings)
    boxed = points.where(F.col("x").between(x0 - buffer, x1 + buffer) & F.col("y").between(y0 - buffer, y1 + buffer))

    def covered(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            a, b = x.to_numpy(np.float64), y.to_numpy(np.float64)
            yield pd.Series(wkt.covers(rings, a, b) | (wkt.distance(rings, a, b) <= buffer if buffer > 0 else False))

    test = F.pandas_udf(covered, BooleanType())
    return boxed.where(test(F.col("x").cast("double"), F.col("y").cast("double")))
