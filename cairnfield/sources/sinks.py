"""What goes out beside the data: exports, provenance, styles."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_points(parts: list[DataFrame], path: str, crop_buffer: bool = True) -> None:
    """Tiles or segments as one table of points, without buffers; all must have the same dimensions."""
    if len({frozenset(p.columns) for p in parts}) > 1:
        raise ValueError("the parts have different dimensions")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if crop_buffer and "is_core" in rows.columns:
        rows = rows.where("is_core")
    # Clustered by tile, so that statistics of row groups prune by place.
    if {"tile_col", "tile_row"} <= set(rows.columns):
        rows = rows.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "x")
    rows.drop("is_core").write.mode("overwrite").parquet(path)


def provenance(product: str, steps: list[dict], sources: list[str], crs: str | None = None) -> dict:
    return {"product": product, "made": datetime.now(UTC).isoformat(timespec="seconds"), "steps": steps, "sources": sources, "crs": crs}


def write_provenance(doc: dict, product: str) -> str:
    path = f"{product}.meta.json"
    Path(path).write_text(json.dumps(doc, indent=1), encoding="utf-8")
    return path


#: Colours from low to high.
RAMPS = {"terrain": ["#2c7bb6", "#abd9e9", "#ffffbf", "#fdae61", "#d7191c"], "canopy": ["#f7fcf5", "#a1d99b", "#41ab5d", "#006d2c", "#00441b"], "grey": ["#000000", "#404040", "#808080", "#c0c0c0", "#ffffff"]}


def value_range(cells: DataFrame) -> tuple[float, float] | None:
    """Least and greatest value, NaN and null left out."""
    v = F.when(~F.isnan(F.col("value").cast("double")), F.col("value"))
    r = cells.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    return None if r["lo"] is None else (float(r["lo"]), float(r["hi"]))


def classes(cells: DataFrame) -> list[int] | None:
    """The values, if they are two to eight whole numbers from 0 to 9."""
    values = [r["value"] for r in cells.select("value").where(F.col("value").isNotNull()).distinct().limit(9).collect()]
    whole = all(v == int(v) and 0 <= v <= 9 for v in values)
    return sorted(map(int, values)) if whole and 2 <= len(values) <= 8 else None


def style(cells: DataFrame, ramp: str = "terrain") -> str:
    """A raster style: one colour a class, or a ramp over the range."""
    colours = RAMPS[ramp]
    if kinds := classes(cells):
        items = [(k, colours[i * (len(colours) - 1) // (len(kinds) - 1)]) for i, k in enumerate(kinds)]
        kind = "EXACT"
    else:
        lo, hi = value_range(cells) or (0.0, 1.0)
        items = [(lo + (hi - lo) * i / (len(colours) - 1), c) for i, c in enumerate(colours)]
        kind = "INTERPOLATED"
    body = "".join(f'<item value="{v!r}" color="{c}" label="{escape(f"{v:g}")}"/>' for v, c in items)
    return f'<qgis><pipe><rasterrenderer type="singlebandpseudocolor" band="1"><rastershader><colorrampshader colorRampType="{kind}">{body}</colorrampshader></rastershader></rasterrenderer></pipe></qgis>'
