"""Types of edges, and which fit which."""

from __future__ import annotations

POINTS, CLASSIFIED, TILES = "point_cloud", "classified_point_cloud", "tiles"
RASTERS = ("dtm_tile", "dsm_tile", "dtm_mosaic", "dsm_mosaic", "chm_mosaic", "canopy_penetration", "coverage_raster", "intensity_ortho", "strata_raster", "raster")
TABLES = ("table_csv", "table_gpkg", "table")

#: An output of the key also fits inputs of these types.
_ALSO: dict[str, set[str]] = {POINTS: {CLASSIFIED}, CLASSIFIED: {POINTS}, "table_csv": {"table"}, "table_gpkg": {"table"}}
_KNOWN = {POINTS, CLASSIFIED, TILES, *RASTERS, *TABLES, "grid_metrics", "grid_vegetation", "vector"}


def add_port(name: str, also: set[str] = frozenset()) -> None:
    """A type of an extension's own."""
    _KNOWN.add(name)
    _ALSO.setdefault(name, set()).update(also)


def known(name: str) -> bool:
    return name in _KNOWN


def fits(output: str, wanted: str) -> bool:
    return output == wanted or wanted in _ALSO.get(output, ())
