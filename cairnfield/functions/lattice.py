"""The three lattices of a survey. They are kept apart on purpose: cells of one aren't cells of another.

* tile lattice: origin at the survey's least corner, columns eastwards, rows northwards;
* raster lattice: anchored at a raster's north-west corner, rows southwards, a point on a
  horizontal line belongs to the cell below it;
* grid lattice: origin at world zero, rows northwards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What files write where a cell has no value; in tables it is a null or a row that isn't there.
NODATA = -9999.0


def _floor(value: Column) -> Column:
    return F.floor(value).cast("long")


@dataclass(frozen=True)
class Tiles:
    """A survey's tile lattice; cols and rows of 0 leave the far edges open."""

    x_min: float
    y_min: float
    size: float
    cols: int = 0
    rows: int = 0

    @classmethod
    def over(cls, x_min: float, y_min: float, x_max: float, y_max: float, size: float) -> Tiles:
        """The far edge belongs to the last tile, also where the extent is a multiple of size."""
        return cls(x_min, y_min, size, max(1, math.ceil((x_max - x_min) / size)), max(1, math.ceil((y_max - y_min) / size)))

    def col(self, x: Column) -> Column:
        return self._clip(_floor((x - self.x_min) / self.size), self.cols)

    def row(self, y: Column) -> Column:
        return self._clip(_floor((y - self.y_min) / self.size), self.rows)

    @staticmethod
    def _clip(index: Column, n: int) -> Column:
        return F.least(F.greatest(index, F.lit(0)), F.lit(n - 1)).cast("long") if n else index


@dataclass(frozen=True)
class Raster:
    """Where a raster's cells lie; data is a table of (row, col, value), no-data cells absent."""

    west: float
    north: float
    res: float
    width: int
    height: int
    crs: str | None = None

    @classmethod
    def over(cls, x_min: float, y_min: float, x_max: float, y_max: float, res: float, anchor: tuple[float, float] = (0.0, 0.0), crs: str | None = None) -> Raster:
        """Bounds snapped outwards to the lattice through anchor."""
        west = anchor[0] + math.floor((x_min - anchor[0]) / res) * res
        south = anchor[1] + math.floor((y_min - anchor[1]) / res) * res
        east = anchor[0] + math.ceil((x_max - anchor[0]) / res) * res
        north = anchor[1] + math.ceil((y_max - anchor[1]) / res) * res
        return cls(west, north, res, max(1, round((east - west) / res)), max(1, round((north - south) / res)), crs)

    @property
    def south(self) -> float:
        return self.north - self.height * self.res

    @property
    def east(self) -> float:
        return self.west + self.width * self.res

    def col(self, x: Column) -> Column:
        return _floor((x - self.west) / self.res)

    def row(self, y: Column) -> Column:
        return _floor((self.north - y) / self.res)

    def inside(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (row < self.height) & (col >= 0) & (col < self.width)

    def cropped(self, row: int, col: int, height: int, width: int) -> Raster:
        return replace(self, west=self.west + col * self.res, north=self.north - row * self.res, width=width, height=height)

    def offset_of(self, other: Raster) -> tuple[int, int]:
        """(rows, columns) by which other's cells are moved to be this raster's; different lattices are refused."""
        if not math.isclose(self.res, other.res, rel_tol=1e-9):
            raise ValueError(f"cells of {self.res} and {other.res} don't match")
        rows, cols = (self.north - other.north) / self.res, (other.west - self.west) / self.res
        if abs(rows - round(rows)) > 1e-6 or abs(cols - round(cols)) > 1e-6:
            raise ValueError("the rasters' cells don't lie on one lattice")
        return round(rows), round(cols)


def grid_cell(x: Column, y: Column, res: float) -> tuple[Column, Column]:
    """(cell_col, cell_row) of the grid lattice."""
    return _floor(x / res), _floor(y / res)
