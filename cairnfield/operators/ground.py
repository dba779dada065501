"""Ground classification: five filters on the grid of each tile's lowest points.

Each kernel turns the grid (NaN where there is no point) into a surface and a band; a
point is ground where z <= surface + band. Kernels are iterative and dense, so they
run in NumPy, one tile at a time; tiles are bounded by subdivision before.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .points import GROUND

Method = Literal["pmf", "csf", "smrf", "mcc", "atin"]
#: A tile's grid may not have more cells than this; a wider one needs larger cells or smaller tiles.
MOST_CELLS = 64_000_000


def _slide(a: np.ndarray, w: int, by: Callable, pad: float) -> np.ndarray:
    """A running minimum or maximum over w x w cells, window cut at the edges; log2(w) passes an axis."""
    for axis in (0, 1):
        half = w // 2
        width = [(half, half) if i == axis else (0, 0) for i in (0, 1)]
        b, span = np.pad(a, width, constant_values=pad), 1
        n = b.shape[axis]
        while span < w:
            step = min(span, w - span)
            n -= step
            lo, hi = [slice(None)] * 2, [slice(None)] * 2
            lo[axis], hi[axis] = slice(0, n), slice(step, n + step)
            b = by(b[tuple(lo)], b[tuple(hi)])
            span += step
        a = b
    return a


def opened(a: np.ndarray, w: int) -> np.ndarray:
    """Grey opening by a square of w cells (odd)."""
    return _slide(_slide(a, w, np.minimum, np.inf), w, np.maximum, -np.inf)


def filled(grid: np.ndarray) -> np.ndarray:
    """Voids take the nearest value, ring by ring, as the mean of filled neighbours."""
    a = grid.copy()
    while np.isnan(a).any():
        p = np.pad(a, 1, constant_values=np.nan)
        around = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:], p[:-2, :-2], p[2:, 2:], p[:-2, 2:], p[2:, :-2]])
        n = (~np.isnan(around)).sum(0)
        if not n.any():
            return a
        mean = np.nansum(around, 0) / np.maximum(n, 1)
        take = np.isnan(a) & (n > 0)
        a[take] = mean[take]
    return a


def _odd(cells: float) -> int:
    n = max(3, round(cells))
    return n if n % 2 else n + 1


def pmf(grid: np.ndarray, cell: float = 1.0, slope: float = 0.3, intercept: float = 0.3, window_min: float = 2.0, window_max: float = 8.0) -> tuple[np.ndarray, float]:
    """Progressive morphological filter: openings by growing windows, the threshold growing with the window's step."""
    surface = np.where(np.isnan(grid), np.nanmin(grid), grid)
    last, before, w = _odd(window_max / cell), 0, _odd(window_min / cell)
    while True:
        w = min(w, last)
        lower = opened(surface, w)
        limit = slope * (w - before) * cell + intercept
        surface = np.where(surface - lower > limit, lower, surface)
        if w >= last:
            return surface, slope * cell + intercept
        before, w = w, w + 2


def smrf(grid: np.ndarray, cell: float = 1.0, slope: float = 0.2, window: float = 18.0, threshold: float = 0.4) -> tuple[np.ndarray, float]:
    """Openings at doubling windows; steep cells are due only at the larger ones."""
    surface = filled(grid)
    most = _odd(window / cell)
    gy, gx = np.gradient(surface, cell) if min(surface.shape) > 1 else (np.zeros_like(surface),) * 2
    due = np.minimum(3 + np.hypot(gx, gy) / max(slope, 1e-9) * (most - 3), most)
    level = 3
    while True:
        w = min(level if level % 2 else level + 1, most)
        lower = opened(surface, w)
        surface = np.where((due <= w) & (surface - lower > threshold), lower, surface)
        if w >= most:
            break
        level *= 2
    return surface, threshold


def csf(grid: np.ndarray, cell: float = 0.5, threshold: float = 0.5, rigidness: int = 3, iterations: int = 1000) -> tuple[np.ndarray, float]:
    """Cloth simulation: the scene upside down, a cloth falling on it, stiffened by relaxation."""
    floor = -grid
    cloth = np.full(grid.shape, np.nanmax(floor) + 1.0)
    solid = ~np.isnan(floor)
    for _ in range(iterations):
        old = cloth.copy()
        cloth = cloth - 0.05
        for _ in range(rigidness):
            p = np.pad(cloth, 1, mode="edge")
            cloth = cloth + 0.5 * ((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4 - cloth)
        cloth = np.where(solid, np.maximum(cloth, np.where(solid, floor, -np.inf)), cloth)
        if np.abs(cloth - old)[solid].max(initial=0) < 1e-4:
            break
    return -cloth, threshold


def _plate(x: np.ndarray, z: np.ndarray, at: np.ndarray, smoothing: float) -> np.ndarray:
    """A smoothing thin-plate spline through (x, z), evaluated in blocks."""

    def kernel(r2: np.ndarray) -> np.ndarray:
        return np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0.0)

    mid, unit = x.mean(0), max(float(np.ptp(x, 0).max()), 1.0)
    x, at = (x - mid) / unit, (at - mid) / unit
    n = len(x)
    a = np.zeros((n + 3, n + 3))
    a[:n, :n] = kernel(((x[:, None] - x[None]) ** 2).sum(2)) + smoothing / unit**2 * np.eye(n)
    a[:n, n:] = a[n:, :n].T[:] = np.column_stack([np.ones(n), x])
    weights = np.linalg.lstsq(a, np.concatenate([z, np.zeros(3)]), rcond=None)[0]
    out = np.empty(len(at))
    for lo in range(0, len(at), 4096):
        part = at[lo : lo + 4096]
        out[lo : lo + 4096] = kernel(((part[:, None] - x[None]) ** 2).sum(2)) @ weights[:n] + weights[n] + part @ weights[n + 1 :]
    return out


def mcc(grid: np.ndarray, cell: float = 1.0, scale: float = 1.5, threshold: float = 0.3, domains: int = 3, iterations: int = 10, most_centres: int = 1500) -> tuple[np.ndarray, float]:
    """Multiscale curvature: cells above a smoothed plate by the threshold go, until few go, at growing scales."""
    rows, cols = np.nonzero(~np.isnan(grid))
    place, z = np.column_stack([cols, rows]) * cell, grid[rows, cols]
    ground = np.ones(len(z), bool)
    for d in range(domains):
        for _ in range(iterations):
            own = np.flatnonzero(ground)
            if len(own) < 4:
                break
            some = own[:: -(-len(own) // most_centres)]
            above = z[own] - _plate(place[some], z[some], place[own], (scale + d) ** 2)
            gone = own[above > threshold]
            ground[gone] = False
            if len(gone) < max(1, 0.005 * len(own)):
                break
    own = np.flatnonzero(ground)
    if len(own) < 4:
        return filled(grid), threshold
    some = own[:: -(-len(own) // most_centres)]
    r, c = np.indices(grid.shape)
    surface = _plate(place[some], z[some], np.column_stack([c.ravel(), r.ravel()]) * cell, scale**2).reshape(grid.shape)
    return surface, threshold


class Triangles:
    """A Delaunay triangulation that grows point by point (Bowyer-Watson); circle tests are vectorised."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        mid, reach = (low + high) / 2, float((high - low).max()) * 1000 + 1
        self.points = [mid + reach * np.array(v) for v in ((-2.0, -1.0), (2.0, -1.0), (0.0, 2.0))]
        self.corners = np.array([[0, 1, 2]])
        self.centres, self.radii = self._circles(self.corners)

    def _circles(self, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.array(self.points)
        a, b, c = p[corners[:, 0]], p[corners[:, 1]] - p[corners[:, 0]], p[corners[:, 2]] - p[corners[:, 0]]
        d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        d = np.where(np.abs(d) < 1e-12, 1e-12, d)
        bb, cc = (b**2).sum(1), (c**2).sum(1)
        u = np.column_stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d])
        return a + u, (u**2).sum(1)

    def add(self, p: np.ndarray) -> None:
        hit = ((self.centres - p) ** 2).sum(1) < self.radii * (1 + 1e-12)
        if not hit.any():
            return
        bad = self.corners[hit]
        edges = np.sort(np.concatenate([bad[:, [0, 1]], bad[:, [1, 2]], bad[:, [2, 0]]]), axis=1)
        kinds, n = np.unique(edges, axis=0, return_counts=True)
        rim = kinds[n == 1]
        self.points.append(p)
        new = np.column_stack([rim, np.full(len(rim), len(self.points) - 1)])
        centres, radii = self._circles(new)
        self.corners = np.concatenate([self.corners[~hit], new])
        self.centres, self.radii = np.concatenate([self.centres[~hit], centres]), np.concatenate([self.radii[~hit], radii])

    def real(self) -> np.ndarray:
        """Triangles without the three helpers, numbered by insertion."""
        return self.corners[(self.corners > 2).all(1)] - 3


def atin(grid: np.ndarray, cell: float = 1.0, seed: float = 20.0, angle: float = 6.0, distance: float = 1.0, iterations: int = 10) -> tuple[np.ndarray, float]:
    """Adaptive TIN: from the lowest cell of each block, cells join that lie near the plane of their
    triangle, by height and by the angle to its corners; then ground grows over neighbours whose lowest is within the distance."""
    high, wide = grid.shape
    step = max(1, round(seed / cell))
    ground = np.zeros(grid.shape, bool)
    for r in range(0, high, step):
        for c in range(0, wide, step):
            block = grid[r : r + step, c : c + step]
            if not np.isnan(block).all():
                i = np.unravel_index(np.nanargmin(block), block.shape)
                ground[r + i[0], c + i[1]] = True
    surface = np.full(grid.shape, np.nan)
    if ground.sum() >= 4:
        tin = Triangles(np.zeros(2), np.array([wide, high]) * cell)
        rows, cols = np.nonzero(ground)
        order = np.random.default_rng(0).permutation(len(rows))
        held = []
        for _ in range(iterations):
            for i in order:
                tin.add(np.array([cols[i], rows[i]]) * cell + (rows[i] * 1e-7, cols[i] * 1e-7))
                held.append((cols[i] * cell, rows[i] * cell, grid[rows[i], cols[i]]))
            p = np.array(held)
            surface, steep = _planes(tin.real(), p, grid, cell)
            gap = np.abs(grid - surface)
            joins = ~ground & (gap <= distance) & (steep <= np.radians(angle))
            if not joins.any():
                break
            ground |= joins
            rows, cols = np.nonzero(joins)
            order = np.random.default_rng(0).permutation(len(rows))
    while True:
        own = np.pad(np.where(ground, grid, np.inf), 1, constant_values=np.inf)
        lowest = np.min([own[1 + i : 1 + i + high, 1 + j : 1 + j + wide] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        # A void is no ground: its gap is NaN.
        joins = ~ground & np.isfinite(lowest) & (np.abs(grid - np.where(np.isfinite(lowest), lowest, 0)) <= distance)
        if not joins.any():
            break
        ground |= joins
    return np.where(ground, grid, np.nan), distance


def _planes(triangles: np.ndarray, p: np.ndarray, grid: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell: the height of the plane over it, and the greatest angle to the triangle's corners."""
    plane, steep = np.full(grid.shape, np.nan), np.full(grid.shape, np.inf)
    for t in triangles:
        a, b, c = p[t]
        normal = np.cross(b - a, c - a)
        if abs(normal[2]) < 1e-9:
            continue
        lo, hi = np.floor(np.min([a, b, c], 0)[:2] / cell).astype(int), np.ceil(np.max([a, b, c], 0)[:2] / cell).astype(int) + 1
        rows, cols = np.mgrid[max(lo[1], 0) : min(hi[1], grid.shape[0]), max(lo[0], 0) : min(hi[0], grid.shape[1])]
        x, y = cols * cell, rows * cell
        area = normal[2]
        u = ((b[0] - x) * (c[1] - y) - (b[1] - y) * (c[0] - x)) / area
        v = ((c[0] - x) * (a[1] - y) - (c[1] - y) * (a[0] - x)) / area
        inside = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9)
        rows, cols = rows[inside], cols[inside]
        plane[rows, cols] = u[inside] * a[2] + v[inside] * b[2] + (1 - u[inside] - v[inside]) * c[2]
        unit = normal / np.linalg.norm(normal)
        at = np.column_stack([cols * cell, rows * cell, grid[rows, cols]])
        worst = np.zeros(len(at))
        for corner in (a, b, c):
            d = at - corner
            far = np.maximum(np.linalg.norm(d, axis=1), 1e-9)
            worst = np.maximum(worst, np.arcsin(np.clip(np.abs(d @ unit) / far, 0, 1)))
        steep[rows, cols] = worst
    return plane, steep


KERNELS: dict[str, Callable[..., tuple[np.ndarray, float]]] = {"pmf": pmf, "csf": csf, "smrf": smrf, "mcc": mcc, "atin": atin}


def ground_mask(xyz: np.ndarray, method: Method, cell: float | None = None, **options) -> np.ndarray:
    """Which of one tile's points are ground."""
    if not len(xyz):
        return np.zeros(0, bool)
    cell = cell or (0.5 if method == "csf" else 1.0)
    at = np.floor((xyz[:, :2] - xyz[:, :2].min(0)) / cell).astype(np.int64)
    wide, high = at.max(0) + 1
    if wide * high > MOST_CELLS:
        raise ValueError(f"a grid of {wide} x {high} cells; use larger cells or smaller tiles")
    grid = np.full((high, wide), np.inf)
    np.minimum.at(grid, (at[:, 1], at[:, 0]), xyz[:, 2])
    grid[np.isinf(grid)] = np.nan
    surface, band = KERNELS[method](grid, cell=cell, **options)
    return xyz[:, 2] <= surface[at[:, 1], at[:, 0]] + band


def classify_ground(points: DataFrame, method: Method = "pmf", tile: tuple[str, ...] = ("tile_col", "tile_row"), output_class: int = GROUND, **options) -> DataFrame:
    """points with ground points tagged output_class, tile by tile; withheld points neither shape the surface nor get tagged."""
    if "classification" not in points.columns:
        raise ValueError("points have no classification to write to")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        use = ~own["withheld"].fillna(False).astype(bool) if "withheld" in own else pd.Series(True, index=own.index)
        hit = np.zeros(len(own), bool)
        hit[use.to_numpy()] = ground_mask(own.loc[use, ["x", "y", "z"]].to_numpy(np.float64), method, **options)
        out = own.copy()
        out.loc[hit, "classification"] = output_class
        return out

    return points.groupBy(*(tile or [F.lit(0)])).applyInPandas(run, points.schema)
