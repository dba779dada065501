"""Polygons in well-known text: parsing, covering and distance, vectorised over points."""

from __future__ import annotations

import re

import numpy as np

#: A polygon is a list of rings, the first its shell; a ring is an n x 2 array, closed.
Polygon = list[np.ndarray]


def polygons(text: str) -> list[Polygon]:
    """Of POLYGON and MULTIPOLYGON; anything else, or a ring of fewer than three corners, is refused."""
    body = text.strip()
    kind = re.match(r"(MULTI)?POLYGON\s*(Z\s*)?\(", body, re.IGNORECASE)
    if not kind or body.count("(") != body.count(")"):
        raise ValueError("not a POLYGON or MULTIPOLYGON")
    body = body[body.index("(") :]
    inner = re.findall(r"\(\s*((?:\([^()]*\)\s*,?\s*)+)\)", body)
    out = []
    for part in inner:
        rings = []
        for ring in re.findall(r"\(([^()]*)\)", part):
            corners = np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",")])
            if not np.array_equal(corners[0], corners[-1]):
                corners = np.vstack([corners, corners[:1]])
            if len(corners) < 4:
                raise ValueError("a ring needs three corners")
            rings.append(corners)
        out.append(rings)
    if not out:
        raise ValueError("an empty polygon")
    return out


def bounds(parts: list[Polygon]) -> tuple[float, float, float, float]:
    shell = np.vstack([p[0] for p in parts])
    return (*shell.min(0).tolist(), *shell.max(0).tolist())


def _segments(ring: np.ndarray):
    return zip(ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1], strict=True)


def distance(parts: list[Polygon], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """To the nearest border, wherever the point lies."""
    best = np.full(len(x), np.inf)
    for ring in (r for p in parts for r in p):
        for ax, ay, bx, by in _segments(ring):
            dx, dy = bx - ax, by - ay
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
            best = np.minimum(best, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def covers(parts: list[Polygon], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inside by the even-odd rule, or on a border.

    The side of a segment is always the sign of one cross product, so a point that rounding puts
    beside a border is on the side where the half-plane of that segment has it.
    """
    out = np.zeros(len(x), bool)
    for polygon in parts:
        odd, border = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for ring in polygon:
            for ax, ay, bx, by in _segments(ring):
                cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                border |= (cross == 0) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
                if ay != by:
                    spans = (ay > y) != (by > y)
                    odd ^= spans & ((cross > 0) if by > ay else (cross < 0))
        out |= odd | border
    return out
