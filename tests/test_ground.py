"""Ground filters on a scene whose ground is known."""

import numpy as np
import pandas as pd
import pytest

from cairnfield.operators import ground


@pytest.fixture(scope="module")
def scene():
    """100 x 100 m, 12 points a square metre, deviation 5 cm: a plane at 400 m with a terrace of 1.5 m from x = 60 and a road
    0.3 m high, roofs of 8 x 8 and 15 x 10 m at 6 m, a forest of 20 x 20 m without ground, eight cone trees, a bridge deck above ground.
    """
    rng = np.random.default_rng(101)
    parts: list[tuple[np.ndarray, str]] = []

    def box(n, x0, y0, x1, y1):
        return rng.uniform((x0, y0), (x1, y1), (n, 2))

    def put(xy, z, kind):
        parts.append((np.column_stack([xy, z + rng.normal(0, 0.05, len(xy))]), kind))

    inside = lambda p, x0, y0, x1, y1: (p[:, 0] >= x0) & (p[:, 0] < x1) & (p[:, 1] >= y0) & (p[:, 1] < y1)
    small, big, forest, road = (16, 71, 24, 79), (64.5, 67, 79.5, 77), (10, 10, 30, 30), (0, 45, 60, 50)
    open_ground = box(120_000, -0.1, -0.1, 100, 100)  # so that cells are not in line with roofs
    open_ground = open_ground[~(inside(open_ground, *small) | inside(open_ground, *big) | inside(open_ground, *forest))]
    on_road, high = inside(open_ground, *road), open_ground[:, 0] >= 60
    put(open_ground[on_road], 400.3, "road")
    put(open_ground[high & (open_ground[:, 0] > 62)], 401.5, "terrace")
    put(open_ground[high & (open_ground[:, 0] <= 62)], 401.5, "ground")
    put(open_ground[~high & ~on_road], 400.0, "ground")
    put(box(1500, *small), 406.0, "small")
    put(box(1500, *big), 407.5, "big")
    under = box(8000, *forest)
    put(under, 400 + rng.uniform(2, 12, 8000), "forest")
    for x, y in ((45, 20), (55, 30), (35, 60), (50, 80), (80, 40), (10, 40), (85, 85), (5, 90)):
        r, turn = 2 * np.sqrt(rng.random(120)), rng.uniform(0, 2 * np.pi, 120)
        put(np.column_stack([x + r * np.cos(turn), y + r * np.sin(turn)]), 408 - 4 * r, "tree")
    put(box(400, 40, 75, 60, 80), 404.0, "deck")
    return np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), k, object) for p, k in parts])


#: What may remain of each kind as ground, by method; the progressive filter's window is narrower than the big roof, which it keeps.
MOST = {
    "pmf": {"small": 0.05, "deck": 0.05, "tree": 0.3, "forest": 0.15}, "csf": {"small": 0.05, "big": 0.05, "deck": 0.05, "tree": 0.3, "forest": 0.15},
    "smrf": {"small": 0.05, "big": 0.05, "deck": 0.05, "tree": 0.3, "forest": 0.1}, "mcc": {"small": 0.05, "big": 0.05, "deck": 0.05, "tree": 0.3, "forest": 0.05},
    "atin": {"small": 0.05, "big": 0.05, "deck": 0.05, "tree": 0.3, "forest": 0.05},
}


@pytest.mark.parametrize("method", sorted(ground.KERNELS))
def test_scene(scene, method):
    xyz, kind = scene
    hit = ground.ground_mask(xyz, method)
    for k, most in MOST[method].items():
        assert hit[kind == k].mean() < most, k
    for k in ("road", "terrace"):
        assert hit[kind == k].mean() > 0.8, k
    if method == "pmf":
        assert hit[kind == "big"].mean() > 0.5
    assert (hit != np.isin(kind, ["ground", "road", "terrace"])).mean() < 0.12


def test_tiles_and_withheld(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"x": rng.uniform(0, 40, 800), "y": rng.uniform(0, 40, 800), "z": 1.0, "classification": 1, "withheld": False, "tile_col": 0, "tile_row": 0})
    p.loc[0, "withheld"] = True
    p.loc[1, "z"] = 30.0
    got = ground.classify_ground(spark.createDataFrame(p), "pmf").toPandas()
    assert (got.classification == 2).sum() == 798
    with pytest.raises(ValueError):
        ground.classify_ground(spark.createDataFrame(p).drop("classification"))


def test_triangulation_is_delaunay():
    rng = np.random.default_rng(8)
    pts = rng.uniform(0, 10, (60, 2))
    t = ground.Triangles(np.zeros(2), np.full(2, 10.0))
    for p in pts:
        t.add(p)
    for tri in t.real():
        a, b, c = pts[tri]
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        u = np.array([(a @ a * (b[1] - c[1]) + b @ b * (c[1] - a[1]) + c @ c * (a[1] - b[1])) / d, (a @ a * (c[0] - b[0]) + b @ b * (a[0] - c[0]) + c @ c * (b[0] - a[0])) / d])
        assert (np.hypot(*(pts - u).T) >= np.hypot(*(a - u)) - 1e-6).all()


def test_opening_against_brute_force():
    a = np.random.default_rng(1).uniform(0, 9, (14, 9))

    def slide(a, by):
        p = np.pad(a, 2, constant_values=np.inf if by is np.min else -np.inf)
        return np.array([[by(p[i : i + 5, j : j + 5]) for j in range(9)] for i in range(14)])

    assert np.array_equal(ground.opened(a, 5), slide(slide(a, np.min), np.max))
