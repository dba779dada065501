import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnfield.functions.lattice import Raster, Tiles, grid_cell
from cairnfield.operators import points, tiling, wkt
from cairnfield.operators.neighbours import nearest_distances, radius_outliers


def table(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_ground_is_protected_and_withheld_is_tagged(spark):
    p = table(spark, z=[5.0, 500.0, 500.0, 5.0], classification=[5, 5, 2, 2], withheld=[False, False, False, True])
    got = [r["classification"] for r in points.elevation_range(p, 0, 100).collect()]
    assert got == [5, 7, 2, 7]
    assert points.elevation_range(p, 0, 100, action="remove").count() == 2


@pytest.mark.parametrize("c", [2, 8, 12])
def test_reserved_classes_are_refused(spark, c):
    with pytest.raises(ValueError):
        points.elevation_range(table(spark, z=[1.0], classification=[1]), target_class=c)


def test_missing_dimension_passes_through(spark):
    p = table(spark, z=[1.0, 2.0], classification=[1, 1])
    assert points.scan_angle_range(p, -1, 1).count() == points.by_flags(p).count() == points.by_return(p).count() == 2


def test_class_list():
    assert points.class_list("2, 5,255") == [2, 5, 255]
    for bad in ("x", "300"):
        with pytest.raises(ValueError):
            points.class_list(bad)


def test_decimate(spark):
    p = table(spark, point_id=list(range(100)), key_point=[i == 1 for i in range(100)])
    assert points.decimate(p, ratio=25).count() == 26
    assert points.decimate(p, ratio=100).count() == 100
    assert points.decimate(p.drop("key_point"), ratio=0).count() == 1
    assert points.decimate(p.drop("key_point"), mode="adaptive", target=40).count() == 34
    a, b = (points.decimate(p.drop("key_point"), strategy="random", seed=s) for s in (1, 2))
    assert a.count() == b.count() == 25 and a.exceptAll(b).count() > 0


def test_clip_keeps_the_border(spark):
    p = table(spark, x=[5.0, 20.0, 0.0, 5.0, 10.5], y=[5.0, 20.0, 0.0, 5.0, 5.0])
    square = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    assert points.clip_polygon(p, square).count() == 3
    assert points.clip_polygon(p, square, 1.0).count() == 4
    with_hole = wkt.polygons("POLYGON ((0 0, 10 0, 10 10, 0 10), (4 4, 6 4, 6 6, 4 6))")
    assert wkt.covers(with_hole, np.array([5.0, 4.0, 1.0]), np.array([5.0, 5.0, 1.0])).tolist() == [False, True, True]
    two = wkt.polygons("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")
    assert wkt.covers(two, np.array([0.9, 5.9, 3.0]), np.array([0.5, 5.5, 3.0])).tolist() == [True, True, False]
    for bad in ("POINT (1 1)", "POLYGON ((0 0, 1 1))", "POLYGON ((0 0, 1 0, 1 1)"):
        with pytest.raises(ValueError):
            wkt.polygons(bad)


def test_sloping_borders_are_half_planes():
    """Points of hundredths on the slopes: where rounding moves them off the border, the side is that of the segment's half-plane."""
    corners = [(20, 20), (180, 40), (100, 180)]
    x, y = [], []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        t = np.arange(0, 2001)
        px, py = ax * 100 + t * (bx - ax) // 20, ay * 100 + t * (by - ay) // 20
        x.append(px / 100.0)
        y.append(py / 100.0)
    x, y = np.concatenate(x), np.concatenate(y)
    want = (160 * (y - 20) - 20 * (x - 20) >= 0) & (-80 * (y - 40) - 140 * (x - 180) >= 0) & (-80 * (y - 180) + 160 * (x - 100) >= 0)
    shell = wkt.polygons("POLYGON ((20 20, 180 40, 100 180, 20 20))")
    assert np.array_equal(wkt.covers(shell, x, y), want) and 0 < want.sum() < len(want)


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.uniform(0, 30, (400, 3)), rng.normal(5, 0.1, (200, 3)), np.ones((5, 3))])
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(nearest_distances(xyz, 7), np.sort(d, 1)[:, :7])
    assert np.isinf(nearest_distances(xyz[:3], 5)[:, 2:]).all()


@pytest.mark.parametrize(("radius", "least"), [(2, 3), (5, 4), (0.5, 2), (10, 6), (1, 1), (1, 999)])
def test_radius_rule(spark, radius, least):
    rng = np.random.default_rng(11)
    xyz = rng.uniform(0, 30, (300, 3)) + (500_000, 4_000_000, 0)
    p = table(spark, x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2], classification=np.ones(300, int))
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    kept = ((d <= radius).sum(1) >= least).sum()
    assert radius_outliers(p, radius, least, (), action="remove").count() == kept


def test_lattices():
    t = Tiles.over(0, 0, 200, 150, 100)
    assert (t.cols, t.rows) == (2, 2)
    r = Raster.over(0.3, 0.3, 9.7, 9.7, 1.0)
    assert (r.west, r.north, r.width, r.height) == (0, 10, 10, 10)
    with pytest.raises(ValueError):
        r.offset_of(Raster(0.5, 10, 1.0, 5, 5))
    with pytest.raises(ValueError):
        r.offset_of(Raster(0, 10, 2.0, 5, 5))


def test_border_points(spark):
    """A point on a horizontal line: below it in rasters, above it in grids; the far edge is in the last tile."""
    p = table(spark, x=[5.0, 200.0], y=[5.0, 200.0])
    r = Raster(0.0, 10.0, 1.0, 10, 10)
    row = p.select(r.row(F.col("y")).alias("r"), grid_cell(F.col("x"), F.col("y"), 1.0)[1].alias("g")).first()
    assert (row["r"], row["g"]) == (5, 5)
    t = Tiles.over(0, 0, 200, 200, 100)
    assert [tuple(r) for r in tiling.with_tiles(p, t).select("tile_col", "tile_row").collect()] == [(0, 0), (1, 1)]


@pytest.mark.parametrize("buffer", [0.0, 3.0, 25.0])
def test_each_point_is_core_once(spark, buffer):
    rng = np.random.default_rng(1)
    p = table(spark, x=rng.uniform(0, 100, 500), y=rng.uniform(0, 100, 500), z=rng.uniform(0, 1, 500))
    tiles = Tiles.over(0, 0, 100, 100, 10)
    tiled = tiling.with_tiles(p, tiles, buffer).toPandas()
    assert tiled.is_core.sum() == 500
    for (c, r), own in tiled.groupby(["tile_col", "tile_row"]):
        inside = p.toPandas().query(f"{c * 10 - buffer} <= x <= {c * 10 + 10 + buffer} and {r * 10 - buffer} <= y <= {r * 10 + 10 + buffer}")
        assert abs(len(own) - len(inside)) <= 1


def test_sparse_merge_partitions_the_plane():
    rng = np.random.default_rng(5)
    counts = {(int(c), int(r)): int(n) for c, r, n in zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 50, 300), strict=True)}
    merged = tiling.merge_sparse(counts, 100, frozenset([(3, 3)]))
    members = [m for t in merged for m in t.members]
    assert sorted(members) == sorted(k for k, n in counts.items() if n) and len(set(members)) == len(members)
    for t in merged:
        assert t.span <= 8 and (t.count <= 100 or t.span == 1) and t.count == sum(counts[m] for m in t.members)
        assert all(t.col <= c < t.col + t.span and t.row <= r < t.row + t.span for c, r in t.members)


def test_batches_and_names():
    assert tiling.batches([(0, 0, 5), (0, 1, 5), (0, 2, 20), (1, 0, 1)], 10) == [[(0, 0), (0, 1)], [(0, 2)], [(1, 0)]]
    assert tiling.tile_id(3, 4) == "c0003_r0004"
    assert tiling.tile_id(3, 4, 2, 1, 0) == "c0003_r0004_s2_01_00"
    assert tiling.suggested_floor(10) == 50_000
    assert tiling.preflight(10**6, 10**6, 100, 4, 8 << 30).tiles == 100
