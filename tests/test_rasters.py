import itertools
import math

import numpy as np
import pandas as pd
import pytest

from cairnfield.functions.lattice import Raster, Tiles
from cairnfield.operators import metrics, neighbours, raster, surfaces, tiling

R = Raster(0.0, 12.0, 1.0, 10, 12)


def cells(spark, a):
    r, c = np.nonzero(~np.isnan(a))
    return spark.createDataFrame(pd.DataFrame({"row": r, "col": c, "value": a[r, c]}))


def back(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


@pytest.fixture
def holed():
    rng = np.random.default_rng(11)
    a = rng.uniform(0, 50, (12, 10))
    a[rng.random(a.shape) < 0.15] = np.nan
    return a


def test_smooth_against_padding(spark, holed):
    """Half-sample reflection, also where the kernel is wider than the raster."""
    for sigma in (1.0, 3.0):
        n = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
        k /= k.sum()

        def blur(a, n=n, k=k):
            p = np.pad(a, n, mode="symmetric")
            p = sum(w * p[i : i + a.shape[0]] for i, w in enumerate(k))
            return sum(w * p[:, i : i + a.shape[1]] for i, w in enumerate(k))

        valid = ~np.isnan(holed)
        want = np.where(valid, blur(np.where(valid, holed, 0)) / blur(valid.astype(float)), np.nan)
        assert np.allclose(back(raster.smooth(cells(spark, holed), R, sigma), holed.shape), want, equal_nan=True)


def test_median_against_padding(spark, holed):
    p = np.pad(holed, 1, mode="reflect")
    want = np.nanmedian([p[i : i + 12, j : j + 10] for i, j in itertools.product(range(3), repeat=2)], axis=0)
    want[np.isnan(holed)] = np.nan
    assert np.allclose(back(raster.median(cells(spark, holed), R), holed.shape), want, equal_nan=True)


def test_fill_against_brute_force(spark, holed):
    want = holed.copy()
    valid = np.argwhere(~np.isnan(holed))
    for r, c in np.argwhere(np.isnan(holed)):
        d = [((r - i) ** 2 + (c - j) ** 2, i, j) for i, j in valid]
        if min(d)[0] <= 4:
            want[r, c] = holed[min(d)[1:]]
    assert np.allclose(back(raster.fill_holes(cells(spark, holed), R, 2.0), holed.shape), want, equal_nan=True)


@pytest.mark.parametrize(("gx", "gy"), [(1.0, 0.0), (0.0, 0.5), (-0.3, 0.7), (0.0, 0.0)])
def test_terrain_of_planes(spark, gx, gy):
    r, c = np.indices((12, 10))
    z = cells(spark, gx * c - gy * r + 100.0)
    steep = math.degrees(math.atan(math.hypot(gx, gy)))
    assert np.allclose([x["value"] for x in raster.slope(z, R).collect()], steep)
    facing = math.degrees(math.atan2(-gx, -gy)) % 360 if steep else -1
    assert np.allclose([x["value"] for x in raster.aspect(z, R).collect()], facing)
    assert raster.slope(z, R).count() == 80
    shade = [x["value"] for x in raster.hillshade(z, R).collect()]
    if not steep:
        assert np.allclose(shade, 255 * math.cos(math.radians(45)))


def test_crop_and_finish(spark):
    a = np.full((12, 10), np.nan)
    a[3:6, 2:9] = 7.0
    small, df = raster.finish(cells(spark, a), R, fill=0, sigma=1.0, median_size=3)
    assert (small.west, small.north, small.width, small.height) == (2.0, 9.0, 7, 3)
    assert np.allclose(back(df, (3, 7)), 7.0)


def test_mosaic_refuses_other_lattices(spark):
    a = cells(spark, np.ones((2, 2)))
    with pytest.raises(ValueError):
        raster.mosaic([(R, a), (Raster(0.5, 12.0, 1.0, 2, 2), a)])
    assert raster.mosaic_plan([R, Raster(0, 12, 1.0, 2, 2, "EPSG:1")]) == [None, "another coordinate system"]


def test_resample(spark):
    a = np.arange(120, dtype=float).reshape(12, 10)
    got = back(raster.resample(cells(spark, a), R, Raster(0.0, 12.0, 2.5, 4, 5)), (5, 4))
    for i, j in np.argwhere(~np.isnan(got)):
        assert got[i, j] == a[int((i + 0.5) * 2.5), int((j + 0.5) * 2.5)]


def test_pit_free(spark):
    a = np.zeros((4, 4))
    a[0, 0] = 9
    assert (back(raster.pit_free(cells(spark, a)), (4, 4)) == 9).all()


def test_hand_made_cells(spark):
    p = pd.DataFrame({"x": [1.0, 2, 3, 4, 15, 16], "y": [1.0, 2, 3, 4, 5, 6], "z": [400.0, 401, 402, 403, 410, 411], "classification": [2, 2, 0, 7, 0, 0], "intensity": [100, 200, 300, 400, 1000, 1000], "return_number": [1, 1, 2, 1, 1, 2], "number_of_returns": [2, 2, 2, 1, 1, 1]})
    got = {(r["cell_col"], r["cell_row"]): r for r in metrics.grid_metrics(spark.createDataFrame(p), 10.0).collect()}
    a = got[0, 0]
    assert (a["point_count"], a["z_min"], a["z_max"], a["z_mean"], a["ground_count"], a["noise_count"], a["intensity_mean"], a["dominant_class"]) == (4, 400, 403, 401.5, 2, 1, 250, 2)
    assert got[1, 0]["point_count"] == 2 and got[1, 0]["ground_count"] == 0


def test_vegetation_bins(spark):
    h = [5.0, 6, 7, 8, 9, 10, 12, 14, -3, 99]
    df = spark.createDataFrame(pd.DataFrame({"x": 1.0, "y": 1.0, "h": h}))
    bins = metrics.vegetation_partial(df, 10.0).first()["bins"]
    assert [i for i, n in enumerate(bins) if n] == [0, 5, 6, 7, 8, 9, 10, 12, 14, 60] and len(bins) == 61
    f = metrics.vegetation_final(metrics.vegetation_partial(df, 10.0)).first()
    assert f["cover"] == 0.9 and f["p50"] == 9.0 - 1 + 1.0


@pytest.mark.parametrize("size", [20, 50, 200])
def test_products_do_not_depend_on_tiles(spark, size):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame(pd.DataFrame({"x": rng.uniform(0, 200, 2000).round(0), "y": rng.uniform(0, 200, 2000).round(0), "z": rng.uniform(0, 9, 2000), "classification": rng.choice([2, 5], 2000)}))
    r = Raster(0.0, 200.0, 10.0, 20, 20)
    tiled = tiling.core_only(tiling.with_tiles(p, Tiles.over(0, 0, 200, 200, size), 5.0))
    assert np.array_equal(back(surfaces.dsm(tiled, r), (20, 20)), back(surfaces.dsm(p, r), (20, 20)), equal_nan=True)


def test_heights_go_and_come_back(spark):
    r, c = np.indices((12, 10))
    ground = cells(spark, 100 + c + 2.0 * r)
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"point_id": range(200), "x": rng.uniform(0, 10, 200), "y": rng.uniform(0, 12, 200), "z": rng.uniform(100, 140, 200)})
    p["withheld"] = p.point_id % 50 == 0
    flat = neighbours.normalise_heights(spark.createDataFrame(p), ground, R)
    again = neighbours.denormalise_heights(flat, ground, R).toPandas().sort_values("point_id")
    assert np.allclose(again.z, p.z)
    f = flat.toPandas().sort_values("point_id").reset_index(drop=True)
    inside = p.x.between(0.5, 9.49) & p.y.between(0.51, 11.5) & ~p.withheld
    assert np.allclose(f.z[inside], (p.z - (100 + (p.x - 0.5) + 2 * (12 - p.y - 0.5)))[inside])
    assert (f.z[p.withheld] == p.z[p.withheld]).all()
