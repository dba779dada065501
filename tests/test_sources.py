import json
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnfield.functions.lattice import Raster
from cairnfield.operators import report, tables
from cairnfield.sources import grids, las, sinks, vectors


@pytest.fixture
def cloud(spark):
    rng = np.random.default_rng(0)
    n = 250
    return spark.createDataFrame(pd.DataFrame({"x": rng.uniform(100, 200, n).round(3), "y": rng.uniform(200, 300, n).round(3), "z": rng.uniform(400, 410, n).round(3), "intensity": rng.integers(0, 65_000, n), "classification": rng.integers(0, 200, n), "return_number": rng.integers(1, 4, n), "number_of_returns": 3, "scan_angle": rng.integers(-30, 30, n).astype(float), "point_source_id": 7, "gps_time": rng.uniform(0, 9, n)}))


def test_las_round_trip(spark, cloud, tmp_path, monkeypatch):
    path = str(tmp_path / "a.las")
    assert las.write_las(cloud, path) == 250
    h = las.read_header(path)
    assert (h.count, h.format, h.minor) == (250, 6, 4)
    monkeypatch.setattr(las, "RANGE", 100)
    got = las.read_las(spark, path).toPandas().sort_values(["x", "y"]).reset_index(drop=True)
    want = cloud.toPandas().sort_values(["x", "y"]).reset_index(drop=True)
    assert "nir" not in got and sorted(got.point_id) == list(range(250))
    for c in want.columns:
        # Formats from 6 on keep angles in steps of 0.006 degrees.
        assert np.allclose(got[c].astype(float), want[c].astype(float), atol=3.1e-3 if c == "scan_angle" else 6e-4), c
    assert las.union_area([h, h])[0] == 500


def test_folder_of_files_and_heights(spark, tmp_path):
    """Ids are unique over the files of a folder; heights are sampled without any key."""
    from cairnfield.operators import neighbours

    for i in range(2):
        las.write_las(spark.createDataFrame([(10.0 + i, 10.0, 9.0)], "x double, y double, z double"), str(tmp_path / f"{i}.las"))
    both = las.read_las(spark, str(tmp_path))
    assert both.select("point_id").distinct().count() == 2
    r = Raster(0.0, 20.0, 5.0, 4, 4)
    terrain = spark.createDataFrame([(i, j, 5.0) for i in range(4) for j in range(4)], "row long, col long, value double")
    for rows in (both, both.withColumn("point_id", F.lit(0).cast("long"))):
        lower = neighbours.normalise_heights(rows, terrain, r)
        assert lower.columns == rows.columns and [x["z"] for x in lower.collect()] == [4.0, 4.0]
        assert [x["z"] for x in neighbours.denormalise_heights(lower, terrain, r).collect()] == [9.0, 9.0]


def test_las_keeps_what_the_table_has(spark, tmp_path):
    rows = [(1.0, 2.0, 3.0, 40, 9, 12, 100, 65_000, 7, 8, True, False, True, False, 45.0), (2.0, 2.0, 3.0, 255, 15, 15, None, 0, 0, 1, False, True, False, True, -90.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double, classification int, return_number int, number_of_returns int, red int, green int, blue int, nir int, withheld boolean, overlap boolean, synthetic boolean, key_point boolean, scan_angle double")
    las.write_las(df, str(tmp_path / "a.las"))
    got = las.read_las(spark, str(tmp_path / "a.las")).orderBy("x").collect()
    for want, r in zip(df.collect(), got, strict=True):
        assert all(abs((want[c] or 0) - r[c]) < 4e-3 for c in df.columns), r
    las.write_las(df.limit(0), str(tmp_path / "none.las"))
    assert las.read_header(str(tmp_path / "none.las")).count == 0


def test_headers_are_checked(tmp_path):
    with pytest.raises(ValueError):
        las.parse_header(b"nothing")
    data = bytearray(375)
    data[:4], data[25], data[104] = b"LASF", 4, 0x80 | 6
    data[247:255] = (5_000_000_000).to_bytes(8, "little")
    h = las.parse_header(bytes(data))
    assert h.compressed and h.count == 5_000_000_000 and h.format == 6


def test_ascii_and_tiff(spark, tmp_path):
    r = Raster(500.0, 900.0, 2.0, 5, 4, "EPSG:32720")
    cells = spark.createDataFrame(pd.DataFrame({"row": [0, 1, 3], "col": [0, 4, 2], "value": [1.5, -2.25, 7.0]}))
    want = {(0, 0, 1.5), (1, 4, -2.25), (3, 2, 7.0)}
    grids.write_ascii(cells, r, str(tmp_path / "a.asc"))
    meta, got = grids.read_ascii(spark, str(tmp_path / "a.asc"))
    assert (meta.west, meta.north, meta.res, meta.width, meta.height) == (500, 900, 2, 5, 4)
    assert {(x["row"], x["col"], x["value"]) for x in got.collect()} == want
    grids.write_geotiff(cells, r, str(tmp_path / "a.tif"))
    meta, got, warnings = grids.read_geotiff(spark, str(tmp_path / "a.tif"))
    assert meta == r and warnings == []
    assert {(x["row"], x["col"], x["value"]) for x in got.collect()} == want
    with pytest.raises(ValueError):
        grids.read_geotiff(spark, str(tmp_path / "a.tif"), [2])


def test_gpkg_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    cells = spark.createDataFrame([(0, 0, "0_0", 1.5, None), (10, 2, "10_2", None, "x"), (9, 1, "9_1", 2.0, "y")], "cell_col long, cell_row long, gid string, cover double, label string")
    assert vectors.write_gpkg(cells, path, res=10.0, srid=5346) == 3
    with sqlite3.connect(path) as con:
        assert [r[0] for r in con.execute("select gid from cells order by fid")] == ["0_0", "10_2", "9_1"]
    got = vectors.read_gpkg(spark, path).toPandas()
    assert list(got.columns) == ["geom", "cell_col", "cell_row", "gid", "cover", "label"]
    assert np.isnan(got.cover[1]) and got.label[0] == "" and len(got.geom[0]) == 93
    assert vectors.read_gpkg(spark, path, ["gid"]).columns == ["gid"]
    with pytest.raises(Exception, match="no attribute table"):
        vectors.read_gpkg(spark, path, layer="nope").count()


def test_geojson_and_csv(spark, tmp_path, monkeypatch):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"b": 1, "a": "x"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {"c": None}, "geometry": {"type": "Point"}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = vectors.read_geojson(spark, str(tmp_path / "a.json"))
    assert got.columns == ["b", "a", "c", "geometry"]
    rows = got.collect()
    assert rows[0]["b"] == "1" and rows[0]["geometry"] and rows[1]["geometry"] is None
    many = {"type": "Feature", "properties": {f"k{i}": i for i in range(12)}, "geometry": None}
    (tmp_path / "many.json").write_text(json.dumps(many))
    monkeypatch.setattr(vectors, "MOST_KEYS", 11)
    with pytest.raises(ValueError, match="more than 11"):
        vectors.read_geojson(spark, str(tmp_path / "many.json"))
    for name, text in (("a", "﻿x,y\n1,2\n"), ("b", "y,z\n3,4\n")):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    both = tables.concatenate(*[vectors.read_csv(spark, str(tmp_path / f"{n}.csv")) for n in "ab"])
    assert both.columns == ["x", "y", "z"] and sorted(map(tuple, both.collect())) == [("", "3", "4"), ("1", "2", "")]


def test_sinks(spark, cloud, tmp_path):
    tiled = cloud.selectExpr("*", "0 tile_col", "0 tile_row", "x < 150 is_core")
    sinks.export_points([tiled], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == cloud.where("x < 150").count()
    with pytest.raises(ValueError):
        sinks.export_points([tiled, tiled.drop("z")], str(tmp_path / "no"))
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "row long, col long, value double")
    assert 'colorRampType="EXACT"' in sinks.style(cells) and sinks.value_range(cells) == (1.0, 3.0)
    doc = sinks.provenance("dtm", [], ["a.las"])
    assert json.loads(open(sinks.write_provenance(doc, str(tmp_path / "dtm"))).read())["product"] == "dtm"


def test_strips(spark):
    rows = [(x, y, 10.0 + line * 0.05, line) for line in (0, 1) for x in (1, 6, 11) for y in (1, 6, 11) for _ in range(6)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["x", "y", "z", "point_source_id"]))
    r = report.strip_agreement(df).first()
    assert (r["pairs"], r["rmsdz"], r["ok"]) == (9, 0.05, True)
    assert report.quality(failed_tasks=1)[0] == "FAIL" and report.quality()[0] == "PASS"
    assert report.quality(crs=("a", "b"))[0] == "FAIL"
    assert "reserved classes in use" in report.alerts({}, {8: 1})
