import json

import numpy as np
import pandas as pd
import pytest

from cairnfield import cli
from cairnfield.plans import ports
from cairnfield.plans.graph import Graph, ProjectError, over_files
from cairnfield.plans.nodes import NODES
from cairnfield.streaming import queue


def project(nodes, edges, version=2):
    return {"version": version, "nodes": [{"iid": k, "id": i, "config": c} for k, i, c in nodes], "edges": [dict(zip(("src", "dst", "out_type", "in_type"), e, strict=True)) for e in edges]}


@pytest.fixture
def cloud(spark, tmp_path):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"point_id": range(400), "x": rng.uniform(0, 40, 400), "y": rng.uniform(0, 40, 400), "z": rng.uniform(0, 1, 400), "classification": 1, "intensity": 5, "return_number": 1, "number_of_returns": 1})
    path = str(tmp_path / "points")
    spark.createDataFrame(p).write.parquet(path)
    return path


def test_classify_and_grid(spark, cloud):
    g = Graph.parse(project([("a", "load_points", {"path": cloud, "tile_size": 20.0, "buffer": 3.0}), ("b", "classify_ground", {}), ("c", "grid_metrics", {"res": 10.0}), ("d", "generate_dtm", {"res": 10.0, "fill": 0, "sigma": 0}), ("e", "terrain_slope", {})],
                            [("a", "b", "point_cloud", "point_cloud"), ("b", "c", "classified_point_cloud", "point_cloud"), ("b", "d", "classified_point_cloud", "point_cloud"), ("d", "e", "dtm_mosaic", "dtm_mosaic")]))
    assert g.problems() == []
    out = g.compile(spark)
    assert out["c"]["table"].agg({"point_count": "sum"}).first()[0] == 400
    assert out["e"]["raster"][1].count() == 4
    assert g.upstream("c").nodes.keys() == {"a", "b", "c"}
    assert [e.dst for e in g.boundary({"a", "b"})[1]] == ["c", "d"]


def test_checks():
    with pytest.raises(ProjectError):
        Graph.parse({"nodes": []})
    with pytest.raises(ProjectError):
        Graph.parse(project([], [], 99))
    with pytest.raises(ProjectError):
        Graph.parse(project([("a", "grid_metrics", {}), ("a", "grid_metrics", {})], []))
    with pytest.raises(ProjectError):
        Graph.parse(project([("a", "grid_metrics", {})], [("a", "z", "x", "y")]))
    g = Graph.parse(project([("a", "return_filter", {"mood": 1}), ("b", "return_filter", {})], [("a", "b", "point_cloud", "point_cloud"), ("b", "a", "point_cloud", "point_cloud")]))
    assert any("cycle" in p for p in g.problems()) and any("setting" in p for p in g.problems())
    assert ports.fits("point_cloud", "classified_point_cloud") and not ports.fits("table", "table_csv")
    ports.add_port("mine", {"raster"})
    assert ports.known("mine") and ports.fits("mine", "raster")


def test_pruning_and_deferral():
    g = Graph.parse(project([("a", "load_points", {"path": "x"}), ("b", "return_filter", {}), ("c", "grid_metrics", {}), ("d", "consolidate_grid_metrics", {}), ("e", "decimate", {})],
                            [("a", "b", "point_cloud", "point_cloud"), ("b", "c", "point_cloud", "point_cloud"), ("c", "d", "grid_metrics", "grid_metrics")]))
    assert "e" not in g.without_drafts().nodes
    p = g.without_drafts().pruned({"b"})
    assert [(e.src, e.dst) for e in p.edges] == [("c", "d"), ("a", "c")]
    assert g.deferred() == {"d"}
    f = g.without_drafts().fingerprints()
    g.nodes["b"][1]["mode"] = "last"
    h = g.without_drafts().fingerprints()
    assert f["a"] == h["a"] and f["b"] != h["b"] and f["d"] != h["d"]
    assert [q.nodes["a"][1]["path"] for q in over_files(g, ["p", "q", "p"])] == ["p", "q"]
    assert Graph.parse(g.dump()).nodes == g.nodes


def test_command_line(spark, tmp_path, capsys):
    for n, text in (("a", "x,y\n1,2\n"), ("b", "y,z\n3,4\n")):
        (tmp_path / f"{n}.csv").write_text(text)
    doc = project([("a", "input_table", {"path": str(tmp_path / "a.csv")}), ("b", "input_table", {"path": str(tmp_path / "b.csv")}), ("c", "concatenate_tables", {})], [("a", "c", "table_csv", "table"), ("b", "c", "table_csv", "table")])
    path = tmp_path / "p.json"
    path.write_text(json.dumps(doc))
    assert cli.main(["validate", str(path)]) == 0
    assert cli.main(["run", str(path), "--out", str(tmp_path / "out")]) == 0
    got = spark.read.parquet(str(tmp_path / "out/c.table.parquet"))
    assert sorted(map(tuple, got.collect())) == [("", "3", "4"), ("1", "2", "")]
    doc["nodes"][0]["config"] = {}
    path.write_text(json.dumps(doc))
    assert cli.main(["validate", str(path)]) == 2
    doc["nodes"][0]["config"] = {"nothing": 1}
    path.write_text(json.dumps(doc))
    capsys.readouterr()
    assert cli.main(["validate", str(path)]) == 1
    found = json.loads(capsys.readouterr().out)
    assert not found["valid"] and len(found["errors"]) == 1 and len(found["blocks"]) == 1
    path.write_text("{")
    assert cli.main(["validate", str(path)]) == 1 and cli.main(["run"]) == 1
    assert cli.main(["nodes"]) == 0 and "grid_metrics" in capsys.readouterr().out
    doc["nodes"][0]["config"] = {"path": str(tmp_path / "a.csv")}
    path.write_text(json.dumps(doc))
    assert cli.main(["run", str(path), "--out", str(tmp_path / "more"), "--json"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["status"] == "ok" and report["products"][0]["node"] == "c"
    doc["nodes"][0]["config"] = {"path": str(tmp_path / "none.csv")}
    path.write_text(json.dumps(doc))
    assert cli.main(["run", str(path), "--out", str(tmp_path / "none"), "--json"]) == 3
    assert json.loads(capsys.readouterr().out)["status"] == "failed"


def test_loader_bounds_tiles(spark, cloud):
    whole = NODES["load_points"].run(spark, path=cloud, tile_size=50.0, buffer=5.0, max_points_per_tile=40, merge_sparse_below=0)["points"]
    core = whole.where("is_core").groupBy("tile_col", "tile_row").count()
    assert core.agg({"count": "sum"}).first()[0] == 400 and core.agg({"count": "max"}).first()[0] <= 40
    merged = NODES["load_points"].run(spark, path=cloud, tile_size=5.0, buffer=2.0, max_points_per_tile=0, merge_sparse_below=50)["points"]
    plain = NODES["load_points"].run(spark, path=cloud, tile_size=5.0, buffer=2.0, max_points_per_tile=0, merge_sparse_below=0)["points"]
    tiles = [d.select("tile_col", "tile_row").distinct().count() for d in (merged, plain)]
    assert tiles[0] < tiles[1] / 2 and merged.where("is_core").count() == 400


def test_stream_equals_batch(spark, cloud, tmp_path):
    from cairnfield.operators import metrics

    whole = spark.read.parquet(cloud)
    folder = str(tmp_path / "in")
    whole.repartition(4).write.parquet(folder)
    q = queue.accumulate(queue.watch(spark, folder, whole.schema, 1), str(tmp_path / "parts"), str(tmp_path / "ck"), 10.0)
    q.awaitTermination(120)
    got = queue.current(spark, str(tmp_path / "parts"), 10.0).orderBy("gid").toPandas()
    want = metrics.grid_metrics(whole, 10.0).orderBy("gid").toPandas()
    pd.testing.assert_frame_equal(got, want)


def test_bands_and_reports(spark, cloud, tmp_path):
    from cairnfield.functions.lattice import Raster
    from cairnfield.sources import grids

    r = Raster(0.0, 2.0, 1.0, 2, 2)
    cells = spark.createDataFrame([(0, 0, 1.0)], "row long, col long, value double")
    grids.write_geotiff(cells, r, str(tmp_path / "one.tif"))
    g = Graph.parse(project([("a", "input_multispectral", {"path": str(tmp_path / "one.tif")})], []))
    with pytest.raises(ValueError):
        g.compile(spark)
    g = Graph.parse(project([("a", "load_points", {"path": cloud}), ("b", "file_info", {}), ("c", "export_points", {"path": str(tmp_path / "out")}), ("d", "generate_dsm", {"res": 5.0})], [("a", "b", "point_cloud", "point_cloud"), ("a", "c", "point_cloud", "point_cloud"), ("a", "d", "point_cloud", "point_cloud")]))
    out = g.compile(spark)
    assert out["b"]["table"].first()["point_count"] == 400 and spark.read.parquet(str(tmp_path / "out")).count() == 400
    assert out["d"]["raster"][1].count() == 64
