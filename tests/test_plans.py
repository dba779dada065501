"""Plans stay what they should be: no all-pairs join, Python only where it is needed, few columns read."""

import re

import pytest

from cairnfield import contract

SF = "/root/testdata/sf0.001"
PYTHON = {"sor", "ror", "clip_polygon", "clip_polygon_buffer", *(q for q in contract.QUERIES if q.startswith("ground_"))}
#: Made from plans on the driver, one row a tile.
LOCAL = {"batches"}
#: Written to files and read by data sources in Python.
FILES = {"las_round_trip", "las_folder_ids", "las_union_area", "geotiff_round_trip", "ascii_grid_round_trip", "gpkg_round_trip", "preflight"}


def plan(spark, name):
    return contract.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(contract.QUERIES) - LOCAL))
def test_operators(spark, name):
    text = plan(spark, name)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert name in FILES or bool(re.search("Python|Pandas|Arrow(?!ToRow)", text)) == (name in PYTHON)


def test_pruning(spark):
    text = plan(spark, "dtm_min")
    read = re.search(r"FileScan parquet \[([^\]]*)\]", text)[1]
    assert set(re.findall(r"(\w+)#", read)) <= {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_tax"}
    assert text.count("Exchange") == 1


def test_one_shuffle_for_metrics(spark):
    assert plan(spark, "grid_metrics").count("Exchange") == 1


def test_filters_take_no_shuffle(spark):
    from cairnfield.operators import points

    p = contract.line_points(spark, SF)
    for df in (points.elevation_range(p, 0, 9), points.by_return(p), points.by_class(p), points.by_flags(p)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
