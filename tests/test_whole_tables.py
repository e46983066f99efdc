"""Registered queries cover their whole tables, not only the first keys."""

import random

import pytest

from loomgrid import queries

LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"


def lineitem(spark, folder, rows):
    spark.createDataFrame(rows, LINEITEM).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["mask_cleanup", "largest_components", "largest_rectangle"])
def test_masks_of_all_order_keys(spark, tmp_path, name):
    rng = random.Random(12)
    rows = [(rng.randrange(4000), rng.randrange(200), rng.randrange(10), rng.randint(1, 3), float(rng.randint(1, 5)), 0.0, 0.0) for _ in range(600)]
    # 96,000 is 24 runs of 4000 order keys and a multiple of the frame's 24 rows: the same masks again.
    later = [(k + 96_000, *rest) for k, *rest in rows]
    got = {r[0]: tuple(r)[1:] for r in queries.queries()[name](spark, lineitem(spark, tmp_path, rows + later)).collect()}
    first = {k: v for k, v in got.items() if k < 10}
    assert first and {k - 240: v for k, v in got.items() if k >= 10} == first


def test_depth_raster_of_all_parts(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 201)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.triangle for r in queries.depth_raster(spark, str(tmp_path)).collect()}
    assert got == {1, 201}


def test_depth_fusion_of_all_order_keys(spark, tmp_path):
    # The turns are -8, 4 and 16: the most frontal source is line 2, which only a late order has for index 5.
    rows = [(10, 5, 1, 1, 3.0, 0.1, 0.01), (10, 5, 1, 3, 4.0, 0.1, 0.01), (10, 6, 1, 2, 8.0, 0.2, 0.02), (900, 5, 1, 2, 7.0, 0.3, 0.05)]
    got = {r.idx: (r.x, r.y) for r in queries.depth_fusion(spark, lineitem(spark, tmp_path, rows)).collect()}
    assert got == {5: (7.0, 0.3), 6: (8.0, 0.2)}
