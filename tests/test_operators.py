"""Operators on hand-made relations."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import geometry as G
from loomgrid.operators import anatomy, clusters, landmarks, masks, merges, models, rank
from loomgrid.operators import boxes as B
from loomgrid.operators import sequences as Q
from loomgrid.sources import artifacts
from loomgrid.streaming import state


def test_rankings(spark):
    rows = [("s", 0, 0, "a", 0.5, 1.0), ("s", 0, 1, "b", 0.9, 1.0), ("t", 1, 0, "a", 0.9, 3.0), ("t", 1, 1, "b", 0.5, 3.0), ("t", 1, 2, "c", 0.8, 1.0)]
    table = spark.createDataFrame(rows, "scorer_id string, scorer_ord int, ord int, image string, score double, score_weight double")
    means = {r.image: r.score for r in rank.weighted_mean(table).collect()}
    assert means == pytest.approx({"a": 0.8, "b": 0.6, "c": 0.8})
    assert rank.best(table.where("image <> 'a' or scorer_id = 't'")).first().image == "a"
    assert rank.best(table.withColumn("score", F.lit(0.0))).isEmpty()


def test_latest_artifact(spark):
    rows = [("n", "2025-01-01_010101.json"), ("n", "2025-01-01_010102_b.json"), ("n", "2025-01-01_010102_a.json"), ("m", "z.json"), ("m", "b.json")]
    got = {r.node_id: r.name for r in artifacts.latest(spark.createDataFrame(rows, "node_id string, name string")).collect()}
    assert got == {"n": "2025-01-01_010102_a.json", "m": "b.json"}


def detections(spark, rows):
    data = [("i", k, (*r[:4],), r[4], "person") for k, r in enumerate(rows)]
    return spark.createDataFrame(data, "image_id string, ord int, box struct<x1:int,y1:int,x2:int,y2:int>, score double, label string")


def test_select_and_suppress(spark):
    d = detections(spark, [(0, 0, 2, 2, 0.9), (3, 3, 9, 9, 0.5), (4, 4, 6, 6, 0.4)])
    assert [B.select(d, how, F.lit(10), F.lit(10)).first().ord for how in ("best", "largest", "center")] == [0, 1, 2]
    d = detections(spark, [(0, 0, 10, 10, 0.9), (0, 0, 10, 10, 0.8), (20, 0, 30, 10, 0.7)])
    assert sorted(r.ord for r in B.suppress(d).collect()) == [0, 2]


def test_suppress_multiplies_at_the_threshold(spark):
    # Boxes of 81 and 72 share 63 of 90: as doubles 63 / 90 is 0.7, but 0.7 * 90 is less than 63. For 7 of 10 it is 7.
    d = detections(spark, [(0, 0, 9, 9, 0.9), (2, 0, 10, 9, 0.8)])
    assert [r.ord for r in B.suppress(d).collect()] == [0]
    d = detections(spark, [(0, 0, 10, 1, 0.9), (0, 0, 7, 1, 0.8), (20, 0, 20, 5, 0.7), (20, 0, 20, 5, 0.6)])
    assert sorted(r.ord for r in B.suppress(d).collect()) == [0, 1, 2, 3]


def test_side_choice(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 4.0), ("b", 0, 4.0)], "image_id string, ord int, x double")
    got = {r.image_id: (r.ord, r.ok) for r in B.side_choice(rows, F.lit("left"), F.lit(6)).collect()}
    assert got == {"a": (0, True), "b": (0, False)}


def pixels(spark, text, mask_id=1):
    cells = [(mask_id, x, y) for y, line in enumerate(text) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(cells, "mask_id int, x int, y int")


def picture(df, w, h):
    on = {(r.x, r.y) for r in df.collect()}
    return ["".join("#" if (x, y) in on else "." for x in range(w)) for y in range(h)]


def test_components_holes_and_sizes(spark):
    m = pixels(spark, ["###...#", "#.#....", "###.#..", "...#..#"])
    sizes = sorted(r.area for r in masks.component_sizes(masks.components(m)).collect())
    assert sizes == [1, 1, 10]
    assert picture(masks.keep_largest(masks.fill_holes(m, 7, 4)), 7, 4) == ["###....", "###....", "###.#..", "...#..."]
    assert picture(masks.remove_small(m, 1), 7, 4)[0] == "###...."
    assert {r.area for r in masks.component_sizes(masks.components(m, eight=False)).collect()} == {1, 8}


def test_morphology_and_geometry(spark):
    m = pixels(spark, [".....", "..#..", "....."])
    assert picture(masks.dilate(m, 1, 5, 3), 5, 3) == ["..#..", ".###.", "..#.."]
    assert picture(masks.erode(masks.dilate(m, 1, 5, 3), 1, 5, 3), 5, 3) == picture(m, 5, 3)
    box = masks.tight_box(pixels(spark, ["........", "..###...", "..###...", "........"])).first()
    assert box.centre_x == 3.5 and tuple(box.box) == (2, 1, 5, 3)
    r = masks.largest_rectangle(pixels(spark, ["#.##", "####", "####"])).first()
    assert (r.x1, r.y1, r.x2, r.y2) == (0, 1, 4, 3)
    assert masks.pca_angle(pixels(spark, ["#...", ".#..", "..#.", "...#"])).first().angle == pytest.approx(45)


def test_chromatic_runs(spark):
    colours = [(50.0, 70.0, 50.0)] * 3 + [(80.0, -80.0, 80.0)] * 4 + [(30.0, 70.0, -100.0)] * 2
    rows = [("k", i, i, 0, *c) for i, c in enumerate(colours)]
    got = Q.chromatic_runs(spark.createDataFrame(rows, "k string, i int, x int, y int, l double, a double, b double"), ["k"], 20.0, 4).collect()
    assert len(got) == 1 and got[0].length == 4 and (got[0].first, got[0].last) == (3, 6) and got[0].centre.x == 4.5


def test_median_and_samples(spark):
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([9, 1, 1, 5, 9])], "k string, i int, v double")
    assert [r.smooth for r in Q.median_smooth(rows, ["k"], "i", "v", 3).orderBy("i").collect()] == [9.0, 1.0, 1.0, 5.0, 9.0]
    assert [r.i for r in Q.sample_evenly(rows, ["k"], ["i"], 3).orderBy("i").collect()] == [0, 2, 4]
    assert [round(r.ema, 3) for r in Q.moving_average(rows, ["k"], ["i"], "v", 0.5).orderBy("i").collect()] == [9, 5, 3, 4, 6.5]


def test_kmeans_is_the_same_for_tables_and_tiles(spark):
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 1), (1, 0), (9, 9), (9, 8), (20, 0)])]
    df = spark.createDataFrame(points, "i int, x double, y double")
    whole = [tuple(r) for r in clusters.kmeans(df, ["x", "y"], "i", 3, 2).collect()]
    tile = [tuple(r)[1:] for r in clusters.tile_kmeans(df.withColumn("t", F.lit(1)), ["t"], ["x", "y"], "i", 3, 2).collect()]
    assert whole == tile and [w[1] for w in whole] == [3, 2]


def test_image_and_prompt_merges(spark):
    rows = [("m", "image:2", "c.png", None, None), ("m", "image:0", "a.png", None, None), ("m", "image:1", None, ["b0.png", "b1.png"], None)]
    schema = "id string, input_id string, image string, images array<string>, path string"
    got = merges.merge_images(spark.createDataFrame(rows, schema), ["id"]).orderBy("ord").collect()
    assert [r.path for r in got] == ["a.png", "b0.png", "b1.png", "c.png"]
    with pytest.raises(Exception, match="contiguous"):
        merges.merge_images(spark.createDataFrame(rows[:1], schema), ["id"]).collect()
    rows = [("m", 0, "subject", "subject style", "bad anatomy", "flat lighting"), ("m", 1, "wardrobe", "wardrobe style", "low quality", "washed out, low quality"), ("m", 2, "pose", None, None, None)]
    made = merges.merge_prompts(spark.createDataFrame(rows, "id string, ord int, prompt string, prompt_2 string, negative_prompt string, negative_prompt_2 string"), ["id"], "ord").first()
    assert made.prompt == "subject\nwardrobe\npose" and made.prompt_2 == "subject style\nwardrobe style\npose"
    assert made.negative_prompt == "bad anatomy, low quality" and made.negative_prompt_2 == "flat lighting, washed out, low quality"


def test_depth_fusion(spark):
    rows = [(0, 60.0, 1, 1.0, 1.0, 10.0), (1, 5.0, 1, 2.0, 2.0, 20.0)]
    r = landmarks.fuse_depth(spark.createDataFrame(rows, "source_id int, yaw double, idx int, x double, y double, z double")).first()
    assert (r.x, r.y) == (2.0, 2.0) and r.z == pytest.approx((10 * 1.0 + 20 * 0.1) / 1.1)


def test_model_contract(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i long")
    out = models.apply_model(df, lambda: lambda b: pd.DataFrame({"double": b["i"] * 2}), "double long", key=("t",), batch=3)
    assert sorted(r.double for r in out.collect()) == list(range(0, 20, 2))


def test_tracker_batch_equals_stream(spark, tmp_path):
    rows = [("c", f, o, x, x / 2) for f, xs in enumerate([[0.1, 0.8], [0.12, 0.79], [0.5], [0.14, 0.78]]) for o, x in enumerate(xs)]
    schema = "clip string, frame long, ord int, x double, y double"
    cfg = state.TrackerConfig(hold=1)
    batch = sorted(map(tuple, state.track(spark.createDataFrame(rows, schema), cfg).collect()))
    source = f"{tmp_path}/in"
    for f in range(4):
        spark.createDataFrame([r for r in rows if r[1] == f], schema).coalesce(1).write.mode("append").parquet(source)
    stream = state.track_stream(spark.readStream.schema(schema).parquet(source), cfg)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).outputMode("append").start(f"{tmp_path}/out")
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == batch
    assert {r[2] for r in batch} == {0, 1, 2}


def test_boxes_from_points(spark):
    points = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(2, 2), (5, 7), (-1, -1), (3, 3), (4, 4), (2, 5)])], "image_id int, idx int, x double, y double")
    r = B.hand_box(points, ["image_id"], F.lit(20), F.lit(20)).first()
    assert tuple(r.box) == (2, 2, 6, 8)
    assert G.CORNERS == ("x1", "y1", "x2", "y2")


def test_robust_line_goes_through_the_medians_of_what_it_kept(spark):
    rows = [("a", float(x), 2.0 * x + 1) for x in range(40)] + [("b", float(x), 50.0 * x) for x in range(10)] + [("c", 1.0, 4.0)]
    got = {r.k: (r.slope, r.intercept) for r in Q.robust_line(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["a"] == pytest.approx((2.0, 1.0), abs=0.2) and got["c"] == (0.0, 4.0)
    # No slope is within the limit: the three flattest count, and the line still meets their middle.
    assert got["b"][0] > 10.0


def test_mask_choice_falls_back_where_a_filter_leaves_nothing(spark):
    rows = [
        ("t", 1, 0.92, 100.0, 4, 4, 1, False, "a"), ("t", 2, 0.90, 40.0, 4, 4, 0, True, "a"), ("t", 3, 0.91, 60.0, 1, 4, 0, False, "b"),
        ("u", 1, 0.50, 10.0, 0, 4, 2, False, "a"), ("u", 2, 0.50, 20.0, 0, 4, 1, False, "a"), ("u", 3, 0.94, 90.0, 0, 4, 3, True, "b"),
    ]
    df = spark.createDataFrame(rows, "target string, ord int, score double, area double, inside int, valid int, violations int, inverted boolean, source string")
    got = {r.target: r.ord for r in anatomy.choose_mask(df, ["target"]).collect()}
    assert got == {"t": 2, "u": 3}  # t: 3 misses points, 1 holds a forbidden one; u: nothing passes, so the score decides
