"""Masks and label maps as pixel relations, and operators on their topology.

A mask is (mask_id, x, y) for its foreground. Relational operators run on any number of masks of any
size; those that need a raster (components, morphology) work on one mask as one Arrow group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

PIXEL = ["mask_id", "x", "y"]


def grid(ids: DataFrame, w: int, h: int) -> DataFrame:
    """Every pixel of a frame for each mask id."""
    xs = F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x")
    return ids.select("mask_id", xs).select("mask_id", "x", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"))


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).unionByName(b.select(*PIXEL)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).distinct().join(b.select(*PIXEL), PIXEL, "left_semi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PIXEL).distinct().join(b.select(*PIXEL), PIXEL, "left_anti")


def complement_in_box(mask: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels of each mask's box (mask_id, box) that are not foreground."""
    b = F.col("box")
    rows = boxes.select("mask_id", F.explode(F.sequence(b["x1"], b["x2"] - 1)).alias("x"), b)
    rows = rows.select("mask_id", "x", F.explode(F.sequence(b["y1"], b["y2"] - 1)).alias("y"))
    return rows.join(mask.select(*PIXEL), PIXEL, "left_anti")


def clip_to_box(mask: DataFrame, boxes: DataFrame) -> DataFrame:
    inside = G.contains_point(F.col("box"), F.col("x"), F.col("y"))
    return mask.join(boxes, "mask_id").where(inside).select(*PIXEL)


def tight_box(mask: DataFrame) -> DataFrame:
    """(mask_id, box, area, centre_x, centre_y) of the foreground."""
    made = G.box(F.min("x"), F.min("y"), F.max("x") + 1, F.max("y") + 1)
    out = mask.groupBy("mask_id").agg(made.alias("box"), F.count("*").alias("area"))
    b = F.col("box")
    return out.withColumns({"centre_x": 0.5 * (b["x1"] + b["x2"]), "centre_y": 0.5 * (b["y1"] + b["y2"])})


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ratios of width, height and area and the distance of centres, for two masks of an id."""
    first = tight_box(a).select("mask_id", F.struct("box", "area", "centre_x", "centre_y").alias("a"))
    second = tight_box(b).select("mask_id", F.struct("box", "area", "centre_x", "centre_y").alias("b"))
    p, q = F.col("a"), F.col("b")
    return first.join(second, "mask_id").select(
        "mask_id", (G.width(q["box"]) / G.width(p["box"])).alias("width_ratio"),
        (G.height(q["box"]) / G.height(p["box"])).alias("height_ratio"), (q["area"] / p["area"]).alias("area_ratio"),
        (q["centre_x"] - p["centre_x"]).alias("dx"), (q["centre_y"] - p["centre_y"]).alias("dy"),
    )


def coverage(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(mask_id, coverage): share of the reference's pixels that the candidate holds."""
    hit = candidate.select(*PIXEL, F.lit(1).alias("hit")).distinct()
    return reference.select(*PIXEL).distinct().join(hit, PIXEL, "left").groupBy("mask_id").agg((F.count("hit") / F.count("*")).alias("coverage"))


def touched_labels(labels: DataFrame, mask: DataFrame, background: int | None = 0) -> DataFrame:
    """(mask_id, label): the labels (x, y, label) that a mask meets."""
    rows = labels if background is None else labels.where(F.col("label") > background)
    return mask.select(*PIXEL).distinct().join(rows, ["x", "y"]).select("mask_id", "label").distinct()


def select_labels(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pixels whose label is among ``chosen`` (label)."""
    return labels.join(chosen.select("label").distinct(), "label", "left_semi")


def points_inside(points: DataFrame, mask: DataFrame) -> DataFrame:
    """(mask_id, inside, valid): how many valid points (mask_id, x, y) of each mask's lie on it."""
    hit = mask.select(*PIXEL, F.lit(1).alias("hit")).distinct()
    at = points.where((F.col("x") >= 0) & (F.col("y") >= 0)).select("mask_id", F.rint("x").cast("int").alias("x"), F.rint("y").cast("int").alias("y"))
    return at.join(hit, PIXEL, "left").groupBy("mask_id").agg(F.count("hit").alias("inside"), F.count("*").alias("valid"))


def capsule(segments: DataFrame, w: int, h: int) -> DataFrame:
    """Pixels within ``radius`` of each segment (mask_id, ax, ay, bx, by, radius)."""
    cells = segments.select("*", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"))
    near = G.point_segment_distance(*(F.col(c).cast("double") for c in ("x", "y", "ax", "ay", "bx", "by")))
    return cells.where(near <= F.col("radius")).select(*PIXEL)


def neighbours8(mask: DataFrame) -> DataFrame:
    """(mask_id, x, y, nx, ny): foreground neighbours of each foreground pixel."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps))).alias("s")
    around = mask.select(*PIXEL, step).select(*PIXEL, (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.dy")).alias("ny"))
    other = mask.select("mask_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    return around.join(other, ["mask_id", "nx", "ny"], "left_semi")


def dilate(mask: DataFrame, radius: int, w: int, h: int) -> DataFrame:
    """Foreground grown by a disk, inside the frame."""
    disk = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in disk))).alias("s")
    grown = mask.select("mask_id", "x", "y", step).select("mask_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    return grown.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < w) & (F.col("y") < h)).distinct()


def erode(mask: DataFrame, radius: int, w: int, h: int) -> DataFrame:
    """Foreground whose whole disk is foreground; outside the frame nothing is missing."""
    outside = subtract(grid(mask.select("mask_id").distinct(), w, h), mask)
    return subtract(mask, dilate(outside, radius, w, h))


def opening(mask: DataFrame, radius: int, w: int, h: int) -> DataFrame:
    return dilate(erode(mask, radius, w, h), radius, w, h)


def closing(mask: DataFrame, radius: int, w: int, h: int) -> DataFrame:
    return erode(dilate(mask, radius, w, h), radius, w, h)


def _label_raster(x: np.ndarray, y: np.ndarray, eight: bool) -> np.ndarray:
    """Component of each pixel as the place of its first pixel in row-major order, by union of row runs."""
    order = np.lexsort((x, y))
    xs, ys = x[order], y[order]
    new = np.ones(len(xs), bool)
    new[1:] = (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)
    run = np.cumsum(new) - 1
    first, last = xs[new], xs[np.append(np.flatnonzero(new)[1:] - 1, len(xs) - 1)]
    row = ys[new]
    parent = list(range(len(first)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bounds = {r: (a, b) for r, a, b in zip(*(v.tolist() for v in (np.unique(row), np.searchsorted(row, np.unique(row)), np.searchsorted(row, np.unique(row), "right"))))}
    reach = 1 if eight else 0
    for r, (a, b) in bounds.items():
        if r - 1 not in bounds:
            continue
        i, (j, end) = a, bounds[r - 1]
        while i < b and j < end:
            if first[i] <= last[j] + reach and first[j] <= last[i] + reach:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
            if last[i] < last[j]:
                i += 1
            else:
                j += 1
    lead = np.array([root(i) for i in range(len(first))])
    label = np.empty(len(x), np.int64)
    label[order] = np.flatnonzero(new)[lead[run]]
    firsts = order[label]  # the pixel that names the component
    return firsts


def components(mask: DataFrame, eight: bool = True) -> DataFrame:
    """(mask_id, x, y, label): the label is the component's first pixel in row-major order, ``y * 2**20 + x``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["x", "y"]).reset_index(drop=True)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        at = _label_raster(x, y, eight)
        return pdf.assign(label=y[at].astype("int64") * (1 << 20) + x[at])

    kinds = {f.name: f.dataType.simpleString() for f in mask.schema.fields}
    schema = f"mask_id {kinds['mask_id']}, x {kinds['x']}, y {kinds['y']}, label long"
    return mask.select(*PIXEL).groupBy("mask_id").applyInPandas(run, schema)


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("mask_id", "label").agg(F.count("*").alias("area"))


def remove_small(mask: DataFrame, min_area: int) -> DataFrame:
    """Components of more than ``min_area`` pixels (8-connected)."""
    labelled = components(mask)
    kept = component_sizes(labelled).where(F.col("area") > min_area)
    return labelled.join(kept, ["mask_id", "label"], "left_semi").select(*PIXEL)


def keep_largest(mask: DataFrame, count: int = 1) -> DataFrame:
    """The ``count`` largest components of each mask; of equals the one that begins first."""
    from .rank import top_k

    labelled = components(mask)
    kept = top_k(component_sizes(labelled), ["mask_id"], [F.desc("area"), F.asc("label")], count)
    return labelled.join(kept, ["mask_id", "label"], "left_semi").select(*PIXEL)


def internal_regions(labelled: DataFrame, w: int, h: int) -> DataFrame:
    """Pixels of the regions that do not touch the frame's border."""
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == w - 1) | (F.col("y") == h - 1)
    outer = labelled.where(edge).select("mask_id", "label").distinct()
    return labelled.join(outer, ["mask_id", "label"], "left_anti")


def fill_holes(mask: DataFrame, w: int, h: int, max_area: int | None = None) -> DataFrame:
    """The mask with its enclosed background regions (4-connected) of at most ``max_area`` pixels."""
    background = subtract(grid(mask.select("mask_id").distinct(), w, h), mask)
    holes = internal_regions(components(background, eight=False), w, h)
    if max_area is not None:
        small = component_sizes(holes).where(F.col("area") <= max_area)
        holes = holes.join(small, ["mask_id", "label"], "left_semi")
    return unite(mask, holes)


def cleanup(mask: DataFrame, w: int, h: int, hole_area: int, radius: int, min_area: int) -> DataFrame:
    """Fill holes, open, and drop small components, in this order."""
    out = fill_holes(mask, w, h, hole_area)
    return remove_small(opening(out, radius, w, h) if radius else out, min_area)


def region_mosaic(workspace: DataFrame, barrier: DataFrame, w: int, h: int) -> DataFrame:
    """4-connected regions of the workspace without the barriers, and whether they touch its outer border."""
    labelled = components(subtract(workspace, barrier), eight=False)
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    around = labelled.select("mask_id", "label", "x", "y", steps.alias("s"))
    around = around.select("mask_id", "label", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    outer = around.join(workspace.select(*PIXEL), PIXEL, "left_anti").select("mask_id", "label", F.lit(True).alias("outer")).distinct()
    return labelled.join(outer, ["mask_id", "label"], "left").withColumn("outer", F.coalesce("outer", F.lit(False)))


def pca_angle(mask: DataFrame) -> DataFrame:
    """(mask_id, angle): direction of the main axis in degrees, from the sample covariance."""
    m = mask.groupBy("mask_id").agg(
        F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy"), F.count("*").alias("n")
    )
    angle = F.degrees(0.5 * F.atan2(2.0 * F.col("xy"), F.col("xx") - F.col("yy")))
    return m.where(F.col("n") > 1).select("mask_id", angle.alias("angle"))


def centreline_angle(mask: DataFrame, least_width: float = 0.5, trim: float = 0.1) -> DataFrame:
    """(mask_id, angle): lean of the middle of the mask's rows, without its narrow and its outer rows."""
    from pyspark.sql import Window

    rows = mask.groupBy("mask_id", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = rows.withColumns({"mid": 0.5 * (F.col("lo") + F.col("hi")), "width": F.col("hi") - F.col("lo") + 1})
    whole = rows.groupBy("mask_id").agg(F.max("width").alias("widest"))
    rows = rows.join(whole, "mask_id").where(F.col("width") >= least_width * F.col("widest"))
    order = Window.partitionBy("mask_id").orderBy("y")
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("mask_id"))})
    cut = F.rint(F.col("n") * trim)
    rows = rows.where((F.col("i") >= cut) & (F.col("i") < F.col("n") - cut))
    return rows.groupBy("mask_id").agg(F.degrees(F.atan(F.regr_slope("mid", F.col("y").cast("double")))).alias("angle"))


def flip(df: DataFrame, w: Column | int, h: Column | int, horizontal: bool = False, vertical: bool = False) -> DataFrame:
    """Pixels (x, y, ...) mirrored."""
    x = w - 1 - F.col("x") if horizontal else F.col("x")
    y = h - 1 - F.col("y") if vertical else F.col("y")
    return df.withColumns({"x": x, "y": y})


def quarter_turn(df: DataFrame, h: Column | int) -> DataFrame:
    """Pixels turned clockwise by 90 degrees; the frame's sides change places."""
    return df.withColumns({"x": h - 1 - F.col("y"), "y": F.col("x")})


def largest_rectangle(mask: DataFrame) -> DataFrame:
    """(mask_id, x1, y1, x2, y2): the largest axis-aligned rectangle of foreground; the first found of equals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["x"].min()), int(pdf["y"].min())
        full = np.zeros((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1), bool)
        full[pdf["y"] - y0, pdf["x"] - x0] = True
        heights = np.zeros(full.shape[1] + 1, int)
        best = (0, 0, 0, 0, 0)
        for y, row in enumerate(full):
            heights[:-1] = np.where(row, heights[:-1] + 1, 0)
            open_: list[tuple[int, int]] = []  # (start, height), rising
            for x, high in enumerate(heights.tolist()):
                start = x
                while open_ and open_[-1][1] >= high:
                    start, tall = open_.pop()
                    if tall * (x - start) > best[0]:
                        best = (tall * (x - start), start, y - tall + 1, x, y + 1)
                open_.append((start, high))
        _, a, b, c, d = best
        return pd.DataFrame({"mask_id": [pdf["mask_id"].iloc[0]], "x1": [a + x0], "y1": [b + y0], "x2": [c + x0], "y2": [d + y0]})

    kind = mask.schema["mask_id"].dataType.simpleString()
    return mask.select(*PIXEL).groupBy("mask_id").applyInPandas(run, f"mask_id {kind}, x1 int, y1 int, x2 int, y2 int")


def nearest_depth(fragments: DataFrame) -> DataFrame:
    """(image_id, x, y, triangle, depth): per pixel the fragment with the least positive depth, the first triangle of equals."""
    from .rank import top_by

    return top_by(fragments.where(F.col("depth") > 0), ["image_id", "x", "y"], [F.col("depth"), F.col("triangle")])


def rasterise(triangles: DataFrame) -> DataFrame:
    """Fragments (image_id, triangle, x, y, depth) of triangles with corners (x0, y0, z0) .. (x2, y2, z2).

    A pixel is inside where no barycentric weight is below -1e-6; depth is perspective-correct.
    """
    x0, y0, x1, y1, x2, y2 = (F.col(c) for c in ("x0", "y0", "x1", "y1", "x2", "y2"))
    det = (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)
    span = lambda f, a, b, c: f(f"{a}", f"{b}", f"{c}")
    xs = F.sequence(F.floor(span(F.least, "x0", "x1", "x2")).cast("int"), F.ceil(span(F.greatest, "x0", "x1", "x2")).cast("int"))
    ys = F.sequence(F.floor(span(F.least, "y0", "y1", "y2")).cast("int"), F.ceil(span(F.greatest, "y0", "y1", "y2")).cast("int"))
    cells = triangles.where(F.abs(det) > 1e-12).withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))
    px, py = F.col("x"), F.col("y")
    a = ((y1 - y2) * (px - x2) + (x2 - x1) * (py - y2)) / det
    b = ((y2 - y0) * (px - x2) + (x0 - x2) * (py - y2)) / det
    cells = cells.withColumns({"a": a, "b": b, "c": 1.0 - a - b}).where("a >= -1e-6 and b >= -1e-6 and c >= -1e-6")
    depth = F.try_divide(F.lit(1.0), F.col("a") / F.col("z0") + F.col("b") / F.col("z1") + F.col("c") / F.col("z2"))
    return cells.select("image_id", "triangle", "x", "y", depth.alias("depth"))
