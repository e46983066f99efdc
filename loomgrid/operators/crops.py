"""Box crops and layer placements: the geometry that a later compositing step needs, not the pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def wanted_box(w: Column, h: Column, values: list[Column], form: str, given: Column | None = None, proxy: Column | None = None) -> Column:
    """Box before it is clamped: ``given`` where it is not null, else the size expressions of ``form``.

    With ``proxy``, the size (w, h) of the picture that ``given`` was measured on, that box is scaled to this image and
    rounded outward; a proxy without a positive size gives null.
    """
    own = G.convert_bbox(values, form, w, h)
    if given is None:
        return own
    if proxy is not None:
        scaled = [
            f(given[c] * side / F.nullif(size, F.lit(0))).cast("int")
            for f, c, side, size in zip((F.floor, F.floor, F.ceil, F.ceil), G.CORNERS, (w, h, w, h), (proxy["w"], proxy["h"]) * 2)
        ]
        return F.when(given.isNotNull(), F.when((proxy["w"] > 0) & (proxy["h"] > 0), G.box(*scaled))).otherwise(own)
    return F.when(given.isNotNull(), given).otherwise(own)


def crop_of(wanted: Column, w: Column, h: Column) -> Column:
    """(box, anchor_x, anchor_y, x, y, w, h): the clamped box, its local anchor, the anchor's place in the image and the crop's size.

    Null where nothing of the box lies in the image.
    """
    b = G.clamp_bbox(wanted, w, h)
    x, y = (F.floor((b[f"{c}1"] + b[f"{c}2"]) / 2).cast("int") for c in "xy")
    made = F.struct(
        b.alias("box"), (x - b["x1"]).alias("anchor_x"), (y - b["y1"]).alias("anchor_y"), x.alias("x"), y.alias("y"),
        G.width(b).alias("w"), G.height(b).alias("h"),
    )
    return F.when(b.isNotNull(), made)


def box_pixels(frames: DataFrame, keys: list[str], box: str = "box", outside: bool = False) -> DataFrame:
    """(keys, x, y): set pixels of a frame's rectangle, or (``outside``) those of the frame (w, h) around it.

    Rows of pixels are exploded before their pixels, so that no array is longer than a side.
    """
    b = F.col(box)
    inside_row = (F.col("y") >= b["y1"]) & (F.col("y") < b["y2"])
    span = lambda lo, hi: F.when(hi > lo, F.sequence(lo.cast("int"), (hi - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    if outside:
        rows = frames.select(*keys, b.alias(box), F.col("w"), F.explode(span(F.lit(0), F.col("h"))).alias("y"))
        around = F.concat(span(F.lit(0), b["x1"]), span(b["x2"], F.col("w")))
        return rows.select(*keys, F.explode(F.when(inside_row, around).otherwise(span(F.lit(0), F.col("w")))).alias("x"), "y")
    rows = frames.select(*keys, b.alias(box), F.explode(span(b["y1"], b["y2"])).alias("y"))
    return rows.select(*keys, F.explode(span(b["x1"], b["x2"])).alias("x"), "y")


def anchor_xy(anchor: Column, w: Column, h: Column) -> Column:
    """Local point of ``center`` or ``top|center|bottom-left|center|right``; the far edges are outside the last pixel. Null for others."""
    words = F.split(F.when(anchor == "center", "center-center").otherwise(anchor), "-")
    at = lambda i, near, far, size: F.when(F.get(words, F.lit(i)) == near, 0.0).when(F.get(words, F.lit(i)) == far, size.cast("double")).when(
        F.get(words, F.lit(i)) == "center", size / 2.0
    )
    x, y = at(1, "left", "right", w), at(0, "top", "bottom", h)
    return F.when((F.size(words) == 2) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def alpha_anchors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors of visible pixels (keys, x, y, alpha): middle of their tight box, of its top and bottom edge, and the weighted centroid.

    Images without a visible pixel have no row.
    """
    a = F.col("alpha").cast("double")
    weighted = lambda c: F.sum((F.col(c) + 0.5) * a) / F.sum(a)
    made = pixels.where("alpha > 0").groupBy(*keys).agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), weighted("x").alias("cx"), weighted("y").alias("cy")
    )
    middle = (F.col("x1") + F.col("x2")) / 2.0
    point = lambda x, y, name: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")).alias(name)
    return made.select(
        *keys, point(middle, (F.col("y1") + F.col("y2")) / 2.0, "box_center"), point(middle, F.col("y1"), "top_center"),
        point(middle, F.col("y2"), "bottom_center"), point(F.col("cx"), F.col("cy"), "center"),
    )
