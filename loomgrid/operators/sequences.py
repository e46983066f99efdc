"""Operators on ordered sequences: runs, padded medians, even samples, moving averages, tiles and bands."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def split_runs(df: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """``df`` with ``run``: rows of a sequence up to the next one for which ``breaks`` holds.

    ``breaks`` may use ``F.lag`` over the window that ``window_of(keys, order)`` gives.
    """
    w = window_of(keys, order)
    flagged = df.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("int"))
    return flagged.withColumn("run", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def window_of(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def chromatic_runs(samples: DataFrame, keys: list[str], threshold: float = 14.0, least: int = 3) -> DataFrame:
    """Runs of similar colour along samples (keys, i, x, y, l, a, b) with their ends, centre, length and mean colour."""
    w = window_of(keys, ["i"])
    jump = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in ("a", "b")), F.pow(F.col("l") - F.lag("l").over(w), 2)))
    runs = split_runs(samples, keys, ["i"], jump > threshold).groupBy(*keys, "run").agg(
        F.count("*").alias("length"), F.min("i").alias("first"), F.max("i").alias("last"),
        F.min_by(F.struct("x", "y"), "i").alias("start"), F.max_by(F.struct("x", "y"), "i").alias("end"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("l", "a", "b")),
    )
    s, e = F.col("start"), F.col("end")
    centre = F.struct(((s["x"] + e["x"]) / 2.0).alias("x"), ((s["y"] + e["y"]) / 2.0).alias("y"))
    return runs.where(F.col("length") >= least).withColumn("centre", centre)


def median_window(n: Column, divisor: int = 5) -> Column:
    """Odd window for ``n`` rows: about ``n / divisor``, at least 3 and at most ``n``."""
    wish = F.greatest(F.rint(n / divisor).cast("int"), F.lit(3))
    odd = F.when(wish % 2 == 0, wish + 1).otherwise(wish)
    return F.when(odd <= n, odd).otherwise(F.when(n % 2 == 1, n).otherwise(F.greatest(n - 1, F.lit(1))))


def median_smooth(df: DataFrame, keys: list[str], order: str, value: str, window: int) -> DataFrame:
    """``smooth``: centred median over an odd window; the ends are repeated beyond the sequence.

    The frame is collected per row and padded from the sequence's first and last value, so no rows
    are added and only one window is needed.
    """
    half = window // 2
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = F.collect_list(value).over(w.rowsBetween(-half, half))
    i, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(*keys))
    before, after = F.greatest(half - i, F.lit(0)), F.greatest(i + half - (n - 1), F.lit(0))
    padded = F.concat(
        F.array_repeat(F.first(value).over(whole), before.cast("int")), frame, F.array_repeat(F.last(value).over(whole), after.cast("int"))
    )
    return df.withColumn("smooth", F.get(F.array_sort(padded), F.lit(half)))


def sample_evenly(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """``count`` rows of each sequence at even places, first and last among them; all rows where there are no more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / max(count - 1, 1)))
    return rows.where((F.col("_n") <= count) | F.array_contains(places, F.col("_i").cast("long"))).drop("_i", "_n")


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """``ema``: alpha times the past plus (1 - alpha) times the row, from the sequence's first row on.

    Each sequence is streamed in order through Arrow batches; its state is one number.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", ema double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, last = [], None
        for v in pdf[value].tolist():
            last = float(v) if last is None else alpha * last + (1.0 - alpha) * float(v)
            out.append(last)
        return pdf.assign(ema=out)

    return df.groupBy(*keys).applyInPandas(run, schema)


def robust_line(
    df: DataFrame, keys: list[str], x: str, y: str, samples: int = 64, trim: float = 0.1, max_slope: float = 10.0, least: int = 3
) -> DataFrame:
    """(keys, slope, intercept): even samples, median-smoothed, a cubic fit, and the median of its plausible slopes.

    Where fewer than ``least`` slopes of the middle part are within ``max_slope``, the ``least`` flattest
    count. The line goes through the medians of the x and (smoothed) y that go with the slopes kept.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x, kind="stable")
        at = np.unique(np.floor(np.linspace(0, len(pdf) - 1, min(samples, len(pdf)))).astype(int))
        t, v = pdf[x].to_numpy(float)[at], pdf[y].to_numpy(float)[at]
        half = max(3, round(len(v) / 5)) // 2
        padded = np.pad(v, half, mode="edge")
        v = np.array([np.median(padded[i : i + 2 * half + 1]) for i in range(len(v))])
        if len(t) < 2 or t[0] == t[-1]:
            return pd.DataFrame([(*key, 0.0, float(v.mean()))])
        centre, scale = t.mean(), max(t.std(), 1e-9)
        fit = np.polynomial.Polynomial.fit((t - centre) / scale, v, min(3, len(t) - 1))
        cut = round(len(t) * trim)
        inner = slice(cut, len(t) - cut) if len(t) > 2 * cut else slice(None)
        slopes = fit.deriv()((t[inner] - centre) / scale) / scale
        kept = np.flatnonzero(np.abs(slopes) <= max_slope)
        if len(kept) < least:
            kept = np.argsort(np.abs(slopes), kind="stable")[:least]
        slope = float(np.median(slopes[kept]))
        return pd.DataFrame([(*key, slope, float(np.median(v[inner][kept]) - slope * np.median(t[inner][kept])))])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, slope double, intercept double")


def tile_starts(length: Column, tile: int, overlap: float) -> Column:
    """Array of starts of overlapping tiles, the last one flush with the end."""
    size = F.least(length, F.lit(tile))
    step = F.greatest(F.rint(size * (1.0 - overlap)).cast("int"), F.lit(1))
    last = length - size
    return F.when(last == 0, F.array(F.lit(0))).otherwise(F.array_union(F.sequence(F.lit(0), last, step), F.array(last)))


def tile_weight(i: Column, n: Column) -> Column:
    """sin² weight of place ``i`` of ``n``; 1 for a single place."""
    return F.when(n == 1, 1.0).otherwise(F.pow(F.sin(F.lit(math.pi) * (i + 0.5) / n), 2))


def tile_weight_2d(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.greatest(tile_weight(x, w) * tile_weight(y, h), F.lit(1e-4))


def tile_blend(scores: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alpha): Σ score·weight / Σ weight over the tiles that cover a pixel, 1 where none does."""
    sums = scores.groupBy(*keys).agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    return pixels.join(sums, keys, "left").select(*keys, F.coalesce(F.try_divide("s", "w"), F.lit(1.0)).alias("alpha"))


def _spread(span: Column, i: Column, n: Column) -> Column:
    return F.rint(span * i / F.greatest(n, F.lit(1))).cast("int")


def sliding_windows(frames: DataFrame, cols: int, rows: int, fx: float = 0.5, fy: float = 0.5) -> DataFrame:
    """``frames`` (w, h, ...) with (ord, box) of a grid of windows in row-major order."""
    w, h = F.col("w"), F.col("h")
    ww = F.greatest(F.rint(w * fx).cast("int"), F.lit(1))
    wh = F.greatest(F.rint(h * fy).cast("int"), F.lit(1))
    cells = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(cols * rows - 1))).alias("ord"))
    x = _spread(w - ww, F.col("ord") % cols, F.lit(cols - 1))
    y = _spread(h - wh, F.floor(F.col("ord") / cols), F.lit(rows - 1))
    return cells.withColumn("box", G.box(x, y, x + ww, y + wh))


def bands(frames: DataFrame) -> DataFrame:
    """Boxes of bands for rows (w, h, axis, start, end, segments, overlap, order), with their place ``ord``."""
    along = F.when(F.col("axis") == "y", F.col("h")).otherwise(F.col("w"))
    px = lambda c: G.between(G.size_expr(F.col(c), along, 0, unitless=True), F.lit(0.0), along).cast("int")
    rows = frames.withColumns({"_a": px("start"), "_b": F.coalesce(px("end"), along), "_o": px("overlap"), "_n": F.col("segments")})
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    span = F.col("_b") - F.col("_a")
    lo = F.greatest(F.col("_a"), F.col("_a") + F.rint(span * F.col("_i") / F.col("_n")).cast("int") - F.col("_o"))
    hi = F.least(F.col("_b"), F.col("_a") + F.rint(span * (F.col("_i") + 1) / F.col("_n")).cast("int") + F.col("_o"))
    made = F.when(F.col("axis") == "y", G.box(0, lo, F.col("w"), hi)).otherwise(G.box(lo, 0, hi, F.col("h")))
    place = F.when(F.col("order") == "reverse", F.col("_n") - 1 - F.col("_i")).otherwise(F.col("_i"))
    rows = rows.withColumns({"ord": place, "box": made}).where((span > 0) & (hi > lo))
    return rows.drop("_a", "_b", "_o", "_n", "_i")


def frame_time(index: Column, fps: Column) -> Column:
    """Milliseconds of a frame: by its rate, or 33 a frame without one."""
    return F.when(fps > 0, F.rint(index * 1000 / fps)).otherwise(index * 33).cast("long")


def fold_layers(layers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, alpha): layers (keys, idx, value, alpha) composed one over the other in rising idx."""
    ordered = layers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "value", "alpha"))).alias("l"))

    def over(below, top):
        alpha = top["alpha"] + below["alpha"] * (1.0 - top["alpha"])
        value = F.try_divide(top["value"] * top["alpha"] + below["value"] * below["alpha"] * (1.0 - top["alpha"]), alpha)
        return F.struct(F.coalesce(value, F.lit(0.0)).alias("value"), alpha.alias("alpha"))

    start = F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("alpha"))
    return ordered.select(*keys, F.aggregate("l", start, over).alias("o")).select(*keys, "o.value", "o.alpha")
