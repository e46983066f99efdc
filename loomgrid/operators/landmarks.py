"""Landmark relations: plausibility scores, depth fusion and similarity transforms.

Landmarks are long: (subject, idx, x, y, z, valid).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from .rank import top_by


def pivot(points: DataFrame, idx: list[int]) -> DataFrame:
    """(subject, p<idx> ...): one struct (x, y, z, valid) for each wanted landmark, by conditional aggregation."""
    idx = sorted(set(idx))
    value = F.struct("x", "y", "z", "valid")
    return points.where(F.col("idx").isin(idx)).groupBy("subject").agg(
        *(F.first(F.when(F.col("idx") == i, value), ignorenulls=True).alias(f"p{i}") for i in idx)
    )


def symmetry_score(points: DataFrame, left: tuple[int, int], right: tuple[int, int]) -> DataFrame:
    """(subject, ratio, score): how like the left and the right segment are in length; 0.5 if not seen."""
    wide = pivot(points, [*left, *right])

    def length(a, b):
        p, q = F.col(f"p{a}"), F.col(f"p{b}")
        return S.segment_length(p, q, F.coalesce(p["valid"] & q["valid"], F.lit(False)))

    ratio = S.safe_ratio(length(*left), length(*right))
    return wide.select("subject", ratio.alias("ratio"), S.ratio_plausibility(ratio).alias("score"))


def angle_score(points: DataFrame, joints: list[tuple[int, int, int]]) -> DataFrame:
    """(subject, score): mean plausibility of the angles at the middle landmarks."""
    wide = pivot(points, sorted({i for j in joints for i in j}))
    parts = []
    for a, b, c in joints:
        p = [F.col(f"p{i}") for i in (a, b, c)]
        seen = F.coalesce(p[0]["valid"] & p[1]["valid"] & p[2]["valid"], F.lit(False))
        parts.append(S.angle_plausibility(S.joint_angle(*p, seen)))
    return wide.select("subject", (sum(parts[1:], parts[0]) / len(parts)).alias("score"))


def coverage_score(points: DataFrame) -> DataFrame:
    """(subject, score): share of landmarks that are valid."""
    return points.groupBy("subject").agg((F.count_if(F.col("valid")) / F.count("*")).alias("score"))


def weighted_parts(scores: DataFrame) -> DataFrame:
    """(subject, score): weighted mean of the observable parts (subject, part, score, observable, weight)."""
    w = F.when(F.col("observable"), F.col("weight")).otherwise(0.0)
    total, weight = F.sum(w * F.coalesce("score", F.lit(0.0))), F.sum(w)
    return scores.groupBy("subject").agg(F.when(weight > S.EPS, F.try_divide(total, weight)).otherwise(0.0).alias("score"))


def mean_pair_distance(points: DataFrame) -> DataFrame:
    """(subject, distance): mean distance of the valid landmarks' pairs; a subject has a fixed few landmarks."""
    good = points.where("valid")
    p, q = good.select("subject", "idx", "x", "y", "z"), good.select("subject", *(F.col(c).alias(c + "2") for c in ("idx", "x", "y", "z")))
    pairs = p.join(q, "subject").where("idx < idx2")
    gap = F.sqrt(sum((F.pow(F.col(c) - F.col(c + "2"), 2) for c in "yz"), F.pow(F.col("x") - F.col("x2"), 2)))
    return pairs.groupBy("subject").agg(F.avg(gap).alias("distance"))


def fuse_depth(sources: DataFrame) -> DataFrame:
    """(idx, x, y, z): landmarks of the most frontal source, depths averaged by the sources' turn.

    ``sources`` are (source_id, yaw, idx, x, y, z) in one frame; equal turns go to the lesser id.
    """
    frontal = sources.select("source_id", "yaw").distinct()
    base = top_by(frontal.withColumn("g", F.lit(0)), ["g"], [F.abs("yaw"), F.col("source_id")]).select("source_id")
    w = S.yaw_weight(F.col("yaw"))
    depth = sources.groupBy("idx").agg(F.try_divide(F.sum(F.col("z") * w), F.sum(w)).alias("_z"))
    own = sources.join(F.broadcast(base), "source_id")
    return own.join(depth, "idx").select("idx", "x", "y", F.coalesce("_z", "z").alias("z"))


def similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scale, rotation, shift): least-squares similarity taking (sx, sy, sz) to (tx, ty, tz).

    Only moments are aggregated; the decomposition sees one row of sums for each group.
    """
    s, t = ("sx", "sy", "sz"), ("tx", "ty", "tz")
    moments = pairs.groupBy(*keys).agg(
        *(F.avg(c).alias(f"m_{c}") for c in (*s, *t)), F.avg(sum((F.col(c) * F.col(c) for c in s[1:]), F.col("sx") * F.col("sx"))).alias("ss"),
        *(F.avg(F.col(b) * F.col(a)).alias(f"{b}_{a}") for b in t for a in s),
    )

    def run(parts):
        for pdf in parts:
            rows = []
            for r in pdf.to_dict("records"):
                ms, mt = np.array([r[f"m_{c}"] for c in s]), np.array([r[f"m_{c}"] for c in t])
                cov = np.array([[r[f"{b}_{a}"] for a in s] for b in t]) - np.outer(mt, ms)
                u, d, vt = np.linalg.svd(cov)
                sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
                rot = (u * sign) @ vt
                scale = float((d * sign).sum() / max(r["ss"] - ms @ ms, 1e-12))
                rows.append((*(r[k] for k in keys), scale, rot.ravel().tolist(), (mt - scale * rot @ ms).tolist()))
            yield pd.DataFrame(rows, columns=[*keys, "scale", "rotation", "shift"])

    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return moments.mapInPandas(run, f"{kinds}, scale double, rotation array<double>, shift array<double>")


def best_hypothesis(poses: DataFrame) -> DataFrame:
    """Per image the pose hypothesis with most visibility, presence and extent; the first of equals.

    ``poses`` are (image_id, pose, idx, x, y, visibility, presence) with x and y in 0..1.
    """
    extent = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    value = F.sum("visibility") + F.sum("presence") + 10.0 * extent
    return top_by(poses.groupBy("image_id", "pose").agg(value.alias("value")), ["image_id"], [-F.col("value"), F.col("pose")])


def interval_on_segment(points: DataFrame, ax: float, ay: float, bx: float, by: float, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): the part of a segment that a group's pixels project on, as shares of its length."""
    dx, dy = bx - ax, by - ay
    length2 = max(dx * dx + dy * dy, 1e-12)
    t = F.least(F.greatest(((F.col("x") - ax) * dx + (F.col("y") - ay) * dy) / length2, F.lit(0.0)), F.lit(1.0))
    return points.groupBy(*keys).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
