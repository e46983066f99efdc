"""Scores and plausibility measures as column expressions. A null input gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def clamp01(x: Column) -> Column:
    """x limited to [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def segment_length(a: Column, b: Column, valid: Column) -> Column:
    """Length between two structs (x, y, z); null where not valid or not a number."""
    total = sum(((a[k] - b[k]) * (a[k] - b[k]) for k in ("y", "z")), (a["x"] - b["x"]) * (a["x"] - b["x"]))
    return F.when(valid & ~F.isnan(total), F.sqrt(total))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is not above 1e-8."""
    return F.when(b > EPS, F.try_divide(a, b))


def joint_angle(a: Column, b: Column, c: Column, valid: Column) -> Column:
    """Angle at b between a and c in degrees, for structs (x, y, z)."""
    u = {k: a[k] - b[k] for k in "xyz"}
    v = {k: c[k] - b[k] for k in "xyz"}
    dot = u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]
    nu = F.sqrt(u["x"] * u["x"] + u["y"] * u["y"] + u["z"] * u["z"])
    nv = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    cosine = F.try_divide(dot, nu * nv)
    return F.when(valid & (nu > EPS) & (nv > EPS), F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))))


def ratio_plausibility(r: Column, ideal: float = 1.0, good: float = 0.35, bad: float = 1.0) -> Column:
    """1 within ``good`` of the ideal, falling to 0 at ``bad``; 0.5 for null."""
    off = F.abs(r - ideal)
    ramp = 1.0 - (off - good) / (bad - good)
    return F.when(r.isNull(), 0.5).otherwise(F.least(F.greatest(ramp, F.lit(0.0)), F.lit(1.0)))


def angle_plausibility(degrees: Column) -> Column:
    """Stepwise score of a joint angle; 0.3 for null."""
    return (
        F.when(degrees.isNull(), 0.3).when(degrees < 5, 0.0).when(degrees < 15, 0.4).when(degrees > 175, 0.6).otherwise(1.0)
    )


def mse_pair_score(uncond: Column, cond: Column) -> Column:
    """Half the relative gain of ``cond`` over ``uncond``, half its fit 1 / (1 + cond)."""
    gain = clamp01((uncond - cond) / F.greatest(uncond, F.lit(EPS)))
    return clamp01(0.5 * gain + 0.5 * clamp01(1.0 / (1.0 + cond)))


def quantize(x: Column, bins: int = 10) -> Column:
    """Bucket of a score in [0, 1], rounded half to even."""
    return F.rint(clamp01(x) * bins).cast("int")


def yaw_weight(yaw: Column) -> Column:
    """Weight of a view by its turn: a ramp up to 60 degrees, down to 80, at least 0.1 below that."""
    turn = F.abs(yaw)
    ramp = F.when(turn <= 60, turn / 60.0).otherwise((80.0 - turn) / 20.0)
    return F.when(turn >= 80, 0.0).otherwise(F.greatest(ramp, F.lit(0.1)))


def face_size_score(box: Column, width: Column, height: Column) -> Column:
    """0.45 resolution + 0.35 frame coverage + 0.20 border contact of a face box; 0 for an empty box."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    share = w * h / F.greatest(width * height, F.lit(1))
    coverage = F.when(share < 0.01, share / 0.01).when(share > 0.45, 1.0 - (share - 0.45) / 0.35).otherwise(1.0)
    touches = sum(
        (F.when(c, 1).otherwise(0) for c in (box["y1"] <= 0, box["x2"] >= width, box["y2"] >= height)),
        F.when(box["x1"] <= 0, 1).otherwise(0),
    )
    border = F.get(F.array(*(F.lit(v) for v in (1.0, 0.75, 0.45, 0.2, 0.0))), touches)
    score = 0.45 * clamp01(F.least(w, h) / 96.0) + 0.35 * clamp01(coverage) + 0.20 * border
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(clamp01(score))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def observable_mean(parts: list[tuple[Column, Column, float]]) -> Column:
    """Weighted mean over the observable parts (score, observable, weight); 0 if none is."""
    weight = sum((F.when(seen, w).otherwise(0.0) for _, seen, w in parts), F.lit(0.0))
    total = sum((F.when(seen, score * w).otherwise(0.0) for score, seen, w in parts), F.lit(0.0))
    return F.when(weight > EPS, F.try_divide(total, weight)).otherwise(0.0)
