"""Per-pixel colour algebra over (r, g, b) columns with values 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rec. 601 weights, and D65 white of the 2-degree observer.
LUMA = (0.299, 0.587, 0.114)
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (r * LUMA[0] + g * LUMA[1] + b * LUMA[2]) / 255.0


def to_byte(x: Column) -> Column:
    return F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(255.0)).cast("int")


def colourise(r: Column, g: Column, b: Column, colour: tuple[int, int, int], strength: float) -> Column:
    """Blend towards the colour at the pixel's own luminance."""
    y = luminance(r, g, b)
    return _rgb(*(to_byte(v * (1.0 - strength) + y * float(c) * strength) for v, c in zip((r, g, b), colour)))


def tint(r: Column, g: Column, b: Column, colour: tuple[int, int, int], strength: float) -> Column:
    """Blend towards the colour, the more the lighter the pixel."""
    amount = luminance(r, g, b) * strength
    return _rgb(*(to_byte(v * (1.0 - amount) + amount * float(c)) for v, c in zip((r, g, b), colour)))


def invert(v: Column) -> Column:
    return 255 - v


def _rgb(r, g, b) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def to_lab(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab (l, a, b) of an sRGB colour."""
    linear = [F.when(v / 255.0 > 0.04045, F.pow((v / 255.0 + 0.055) / 1.055, 2.4)).otherwise(v / 255.0 / 12.92) for v in (r, g, b)]
    xyz = [sum((c * m for c, m in zip(linear[1:], row[1:])), linear[0] * row[0]) / w for row, w in zip(TO_XYZ, WHITE)]
    f = [F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16.0 / 116.0) for v in xyz]
    return F.struct((116.0 * f[1] - 16.0).alias("l"), (500.0 * (f[0] - f[1])).alias("a"), (200.0 * (f[1] - f[2])).alias("b"))


def lab_distance(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "ab"), (p["l"] - q["l"]) * (p["l"] - q["l"])))


def smoothstep(t: Column) -> Column:
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return t * t * (3.0 - 2.0 * t)


def alpha_factor(distance: Column, tolerance: float, feather: float, retained: float) -> Column:
    """Share of alpha that stays at a colour distance: ``retained`` within the tolerance, all beyond the feather."""
    if feather == 0.0:
        step = F.when(distance > tolerance, 1.0).otherwise(0.0)
    else:
        step = smoothstep((distance - tolerance) / feather)
    return retained + (1.0 - retained) * step


def over(top: Column, top_alpha: Column, below: Column, below_alpha: Column) -> Column:
    """(value, alpha) of a channel composed over another; alphas are 0..1."""
    alpha = top_alpha + below_alpha * (1.0 - top_alpha)
    value = F.try_divide(top * top_alpha + below * below_alpha * (1.0 - top_alpha), alpha)
    return F.struct(F.coalesce(value, F.lit(0.0)).alias("value"), alpha.alias("alpha"))
