"""Plausibility scores of bodies, hands, feet, faces and eyes, and the choice among mask candidates.

Landmarks are long: (subject, idx, x, y, z, valid) and what else a score names. Every score is one partially
aggregated pivot and column expressions; a landmark that has no row counts as not valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from .landmarks import pivot
from .rank import keep_unless_empty, top_by

#: Landmark numbers of a body.
CORE, UPPER, LOWER = (0, 11, 12, 23, 24), (0, 11, 12, 13, 14, 15, 16), (23, 24, 25, 26, 27, 28)
LIMBS = ((11, 13, 15), (12, 14, 16), (23, 25, 27), (24, 26, 28))
SHOULDERS, HIPS = (11, 12), (23, 24)
FEET = {"left": (25, 27, 29, 31), "right": (26, 28, 30, 32)}
#: Landmark numbers of a hand.
FINGERS = ((1, 2, 3, 4), (5, 6, 7, 8), (9, 10, 11, 12), (13, 14, 15, 16), (17, 18, 19, 20))
TIPS, KNUCKLES = (4, 8, 12, 16, 20), (5, 9, 13, 17)
#: Landmark ranges of a face, ends included.
FACE_PARTS = {"left_eye": (33, 132), "right_eye": (362, 462), "nose": (1, 5), "mouth": (61, 291)}


def _mean(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0]) / float(len(parts))


def _number(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


class _Body:
    """Lengths, angles and validity over the columns of a pivot."""

    def seen(self, *idx: int) -> Column:
        out = F.coalesce(F.col(f"p{idx[0]}")["valid"], F.lit(False))
        for i in idx[1:]:
            out = out & F.coalesce(F.col(f"p{i}")["valid"], F.lit(False))
        return out

    def length(self, a: int, b: int) -> Column:
        return S.segment_length(F.col(f"p{a}"), F.col(f"p{b}"), self.seen(a, b))

    def angle(self, a: int, b: int, c: int) -> Column:
        return S.joint_angle(F.col(f"p{a}"), F.col(f"p{b}"), F.col(f"p{c}"), self.seen(a, b, c))

    def share(self, idx: tuple[int, ...]) -> Column:
        return _mean([_number(self.seen(i)) for i in idx])

    def spread(self, idx: tuple[int, ...]) -> Column:
        """Mean distance of the seen landmarks' pairs; null for fewer than two."""
        points = F.filter(F.array(*(F.col(f"p{i}") for i in idx)), lambda p: p["valid"])
        gaps = F.transform(points, lambda p, i: F.transform(F.slice(points, i + 2, F.size(points)), lambda q: S.segment_length(p, q, F.lit(True))))
        gaps = F.array_compact(F.flatten(gaps))
        return F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x), F.size(gaps))


def pose_score(points: DataFrame) -> DataFrame:
    """(subject, score, coverage, chain, geometry, reliability, angle) of bodies; rows also have ``strong``."""
    body = _Body()
    limb = sorted({*CORE, *UPPER, *LOWER})
    strong = points.groupBy("subject").agg((F.count_if(F.col("strong")) / F.count("*")).alias("strong"))
    wide = pivot(points, limb).join(strong, "subject")
    coverage = S.clamp01(0.4 * F.col("strong") + 0.3 * body.share(CORE) + 0.15 * body.share(UPPER) + 0.15 * body.share(LOWER))
    chain = _mean([_number(body.seen(*c)) for c in LIMBS])
    near, far = [body.length(a, b) for a, b, _ in LIMBS], [body.length(b, c) for _, b, c in LIMBS]
    whole = [n + f for n, f in zip(near, far)]
    ratios = [S.safe_ratio(n, f) for n, f in zip(near, far)] + [S.safe_ratio(whole[0], whole[1]), S.safe_ratio(whole[2], whole[3])]
    shoulders, hips = body.length(*SHOULDERS), body.length(*HIPS)
    trunk = S.ratio_plausibility(S.safe_ratio(shoulders, hips), 1.2, 0.5, 1.5)
    geometry = _mean([*(S.ratio_plausibility(r) for r in ratios), trunk])
    angle = _mean([S.angle_plausibility(body.angle(*c)) for c in LIMBS])
    known = _mean([_number(x.isNotNull()) for x in (*near, *far, shoulders, hips)])
    parts = wide.select("subject", "strong", coverage.alias("coverage"), chain.alias("chain"), geometry.alias("geometry"), known.alias("known"), angle.alias("angle"))
    parts = parts.withColumn("reliability", S.clamp01(0.4 * F.col("strong") + 0.3 * F.col("chain") + 0.3 * F.col("known")))
    score = 0.35 * F.col("coverage") + 0.25 * F.col("chain") + 0.30 * F.col("reliability") * F.col("geometry") + 0.10 * F.col("angle")
    return parts.select("subject", S.clamp01(score).alias("score"), "coverage", "chain", "geometry", "reliability", "angle")


def hand_scores(points: DataFrame) -> DataFrame:
    """(subject, observable, observability, topology, geometry, score) of single hands; rows also have px and py in pixels.

    The score is 0 where the hand can't be judged.
    """
    body = _Body()
    wide = pivot(points, list(range(21)))
    good = points.where("valid").groupBy("subject").agg(
        F.count("*").alias("n"), (F.floor(F.max("px")) + 1 - F.floor(F.min("px"))).alias("w"), (F.floor(F.max("py")) + 1 - F.floor(F.min("py"))).alias("h")
    )
    wide = wide.join(good, "subject", "left")
    area = F.when(F.col("n") >= 3, F.col("w") * F.col("h")).otherwise(0.0)
    knuckles, tips, wrist = body.share(KNUCKLES), body.share(TIPS), _number(body.seen(0))
    seen = 0.30 * body.share(tuple(range(21))) + 0.20 * wrist + 0.20 * knuckles + 0.20 * tips + 0.10 * F.least(area / 400.0, F.lit(1.0))
    palm = body.length(5, 17)

    def finger(k: int) -> Column:
        total = sum((F.coalesce(body.length(a, b), F.lit(0.0)) for a, b in zip(FINGERS[k][1:], FINGERS[k][2:])), F.coalesce(body.length(*FINGERS[k][:2]), F.lit(0.0)))
        return S.safe_ratio(F.when(total > 0, total), palm)

    raw = _mean([S.ratio_plausibility(finger(1), 1.0, 0.5, 1.6), S.ratio_plausibility(finger(2), 1.2, 0.5, 1.8), S.ratio_plausibility(finger(0), 0.8, 0.4, 1.4)])
    spread = _mean([S.ratio_plausibility(S.safe_ratio(body.spread(TIPS), palm), 1.2, 0.6, 2.0), S.ratio_plausibility(S.safe_ratio(body.spread(KNUCKLES), palm), 0.8, 0.5, 1.8)])
    joints = [body.angle(*f[k : k + 3]) for f in FINGERS[1:] for k in (0, 1)]
    angle = _mean([F.when(a.isNull(), 0.4).when(a < 5, 0.0).otherwise(1.0) for a in joints])
    chains = _mean([_number(body.seen(*f)) for f in FINGERS])
    made = wide.select(
        "subject", S.clamp01(seen).alias("observability"), wrist.alias("wrist"), knuckles.alias("knuckles"), raw.alias("raw"), spread.alias("spread"),
        angle.alias("angle"), S.clamp01(0.55 * chains + 0.25 * knuckles + 0.20 * tips).alias("topology"), _number(palm.isNotNull()).alias("palm"),
    )
    trust = S.clamp01(0.45 * F.col("knuckles") + 0.35 * F.col("spread") + 0.20 * F.col("palm"))
    geometry = S.clamp01(0.35 * (trust * F.col("raw") + (1.0 - trust) * 0.5) + 0.35 * F.col("spread") + 0.30 * F.col("angle"))
    made = made.withColumn("geometry", geometry)
    observable = (F.col("observability") >= 0.45) & (F.col("wrist") > 0) & (F.col("knuckles") >= 0.5)
    score = S.clamp01(0.30 * F.col("observability") + 0.35 * F.col("topology") + 0.35 * F.col("geometry"))
    return made.select("subject", observable.alias("observable"), "observability", "topology", "geometry", F.when(observable, score).otherwise(0.0).alias("score"))


def foot_score(points: DataFrame) -> DataFrame:
    """(subject, observable, score): mean over the feet of which all four landmarks are seen; 0 without any."""
    body = _Body()
    wide = pivot(points, sorted(i for foot in FEET.values() for i in foot))
    measured, feet = [], []
    for side, (knee, ankle, heel, toe) in FEET.items():
        parts = {"shin": (knee, ankle), "foot": (heel, toe), "heel": (ankle, heel), "toe": (ankle, toe)}
        measured += [body.length(*p).alias(f"{side}_{n}") for n, p in parts.items()]
        measured += [body.angle(knee, ankle, toe).alias(f"{side}_angle"), body.seen(knee, ankle, heel, toe).alias(side)]
        size, back, front = (S.safe_ratio(F.col(f"{side}_{n}"), F.col(f"{side}_shin")) for n in ("foot", "heel", "toe"))
        joined = _mean([S.ratio_plausibility(back, 0.20, 0.15, 0.50), S.ratio_plausibility(front, 0.35, 0.20, 0.90)])
        feet.append((_mean([S.ratio_plausibility(size, 0.45, 0.20, 0.80), joined, S.angle_plausibility(F.col(f"{side}_angle"))]), F.col(side), 1.0))
    observable = F.col("left") | F.col("right")
    return wide.select("subject", *measured).select("subject", observable.alias("observable"), S.observable_mean(feet).alias("score"))


def face_score(points: DataFrame, width: Column, height: Column) -> DataFrame:
    """(subject, observable, score) of face landmarks (subject, idx, x, y) in pixels, from 50 landmarks on; size columns are grouped by."""
    x, y, idx = F.col("x"), F.col("y"), F.col("idx")
    part = lambda name, v: F.avg(F.when(idx.between(*FACE_PARTS[name]), v))
    made = points.select("*", width.alias("_w"), height.alias("_h")).groupBy("subject").agg(
        F.count("*").alias("n"), F.max("_w").alias("iw"), F.max("_h").alias("ih"),
        *((F.floor(f(v))).alias(f"{n}{c}") for c, v in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max))),
        *(part(name, y).alias(name) for name in FACE_PARTS), *(part(name, x).alias(f"{name}_x") for name in ("left_eye", "right_eye")),
    )
    w, h = F.col("hix") + 1 - F.col("lox"), F.col("hiy") + 1 - F.col("loy")
    share, aspect = w * h / F.greatest(F.lit(1), F.col("iw") * F.col("ih")), w / h
    size = F.when(share < 0.005, share / 0.005).when(share > 0.65, 1.0 - (share - 0.65) / 0.35).otherwise(1.0)
    form = F.when(aspect < 0.55, aspect / 0.55).when(aspect > 1.35, 1.35 / aspect).otherwise(1.0)
    eye = 0.5 * (F.col("left_eye") + F.col("right_eye"))
    ordered = _number((eye < F.col("nose")) & (F.col("nose") < F.col("mouth")))
    centre = 0.5 * (F.col("lox") + F.col("hix") + 1)
    like = lambda a, b: F.least(a, b) / F.greatest(F.lit(1.0), F.greatest(a, b))
    even = like(F.abs(centre - F.col("left_eye_x")), F.abs(F.col("right_eye_x") - centre))
    gaps = like(F.greatest(F.lit(0.0), F.col("nose") - eye), F.greatest(F.lit(0.0), F.col("mouth") - F.col("nose")))
    observable = F.col("n") >= 50
    score = S.clamp01(_mean([S.clamp01(size), S.clamp01(form), ordered, S.clamp01(even), S.clamp01(gaps)]))
    return made.select("subject", observable.alias("observable"), F.when(observable, score).otherwise(0.0).alias("score"))


def eye_score(left: Column, right: Column, face: Column) -> Column:
    """Mean of size, likeness, separation and level of two eye boxes in a face box."""
    lw, lh, rw, rh = (F.greatest(F.lit(1), b[f"{c}2"] - b[f"{c}1"]) for b in (left, right) for c in "xy")
    fw, fh = (F.greatest(F.lit(1), face[f"{c}2"] - face[f"{c}1"]) for c in "xy")
    size = F.least(lw, lh, rw, rh) / 8.0
    alike = F.least(lw * lh, rw * rh) / F.greatest(lw * lh, rw * rh)
    centre = lambda b, c: 0.5 * (b[f"{c}1"] + b[f"{c}2"])
    apart = F.abs(centre(right, "x") - centre(left, "x")) / fw
    separation = F.when(apart < 0.20, apart / 0.20).when(apart > 0.70, 0.70 / apart).otherwise(1.0)
    slope = F.least(F.lit(1.0), F.abs(centre(left, "y") - centre(right, "y")) / F.greatest(F.lit(1.0), 0.25 * fh))
    return S.clamp01((S.clamp01(size) + S.clamp01(alike) + S.clamp01(separation) + 1.0 - slope) / 4.0)


def choose_mask(candidates: DataFrame, keys: list[str], fraction: float | None = 0.8, target: float = 0.25, source: str | None = None) -> DataFrame:
    """The best candidate of each group, with its ``norm_area``.

    ``candidates`` are (keys, ord, score, area, inside, valid, violations, inverted, source): required points
    inside and valid ones, and forbidden points inside. Candidates with too few required points go, then those
    with violations, each only where others stay; then the order is: score in tenths, nearness of the area
    within its group's range to ``target``, fewer violations, not inverted, the wished source, the first.
    """
    pool = candidates
    if fraction is not None:
        least = F.greatest(F.lit(1), F.ceil(F.col("valid") * F.lit(fraction)))
        pool = keep_unless_empty(pool, keys, (F.col("valid") > 0) & (F.col("inside") >= least))
    pool = keep_unless_empty(pool, keys, F.col("violations") == 0)
    span = pool.groupBy(*keys).agg(F.min("area").alias("_lo"), F.max("area").alias("_hi"))
    pool = pool.join(span, keys).withColumn("norm_area", (F.col("area") - F.col("_lo")) / F.greatest(F.lit(1.0), F.col("_hi") - F.col("_lo")))
    wished = F.lit(0) if source is None else F.when(F.col("source") == source, 0).otherwise(1)
    order = [-S.quantize(F.col("score")), F.abs(F.col("norm_area") - target), F.col("violations"), F.col("inverted").cast("int"), wished, F.col("ord")]
    return top_by(pool, keys, order, ["ord", "norm_area", "violations"])


def colour_match(pixels: DataFrame, source: list[str], reference: list[str], keys: list[str], names: list[str], eps: float = 1e-6) -> DataFrame:
    """``names``: the source channels moved to the population mean and spread of the reference channels, per group."""
    stats = []
    for i, (s, r) in enumerate(zip(source, reference)):
        stats += [F.avg(s).alias(f"_m{i}"), F.stddev_pop(s).alias(f"_d{i}"), F.avg(r).alias(f"_n{i}"), F.stddev_pop(r).alias(f"_e{i}")]
    rows = pixels.join(pixels.groupBy(*keys).agg(*stats), keys)
    made = {n: (F.col(s) - F.col(f"_m{i}")) * (F.col(f"_e{i}") / (F.col(f"_d{i}") + eps)) + F.col(f"_n{i}") for i, (s, n) in enumerate(zip(source, names))}
    return rows.withColumns(made).drop(*(f"_{a}{i}" for i in range(len(source)) for a in "mdne"))
