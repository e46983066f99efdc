"""Scalar expressions against expected values of small cases."""

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import colour as C
from loomgrid.functions import geometry as G
from loomgrid.functions import scores as S
from loomgrid.functions import text as T


def one(spark, **columns):
    return list(spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first())


def test_clamp_ratio_and_angle(spark):
    d = lambda v: F.lit(v).cast("double")
    got = one(
        spark, a=S.clamp01(d(1.5)), b=S.clamp01(d(None)), c=S.safe_ratio(d(1.0), d(0.0)), e=S.ratio_plausibility(d(None)),
        f=S.ratio_plausibility(d(1.3)), g=S.ratio_plausibility(d(2.0)), h=S.angle_plausibility(d(None)), i=S.angle_plausibility(d(176.0)), j=S.quantize(d(0.25)),
    )
    assert got == [1.0, None, None, 0.5, 1.0, 0.0, 0.3, 0.6, 2]


def test_joint_angle_and_length(spark):
    p = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("z"))
    angle, length, none = one(
        spark, a=S.joint_angle(p(1.0, 0.0), p(0.0, 0.0), p(0.0, 2.0), F.lit(True)), b=S.segment_length(p(0.0, 0.0), p(3.0, 4.0), F.lit(True)), c=S.segment_length(p(0.0, 0.0), p(3.0, 4.0), F.lit(False))
    )
    assert angle == pytest.approx(90) and length == 5 and none is None


@pytest.mark.parametrize(
    "box, w, h, ratio, want",
    [((10, 10, 20, 20), 100, 100, (1, 1), (10, 10, 20, 20)), ((0, 0, 10, 20), 100, 100, (1, 1), (0, 0, 20, 20)), ((95, 40, 100, 60), 100, 100, (2, 1), (60, 40, 100, 60)), ((0, 0, 90, 10), 100, 50, (1, 1), (0, 0, 90, 50))],
)
def test_expand_to_ratio(spark, box, w, h, ratio, want):
    made = spark.range(1).select(G.expand_to_ratio(G.box(*box), F.lit(w), F.lit(h), ratio).alias("b")).first().b
    assert tuple(made) == want


def test_crop_mode_css_and_feather(spark):
    got = one(
        spark, a=G.crop_mode(F.lit("BBOX[3:4]")), b=G.crop_mode(F.lit("bbox[0:4]")), c=G.css_values(F.array(*(F.lit(v) for v in ("1px", "2px", "3px")))),
        d=G.feather_radius(F.lit("1%"), F.lit(10), F.lit(10)), e=G.feather_radius(F.lit("0px"), F.lit(10), F.lit(10)), f=G.delta(F.lit("-5%"), F.lit(100)) if False else G.size_expr(F.lit("-5%"), F.lit(100), None, False, True),
    )
    assert tuple(got[0]) == ("bbox", 3, 4) and got[1] is None and got[2] == ["1px", "2px", "3px", "2px"] and got[3:] == [1, 0, -5.0]


def test_segments(spark):
    s = lambda *v: [F.lit(float(x)) for x in v]
    got = one(
        spark, a=G.segments_intersect(s(0, 0, 2, 2), s(0, 2, 2, 0)), b=G.segments_intersect(s(0, 0, 1, 0), s(1, 0, 2, 5)), c=G.segments_intersect(s(0, 0, 1, 0), s(0, 1, 1, 1)),
        d=G.point_segment_distance(*s(0, 3, -1, 0, 1, 0)),
    )
    assert got == [True, True, False, 3.0]


def test_text(spark):
    got = one(
        spark, a=T.norm_prompt_list(F.array(F.lit(" a "), F.lit(None).cast("string"), F.lit(""), F.lit("b"))), b=T.first_text(F.lit(""), F.lit("x")), c=T.input_index(F.lit("image:12"), "image"),
        d=T.input_index(F.lit("img:1"), "image"), e=T.identifier_valid(F.lit("a.b")), f=T.identifier_valid(F.lit("a..b")), g=T.identifier_valid(F.lit(None).cast("string")),
    )
    assert got == ["a\nb", "x", 12, None, True, False, False]


def test_colour(spark):
    lab = spark.range(1).select(C.to_lab(F.lit(255.0), F.lit(255.0), F.lit(255.0)).alias("l")).first().l
    assert lab.l == pytest.approx(100, abs=1e-3) and lab.a == pytest.approx(0, abs=0.02)
    got = one(spark, a=C.alpha_factor(F.lit(5.0), 5.0, 2.0, 0.0), b=C.alpha_factor(F.lit(7.0), 5.0, 2.0, 0.25), c=C.alpha_factor(F.lit(6.0), 5.0, 2.0, 0.0))
    assert got == [0.0, 1.0, 0.5]
