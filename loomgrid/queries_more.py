"""Further registered queries: geometry expressions, masks, payloads, plausibility scores and choices, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import colour as C
from .functions import geometry as G
from .functions import scores as S
from .functions import text as T
from .operators import anatomy as A
from .operators import boxes as B
from .operators import embeddings, landmarks, masks, merges
from .operators import sequences as Q
from .queries import _BOX, _DET, _H, _MASK, _PIX, _W, _detections, _mask, _pixels, query, r6, read
from .sources import files

# Boxes and sizes ---------------------------------------------------------------------------------------

_SIZED = f"SELECT l_orderkey, l_linenumber, (60 + l_partkey % 40)::INT AS w, (50 + l_suppkey % 30)::INT AS h, l_discount, l_tax, {_BOX} FROM lineitem"
_KEY = ["l_orderkey", "l_linenumber"]


def _sized(spark, d):
    x, y = F.col("l_partkey") % 50, F.col("l_suppkey") % 40
    b = G.box(x, y, x + 5 + F.col("l_quantity").cast("int") % 20, y + 3 + F.col("l_linenumber") * 4)
    w, h = (60 + F.col("l_partkey") % 40).cast("int"), (50 + F.col("l_suppkey") % 30).cast("int")
    return read(spark, d, "lineitem").select(*_KEY, w.alias("w"), h.alias("h"), "l_discount", "l_tax", b.alias("box"))


def _in(v: str, hi: str) -> str:
    return f"greatest(0, least({hi}, {v}))"


def _whole(x1: str, y1: str, x2: str, y2: str, more: str = "TRUE") -> str:
    """Corners in the image, null where nothing is left."""
    good = f"q.c > q.a AND q.d > q.b AND {more}"
    return f"""SELECT l_orderkey, l_linenumber, CASE WHEN {good} THEN q.a END AS x1, CASE WHEN {good} THEN q.b END AS y1, CASE WHEN {good} THEN q.c END AS x2, CASE WHEN {good} THEN q.d END AS y2
FROM (SELECT *, {{'a': ({_in(x1, 'w')})::BIGINT, 'b': ({_in(y1, 'h')})::BIGINT, 'c': ({_in(x2, 'w')})::BIGINT, 'd': ({_in(y2, 'h')})::BIGINT}} AS q FROM s)"""


def _corners(rows, made):
    return rows.select(*_KEY, made.alias("m")).select(*_KEY, *(F.col(f"m.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


def _shaky(rows):
    move = F.col("l_discount") * 100 - 4.3
    return rows.withColumn("box", G.box(*(F.col("box")[c] + m for c, m in (("x1", move), ("y1", move), ("x2", -2 * move), ("y2", move)))))


_MOVED = f"SELECT l_orderkey, l_linenumber, w, h, x1 + m AS x1, y1 + m AS y1, x2 - 2 * m AS x2, y2 + m AS y2 FROM (SELECT *, l_discount * 100 - 4.3::DOUBLE AS m FROM ({_SIZED}))"


@query(f"WITH s AS ({_MOVED}) " + _whole("round_even(x1, 0)", "round_even(y1, 0)", "round_even(x2, 0)", "round_even(y2, 0)"))
def bbox_clip_rounded(spark, d):
    rows = _shaky(_sized(spark, d))
    return _corners(rows, G.clip_bbox(F.col("box"), F.col("w"), F.col("h")))


_HEAD = "WITH s0 AS (SELECT *, {0} AS rx1, {1} AS ry1, {2} AS rx2, {3} AS ry2 FROM ({4})), s AS (SELECT *, greatest(rx2 - rx1, ry2 - ry1) AS side FROM s0) "


@query(
    _HEAD.format(*(_in(f"round_even({c}, 0)", s) for c, s in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h"))), _MOVED)
    + _whole(
        "floor((rx1 + rx2) / 2.0 - greatest(0.75 * side * 1.2, 1))", "floor((ry1 + ry2) / 2.0 - 0.15 * side - greatest(0.75 * side * 1.2, 1))",
        "ceil((rx1 + rx2) / 2.0 + greatest(0.75 * side * 1.2, 1))", "ceil((ry1 + ry2) / 2.0 - 0.15 * side + greatest(0.75 * side * 1.2, 1))", "rx2 > rx1 AND ry2 > ry1",
    )
)
def head_square(spark, d):
    return _corners(_shaky(_sized(spark, d)), G.square_head(F.col("box"), F.col("w"), F.col("h"), 1.2))


@query(f"SELECT l_orderkey, l_linenumber, x1 + 3 AS x1, y1 - 2 AS y1, x2 + 3 AS x2, y2 - 2 AS y2 FROM ({_SIZED})")
def bbox_offset(spark, d):
    return _corners(_sized(spark, d), G.offset_box(F.col("box"), F.lit(3), F.lit(-2)))


@query(f"""WITH s AS (SELECT *, greatest((x2 - x1) * 1.5::DOUBLE, 1) AS ow, greatest((y2 - y1) * 0.8::DOUBLE, 1) AS oh, 0.5::DOUBLE * (x1 + x2) AS cx FROM ({_SIZED})),
t AS (SELECT *, 0.5::DOUBLE * (y1 + y2) - 0.06 * oh AS cy FROM s),
u AS (SELECT *, greatest(0, least(w - 1, floor(cx - ow / 2)))::BIGINT AS a, greatest(0, least(h - 1, floor(cy - oh / 2)))::BIGINT AS b FROM t)
SELECT l_orderkey, l_linenumber, a AS x1, b AS y1, greatest(a + 1, least(w, ceil(cx + ow / 2)::BIGINT)) AS x2, greatest(b + 1, least(h, ceil(cy + oh / 2)::BIGINT)) AS y2 FROM u""")
def bbox_grow(spark, d):
    return _corners(_sized(spark, d), G.grow_about_centre(F.col("box"), F.col("w"), F.col("h"), 1.5, 0.8, 0.06))


_EXPR = "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN (10 + l_linenumber) || 'px' WHEN 2 THEN '37.5%' ELSE '120%' END"


def _expr(shift: int):
    k = (F.col("l_linenumber") + shift) % 4
    return F.when(k == 1, F.concat((10 + F.col("l_linenumber") + shift).cast("string"), F.lit("px"))).when(k == 2, "37.5%").when(k == 3, "120%")


def _px(expr: str, ref: str) -> str:
    return f"greatest(1, round_even(CASE WHEN {expr} LIKE '%px' THEN replace({expr}, 'px', '')::DOUBLE ELSE {ref} * (replace({expr}, '%', '')::DOUBLE / 100.0) END, 0))"


_SIZES = f"SELECT l_orderkey, l_linenumber, w, h, {_EXPR} AS a, {_EXPR.replace('l_linenumber', '(l_linenumber + 1)')} AS b FROM ({_SIZED})"


@query(f"""WITH s AS (SELECT *, {_px('a', 'w')} AS ow, {_px('b', 'h')} AS oh FROM ({_SIZES}))
SELECT l_orderkey, l_linenumber, CASE WHEN a IS NOT NULL THEN ow WHEN b IS NOT NULL THEN greatest(1, round_even(w * (oh / h), 0)) END::BIGINT AS rw,
CASE WHEN b IS NOT NULL THEN oh WHEN a IS NOT NULL THEN greatest(1, round_even(h * (ow / w), 0)) END::BIGINT AS rh FROM s""")
def resize_axes(spark, d):
    made = G.resize_two(_expr(0), _expr(1), F.col("w"), F.col("h"))
    return _sized(spark, d).select(*_KEY, made["w"].cast("long").alias("rw"), made["h"].cast("long").alias("rh"))


def _side_sql(f: str) -> str:
    return f"""WITH s AS (SELECT *, {f}(w, h) AS ref FROM ({_SIZES})), t AS (SELECT *, {_px('b', 'ref')} / ref AS k FROM s)
SELECT l_orderkey, l_linenumber, greatest(1, round_even(w * k, 0))::BIGINT AS rw, greatest(1, round_even(h * k, 0))::BIGINT AS rh FROM t WHERE b IS NOT NULL"""


def _side(spark, d, side):
    rows = _sized(spark, d).withColumn("b", _expr(1)).where("b is not null")
    made = G.resize_side(F.col("b"), F.col("w"), F.col("h"), side)
    return rows.select(*_KEY, made["w"].cast("long").alias("rw"), made["h"].cast("long").alias("rh"))


@query(_side_sql("greatest"))
def resize_long_side(spark, d):
    return _side(spark, d, "long")


@query(_side_sql("least"))
def resize_short_side(spark, d):
    return _side(spark, d, "short")


@query(f"SELECT l_orderkey, l_linenumber, (ceil(w / 8.0) * 8)::BIGINT AS rw, (ceil(h / 16.0) * 16)::BIGINT AS rh FROM ({_SIZED})")
def size_round_up(spark, d):
    return _sized(spark, d).select(*_KEY, G.round_up(F.col("w"), 8).cast("long").alias("rw"), G.round_up(F.col("h"), 16).cast("long").alias("rh"))


@query(f"""SELECT l_orderkey, l_linenumber, greatest(1, round_even((x2 - x1) * least(w / (x2 - x1)::DOUBLE, h / (y2 - y1)::DOUBLE), 0))::BIGINT AS fw,
greatest(1, round_even((y2 - y1) * least(w / (x2 - x1)::DOUBLE, h / (y2 - y1)::DOUBLE), 0))::BIGINT AS fh,
greatest(1, round_even((x2 - x1) * greatest(w / (x2 - x1)::DOUBLE, h / (y2 - y1)::DOUBLE), 0))::BIGINT AS cw,
greatest(1, round_even((y2 - y1) * greatest(w / (x2 - x1)::DOUBLE, h / (y2 - y1)::DOUBLE), 0))::BIGINT AS ch FROM ({_SIZED})""")
def layer_fit(spark, d):
    b = F.col("box")
    fit, cover = (G.fit_size(G.width(b), G.height(b), F.col("w"), F.col("h"), m) for m in ("fit", "cover"))
    return _sized(spark, d).select(*_KEY, *(v.cast("long").alias(n) for v, n in ((fit["w"], "fw"), (fit["h"], "fh"), (cover["w"], "cw"), (cover["h"], "ch"))))


@query(f"""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN round_even(pow(greatest(w, h) * (2.5::DOUBLE / 100), 2), 0) ELSE 40 END::BIGINT AS area FROM ({_SIZED})""")
def component_threshold(spark, d):
    value = F.when(F.col("l_linenumber") % 3 == 1, "2.5%").when(F.col("l_linenumber") % 3 == 2, "40")
    return _sized(spark, d).select(*_KEY, G.min_component_area(value, F.col("w"), F.col("h")).cast("long").alias("area"))


@query(f"""WITH s AS (SELECT *, [(l_orderkey % 5) || 'px', 'b' || l_linenumber, 'c', 'd'][:1 + (l_orderkey % 4)::INT] AS v FROM ({_SIZED})),
e AS (SELECT *, CASE len(v) WHEN 1 THEN [v[1], v[1], v[1], v[1]] WHEN 2 THEN [v[1], v[2], v[1], v[2]] WHEN 3 THEN [v[1], v[2], v[3], v[2]] ELSE v END AS x FROM s)
SELECT l_orderkey, l_linenumber, array_to_string(x, ' ') AS edges, array_to_string([CASE WHEN y1 <= 0 THEN '0px' ELSE x[1] END, CASE WHEN x2 >= w THEN '0px' ELSE x[2] END,
CASE WHEN y2 >= h THEN '0px' ELSE x[3] END, CASE WHEN x1 <= 0 THEN '0px' ELSE x[4] END], ' ') AS inner_edges FROM e""")
def css_edges(spark, d):
    whole = F.array(F.concat((F.col("l_orderkey") % 5).cast("string"), F.lit("px")), F.concat(F.lit("b"), "l_linenumber"), F.lit("c"), F.lit("d"))
    v = F.slice(whole, F.lit(1), (1 + F.col("l_orderkey") % 4).cast("int"))
    return _sized(spark, d).select(*_KEY, F.array_join(G.css_values(v), " ").alias("edges"), F.array_join(G.inner_edges(F.col("box"), F.col("w"), F.col("h"), v), " ").alias("inner_edges"))


_T = "least(1, greatest(0, ((x1 - 10) * (x2 - 10) + (y1 - 5) * (y2 - 5)) / pow(pow(x2 - 10, 2) + pow(y2 - 5, 2), 1)))"


@query(f"""WITH s AS (SELECT *, CASE WHEN pow(x2 - 10, 2) + pow(y2 - 5, 2) < 1e-6 THEN 0 ELSE {_T} END AS t FROM ({_SIZED}))
SELECT l_orderkey, l_linenumber, round(sqrt(pow(x1 - (10 + t * (x2 - 10)), 2) + pow(y1 - (5 + t * (y2 - 5)), 2)), 6) AS distance FROM s""")
def segment_distance(spark, d):
    b = F.col("box")
    return _sized(spark, d).select(*_KEY, r6(G.point_segment_distance(b["x1"], b["y1"], F.lit(10.0), F.lit(5.0), b["x2"], b["y2"])).alias("distance"))


def _turn_sql(a, b, c):
    return f"(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


_P, _R, _C, _D = ("x1", "y1"), ("x2", "y2"), ("30", "0"), ("40", "60")
_ON = lambda p, q, r: f"(abs({_turn_sql(p, q, r)}) <= 1e-6 AND {r[0]} BETWEEN least({p[0]}, {q[0]}) - 1e-6 AND greatest({p[0]}, {q[0]}) + 1e-6 AND {r[1]} BETWEEN least({p[1]}, {q[1]}) - 1e-6 AND greatest({p[1]}, {q[1]}) + 1e-6)"


@query(f"""SELECT l_orderkey, l_linenumber, ({_turn_sql(_P, _R, _C)} * {_turn_sql(_P, _R, _D)} < 0 AND {_turn_sql(_C, _D, _P)} * {_turn_sql(_C, _D, _R)} < 0)
OR {_ON(_P, _R, _C)} OR {_ON(_P, _R, _D)} OR {_ON(_C, _D, _P)} OR {_ON(_C, _D, _R)} AS crosses FROM ({_SIZED})""")
def segments_cross(spark, d):
    b = F.col("box")
    other = [F.lit(v) for v in (30, 0, 40, 60)]
    return _sized(spark, d).select(*_KEY, G.segments_intersect([b["x1"], b["y1"], b["x2"], b["y2"]], other).alias("crosses"))


@query("""SELECT l_orderkey, l_linenumber, v, regexp_full_match(lower(trim(v)), '[0-9]+(\\.[0-9]+)?(px|%)') AS strict, regexp_full_match(lower(trim(v)), '-?[0-9]+(\\.[0-9]+)?(px|%)?') AS loose
FROM (SELECT l_orderkey, l_linenumber, CASE l_partkey % 6 WHEN 0 THEN l_suppkey || 'px' WHEN 1 THEN ' 5.5% ' WHEN 2 THEN '-3PX' WHEN 3 THEN l_suppkey || '' WHEN 4 THEN 'px' ELSE '1..2%' END AS v FROM lineitem)""")
def size_expr_check(spark, d):
    k, n = F.col("l_partkey") % 6, F.col("l_suppkey").cast("string")
    v = F.when(k == 0, F.concat(n, F.lit("px"))).when(k == 1, " 5.5% ").when(k == 2, "-3PX").when(k == 3, n).when(k == 4, "px").otherwise("1..2%")
    rows = read(spark, d, "lineitem").select(*_KEY, v.alias("v"))
    return rows.select(*_KEY, "v", G.size_expr_valid(F.col("v")).alias("strict"), G.size_expr_valid(F.col("v"), True, True).alias("loose"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, lower(trim(CASE l_partkey % 5 WHEN 0 THEN 'BBOX' WHEN 1 THEN 'bbox[' || l_linenumber || ':' || l_suppkey % 3 || ']' WHEN 2 THEN ' trim' WHEN 3 THEN 'full_frame' ELSE 'other' END)) AS v FROM lineitem),
t AS (SELECT *, try_cast(regexp_extract(v, '^bbox\\[([0-9]+):([0-9]+)\\]$', 1) AS INT) AS a, try_cast(regexp_extract(v, '^bbox\\[([0-9]+):([0-9]+)\\]$', 2) AS INT) AS b FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN v IN ('bbox', 'trim', 'full_frame') THEN v WHEN a > 0 AND b > 0 THEN 'bbox' END AS mode, CASE WHEN a > 0 AND b > 0 THEN a END AS ratio_w, CASE WHEN a > 0 AND b > 0 THEN b END AS ratio_h FROM t""")
def crop_mode_parse(spark, d):
    k = F.col("l_partkey") % 5
    ratio = F.concat(F.lit("bbox["), "l_linenumber", F.lit(":"), F.col("l_suppkey") % 3, F.lit("]"))
    m = G.crop_mode(F.when(k == 0, "BBOX").when(k == 1, ratio).when(k == 2, " trim").when(k == 3, "full_frame").otherwise("other"))
    return read(spark, d, "lineitem").select(*_KEY, m["mode"].alias("mode"), m["ratio_w"].alias("ratio_w"), m["ratio_h"].alias("ratio_h"))


@query(f"""WITH r AS (SELECT *, (x2 - x1)::DOUBLE AS bw, (y2 - y1)::DOUBLE AS bh FROM ({_SIZED})),
s AS (SELECT *, least(greatest(bw, ceil(bh * (3 / 4.0::DOUBLE))), w) AS cw, least(greatest(bh, ceil(bw / (3 / 4.0::DOUBLE))), h) AS ch FROM r),
p AS (SELECT *, greatest(0, least(w - cw, floor(0.5::DOUBLE * (x1 + x2) - cw / 2))) AS px, greatest(0, least(h - ch, floor(0.5::DOUBLE * (y1 + y2) - ch / 2))) AS py FROM s),
q AS (SELECT *, greatest(x2 - cw, least(x1, px)) AS ax, greatest(y2 - ch, least(y1, py)) AS ay FROM p)
SELECT l_orderkey, l_linenumber, ax::BIGINT AS x1, ay::BIGINT AS y1, (ax + cw)::BIGINT AS x2, (ay + ch)::BIGINT AS y2 FROM q""")
def bbox_to_portrait(spark, d):
    return _corners(_sized(spark, d), G.expand_to_ratio(F.col("box"), F.col("w"), F.col("h"), (3, 4)))


# People ------------------------------------------------------------------------------------------------


@query(f"""WITH b AS ({_DET}) SELECT image_id, ord, (x2 - x1) * (y2 - y1) AS area FROM b WHERE x2 > x1 AND y2 > y1 AND ord % 2 = 0""")
def person_box_filter(spark, d):
    rows = _detections(spark, d).withColumn("label", F.when(F.col("ord") % 2 == 0, "person").otherwise("dog"))
    return B.person_boxes(rows).select("image_id", "ord", F.col("area").cast("long").alias("area"))


@query(f"""WITH b AS ({_DET}), c AS (SELECT image_id, count(*) AS n FROM b GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN image_id % 2 = 0 THEN x1 ELSE -x1 END, ord) AS k FROM b)
SELECT image_id, ord, n > 1 OR (CASE WHEN image_id % 2 = 0 THEN x1 <= 30 ELSE x1 >= 30 END) AS ok FROM r JOIN c USING (image_id) WHERE k = 1""")
def side_pick(spark, d):
    rows = _detections(spark, d).select("image_id", "ord", F.col("box")["x1"].alias("x"), F.when(F.col("image_id") % 2 == 0, "left").otherwise("right").alias("side"))
    return B.side_choice(rows, F.col("side"), F.lit(60)).select("image_id", "ord", "ok")


@query(f"""WITH b AS ({_DET}), f AS (SELECT image_id, min(x1) AS x1 FROM b WHERE ord = 1 AND x1 > 20 GROUP BY 1), g AS (SELECT image_id, max(x1) AS x1 FROM b WHERE ord = 2 GROUP BY 1)
SELECT image_id, coalesce(f.x1, g.x1) AS x1, f.x1 IS NULL AS fallback FROM f FULL JOIN g USING (image_id)""")
def box_or_pose(spark, d):
    rows = _detections(spark, d)
    first = rows.where("ord = 1 and box.x1 > 20").groupBy("image_id").agg(F.min("box").alias("box"))
    second = rows.where("ord = 2").groupBy("image_id").agg(F.max("box").alias("box"))
    return B.with_fallback(first, second).select("image_id", F.col("box.x1").alias("x1"), "fallback")


@query(f"""WITH b AS ({_DET}), u AS (SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) - 20 AS x2, max(y2) - 20 AS y2 FROM b GROUP BY 1)
SELECT u.image_id, bool_and(coalesce(p.x1 >= u.x1 AND p.x1 < u.x2 AND p.y1 >= u.y1 AND p.y1 < u.y2, false)) AS contains FROM u LEFT JOIN b p ON p.image_id = u.image_id GROUP BY 1""")
def box_holds_points(spark, d):
    rows = _detections(spark, d)
    b = F.col("box")
    around = B.union(rows, ["image_id"]).select("image_id", G.box(b["x1"], b["y1"], b["x2"] - 20, b["y2"] - 20).alias("box"))
    return B.all_points_inside(around, rows.select("image_id", b["x1"].alias("x"), b["y1"].alias("y")))


_POSE = "SELECT l_orderkey AS image_id, l_partkey % 50 - 3 AS x, l_suppkey % 40 - 3 AS y FROM lineitem"


def _pose(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 50 - 3).alias("x"), (F.col("l_suppkey") % 40 - 3).alias("y"))


@query(f"""WITH p AS ({_POSE}), t AS (SELECT image_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS n FROM p WHERE x >= 0 AND y >= 0 GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT *, greatest((x2 - x1) * 1.5::DOUBLE, 1) AS ow, greatest((y2 - y1) * (1.5::DOUBLE * 1.15::DOUBLE), 1) AS oh, 0.5::DOUBLE * (x1 + x2) AS cx FROM t), u AS (SELECT *, 0.5::DOUBLE * (y1 + y2) - 0.06 * oh AS cy FROM s),
v AS (SELECT *, greatest(0, least(63, floor(cx - ow / 2)))::BIGINT AS a, greatest(0, least(47, floor(cy - oh / 2)))::BIGINT AS b FROM u)
SELECT image_id, n, a AS x1, b AS y1, greatest(a + 1, least(64, ceil(cx + ow / 2)::BIGINT)) AS x2, greatest(b + 1, least(48, ceil(cy + oh / 2)::BIGINT)) AS y2 FROM v""")
def pose_person_box(spark, d):
    found = B.person_box_from_pose(_pose(spark, d), ["image_id"], F.lit(64), F.lit(48))
    return found.select("image_id", "n", *(F.col(f"box.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


# Masks -------------------------------------------------------------------------------------------------


def _mask_boxes(spark, d):
    return masks.tight_box(_mask(spark, d, 3)).select("mask_id", "box")


def _digest_sql(body: str) -> str:
    return f"SELECT mask_id, count(*) AS n, sum(x * 100 + y) AS digest FROM ({body}) GROUP BY 1"


def _digest(df):
    return df.groupBy("mask_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * 100 + F.col("y")).cast("long").alias("digest"))


@query(f"""WITH a AS ({_MASK.format(q=10)}), b AS (SELECT mask_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM ({_MASK.format(q=3)}) GROUP BY 1),
g AS (SELECT mask_id, gx.x, gy.y FROM b, (SELECT unnest(range(24)) AS x) gx, (SELECT unnest(range(24)) AS y) gy WHERE gx.x BETWEEN x1 AND x2 AND gy.y BETWEEN y1 AND y2)
""" + _digest_sql("SELECT g.* FROM g ANTI JOIN a USING (mask_id, x, y)"))
def mask_complement_in_box(spark, d):
    return _digest(masks.complement_in_box(_mask(spark, d, 10), _mask_boxes(spark, d)))


@query(f"WITH a AS ({_MASK.format(q=10)}) " + _digest_sql("SELECT * FROM a WHERE x >= 5 AND x < 17 AND y >= 3 AND y < 11"))
def mask_clip(spark, d):
    ids = _mask(spark, d, 10).select("mask_id").distinct().withColumn("box", G.box(F.lit(5), F.lit(3), F.lit(17), F.lit(11)))
    return _digest(masks.clip_to_box(_mask(spark, d, 10), ids))


@query(f"""WITH a AS (SELECT mask_id, max(x) + 1 - min(x) AS w, max(y) + 1 - min(y) AS h, count(*) AS n, 0.5::DOUBLE * (min(x) + max(x) + 1) AS cx, 0.5::DOUBLE * (min(y) + max(y) + 1) AS cy FROM ({_MASK.format(q=10)}) GROUP BY 1),
b AS (SELECT mask_id, max(x) + 1 - min(x) AS w, max(y) + 1 - min(y) AS h, count(*) AS n, 0.5::DOUBLE * (min(x) + max(x) + 1) AS cx, 0.5::DOUBLE * (min(y) + max(y) + 1) AS cy FROM ({_MASK.format(q=3)}) GROUP BY 1)
SELECT mask_id, round(b.w / a.w::DOUBLE, 6) AS width_ratio, round(b.h / a.h::DOUBLE, 6) AS height_ratio, round(b.n / a.n::DOUBLE, 6) AS area_ratio, b.cx - a.cx AS dx, b.cy - a.cy AS dy FROM a JOIN b USING (mask_id)""")
def mask_compare(spark, d):
    out = masks.compare(_mask(spark, d, 10), _mask(spark, d, 3))
    return out.select("mask_id", *(r6(c).alias(c) for c in ("width_ratio", "height_ratio", "area_ratio")), "dx", "dy")


@query(f"""WITH m AS ({_MASK.format(q=10)}), p AS (SELECT (l_orderkey // 4000) * 10 + l_linenumber AS mask_id, round_even(l_quantity / 2 - 0.5::DOUBLE, 0)::INT AS x, round_even(l_discount * 200, 0)::INT AS y, l_quantity / 2 - 0.5::DOUBLE AS fx FROM lineitem)
SELECT mask_id, count(m.x) AS inside, count(*) AS valid FROM (SELECT * FROM p WHERE fx >= 0) p LEFT JOIN m USING (mask_id, x, y) GROUP BY 1""")
def mask_points_inside(spark, d):
    mask_id = F.floor(F.col("l_orderkey") / 4000) * 10 + F.col("l_linenumber")
    points = read(spark, d, "lineitem").select(mask_id.alias("mask_id"), (F.col("l_quantity") / 2 - 0.5).alias("x"), (F.col("l_discount") * 200).alias("y"))
    return masks.points_inside(points, _mask(spark, d, 10))


@query(f"""WITH m AS ({_MASK.format(q=10)}), k AS (SELECT a.mask_id, a.x, a.y, count(*) AS near FROM m a JOIN m b ON a.mask_id = b.mask_id AND greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1 GROUP BY 1, 2, 3)
SELECT mask_id, near, count(*) AS n FROM k GROUP BY 1, 2""")
def mask_neighbours(spark, d):
    near = masks.neighbours8(_mask(spark, d, 10)).groupBy("mask_id", "x", "y").agg(F.count("*").alias("near"))
    return near.groupBy("mask_id", "near").agg(F.count("*").alias("n"))


@query(f"""WITH m AS ({_MASK.format(q=10)}) SELECT mask_id, ((x // 6) * 4 + y // 6)::BIGINT AS label, count(*) AS n FROM m WHERE (x // 6) * 4 + y // 6 IN (1, 6, 11) GROUP BY 1, 2""")
def region_masks(spark, d):
    """Masks of the chosen region labels."""
    label = (F.floor(F.col("x") / 6) * 4 + F.floor(F.col("y") / 6)).cast("long")
    chosen = spark.createDataFrame([(1,), (6,), (11,)], "label long")
    return masks.select_labels(_mask(spark, d, 10).withColumn("label", label), chosen).groupBy("mask_id", "label").agg(F.count("*").alias("n"))


_SEG = "SELECT p_partkey AS mask_id, p_partkey % 20 AS ax, p_size % 20 AS ay, p_partkey * 7 % 20 AS bx, p_partkey * 3 % 20 AS by_, 1 + p_partkey % 3 AS radius FROM part"


@query(f"""WITH s AS ({_SEG}), c AS (SELECT s.*, gx.x, gy.y, pow(bx - ax, 2) + pow(by_ - ay, 2) AS l FROM s, (SELECT unnest(range(20)) AS x) gx, (SELECT unnest(range(20)) AS y) gy),
t AS (SELECT *, CASE WHEN l < 1e-6 THEN 0 ELSE least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / l)) END AS t FROM c)
""" + _digest_sql("SELECT * FROM t WHERE sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by_ - ay)), 2)) <= radius + 1e-9"))
def capsule_raster(spark, d):
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(k.alias("mask_id"), (k % 20).alias("ax"), (F.col("p_size") % 20).alias("ay"), (k * 7 % 20).alias("bx"), (k * 3 % 20).alias("by"), (1 + k % 3 + 1e-9).alias("radius"))
    return _digest(masks.capsule(rows, 20, 20))


# Sequences, scores and payloads ------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, round(greatest(pow(sin(pi() * (l_partkey % 16 + 0.5) / 16), 2) * CASE WHEN l_linenumber = 1 THEN 1 ELSE pow(sin(pi() * ((l_suppkey % l_linenumber) + 0.5) / l_linenumber), 2) END, 1e-4), 6) AS weight FROM lineitem""")
def tile_weights(spark, d):
    x, n = F.col("l_partkey") % 16, F.col("l_linenumber")
    return read(spark, d, "lineitem").select(*_KEY, r6(Q.tile_weight_2d(x, F.col("l_suppkey") % n, F.lit(16), n)).alias("weight"))


@query("""WITH s AS (SELECT l_partkey AS pixel, sum(l_discount * (1 + l_tax)) AS s, sum(1 + l_tax) AS w FROM lineitem WHERE l_linenumber > 3 GROUP BY 1)
SELECT p_partkey AS pixel, round(coalesce(s / w, 1), 6) AS alpha FROM part LEFT JOIN s ON p_partkey = pixel""")
def tile_blend(spark, d):
    scores = read(spark, d, "lineitem").where("l_linenumber > 3").select(F.col("l_partkey").alias("pixel"), F.col("l_discount").alias("score"), (1 + F.col("l_tax")).alias("weight"))
    pixels = read(spark, d, "part").select(F.col("p_partkey").alias("pixel"))
    return Q.tile_blend(scores, pixels, ["pixel"]).select("pixel", r6("alpha").alias("alpha"))


@query("""SELECT l_orderkey, round(min(greatest(0, least(1, ((l_partkey % 50 - 5) * 30 + (l_suppkey % 40 - 5) * 20) / 1300.0::DOUBLE))), 6) AS lo,
round(max(greatest(0, least(1, ((l_partkey % 50 - 5) * 30 + (l_suppkey % 40 - 5) * 20) / 1300.0::DOUBLE))), 6) AS hi FROM lineitem GROUP BY 1""")
def segment_interval(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 40).alias("y"))
    return landmarks.interval_on_segment(rows, 5, 5, 35, 25, ["l_orderkey"]).select("l_orderkey", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("""WITH v AS (SELECT l_orderkey AS image_id, l_linenumber % 3 AS pose, round(sum(l_discount) + sum(l_tax) + 10 * (max(l_quantity) / 50 - min(l_quantity) / 50) * (max(l_tax) - min(l_tax)), 9) AS value FROM lineitem GROUP BY 1, 2)
SELECT image_id, round(max(value), 6) AS value FROM v GROUP BY 1""")
def pose_hypothesis(spark, d):
    rows = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 3).alias("pose"), F.col("l_partkey").alias("idx"), (F.col("l_quantity") / 50).alias("x"), F.col("l_tax").alias("y"),
        F.col("l_discount").alias("visibility"), F.col("l_tax").alias("presence"),
    )
    return landmarks.best_hypothesis(rows).select("image_id", r6("value").alias("value"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT label, i - 1 AS dim, round(avg(v), 6) AS value FROM x GROUP BY 1, 2""")
def mean_embedding_plain(spark, d):
    rows = embeddings.mean_embedding(read(spark, d, "embeddings"), ["label"], "embedding", normalise=False)
    return rows.select("label", F.posexplode("mean").alias("dim", "value")).select("label", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query("""WITH t AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT label, i, avg(v) AS m FROM t GROUP BY 1, 2)
SELECT vec_id, round(sum(CASE WHEN i < 10 OR i BETWEEN 40 AND 49 THEN m ELSE v END * (i + 1)), 4) AS digest FROM t JOIN s USING (label, i) GROUP BY 1""")
def coefficient_transfer(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    mean = rows.groupBy("label", "i").agg(F.avg("v").alias("m"))
    source = rows.join(mean, ["label", "i"]).select("vec_id", "i", F.col("m").alias("v"))
    out = embeddings.transfer_slices(source, rows.select("vec_id", "i", "v"), ["vec_id"], [(0, 10), (40, 50)])
    return out.groupBy("vec_id").agg(F.round(F.sum(F.col("v") * (F.col("i") + 1)), 4).alias("digest"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') || CASE WHEN event_id % 3 = 0 THEN '' ELSE '_seed' || event_id END || '.png' AS name, 'out/' || replace('a.' || event_type || '.x', '.', '/') AS folder FROM events""")
def artifact_names(spark, d):
    seed = F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    node = F.concat(F.lit("a."), "event_type", F.lit(".x"))
    return read(spark, d, "events").select("event_id", files.output_name(F.col("ts"), seed, "png").alias("name"), files.output_folder(F.lit("out"), node).alias("folder"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 2 END AS x, coalesce(CASE WHEN event_id % 3 = 0 THEN 'crop' END, event_type) AS mode,
CASE WHEN event_id % 5 = 0 THEN event_id WHEN event_id % 2 = 0 THEN 7 ELSE CASE WHEN event_id % 3 < 2 THEN (event_id % 3 + 1) * 10 END END AS slot FROM events""")
def payload_overrides(spark, d):
    k = F.col("event_id")
    base = F.struct(F.when(k % 4 != 0, k * 2).alias("x"), F.col("event_type").alias("mode"))
    other = F.struct(F.lit(None).cast("long").alias("x"), F.when(k % 3 == 0, "crop").alias("mode"))
    shared = F.when(k % 2 == 0, F.array(F.lit(7).cast("long"))).otherwise(F.array(F.lit(10).cast("long"), F.lit(20).cast("long")))
    made = merges.override(base, other, ["x", "mode"])
    slot = merges.slot_value(F.when(k % 5 == 0, k), shared, (k % 3).cast("int"))
    return read(spark, d, "events").select("event_id", made["x"].alias("x"), made["mode"].alias("mode"), slot.alias("slot"))


@query("""SELECT l_orderkey AS merge_id, -1 AS part, l_linenumber AS ord, 'd' || l_partkey AS path FROM lineitem WHERE l_linenumber < 3
UNION ALL SELECT l_orderkey, l_suppkey % 4, l_linenumber, 's' || l_partkey FROM lineitem WHERE l_linenumber >= 3""")
def merge_default_and_indexed(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("merge_id"), (F.col("l_suppkey") % 4).alias("idx"), F.col("l_linenumber").alias("ord"), "l_partkey")
    first = rows.where("ord < 3").withColumn("path", F.concat(F.lit("d"), "l_partkey"))
    return merges.merge_sequence(first, rows.where("ord >= 3").withColumn("path", F.concat(F.lit("s"), "l_partkey")), ["merge_id"])


@query("""WITH i AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image:' || p_size WHEN 1 THEN 'image' WHEN 2 THEN 'a.b' || p_size WHEN 3 THEN 'a..b' ELSE 'x y' END AS id FROM part)
SELECT p_partkey, try_cast(nullif(regexp_extract(id, '^image:([0-9]+)$', 1), '') AS INT) AS idx, regexp_full_match(id, '[^\\s/.]+(\\.[^\\s/.]+)*') AS valid, 'merge_' || substr(sha1(id || chr(0) || p_partkey), 1, 10) AS name FROM i""")
def identifier_rules(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    id_ = F.when(k == 0, F.concat(F.lit("image:"), n)).when(k == 1, "image").when(k == 2, F.concat(F.lit("a.b"), n)).when(k == 3, "a..b").otherwise("x y")
    rows = read(spark, d, "part").select("p_partkey", id_.alias("id"))
    name = T.merge_name(F.array("id", F.col("p_partkey").cast("string")))
    return rows.select("p_partkey", T.input_index(F.col("id"), "image").alias("idx"), T.identifier_valid(F.col("id")).alias("valid"), name.alias("name"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, least(1, l_quantity / 25 - 0.5)) AS clamped, round_even(greatest(0, least(1, l_quantity / 25 - 0.5)) * 10, 0)::BIGINT AS bucket FROM lineitem""")
def score_buckets(spark, d):
    x = F.col("l_quantity") / 25 - 0.5
    return read(spark, d, "lineitem").select(*_KEY, S.clamp01(x).alias("clamped"), S.quantize(x).cast("long").alias("bucket"))


@query(f"""WITH p AS ({_PIX}), s AS (SELECT *, 0.3::DOUBLE AS ta, 0.6::DOUBLE AS ba FROM p), o AS (SELECT *, ta + ba * (1 - ta) AS al FROM s)
SELECT l_orderkey, l_linenumber, round((r * ta + g * ba * (1 - ta)) / al, 6) AS value, round(al, 6) AS alpha,
round(0.2 + 0.8 * (t * t * (3 - 2 * t)), 6) AS keep FROM (SELECT *, least(1, greatest(0, (b - 20) / 60.0::DOUBLE)) AS t FROM o)""")
def alpha_layers(spark, d):
    o = C.over(F.col("r"), F.lit(0.3), F.col("g"), F.lit(0.6))
    return _pixels(spark, d).select(*_KEY, r6(o["value"]).alias("value"), r6(o["alpha"]).alias("alpha"), r6(C.alpha_factor(F.col("b"), 20.0, 60.0, 0.2)).alias("keep"))


# Plausibility ------------------------------------------------------------------------------------------


def _points(spark, d, n: int, orders: int):
    idx = ((F.col("l_partkey") + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % n).alias("idx")
    return read(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / orders).alias("subject"), idx).agg(
        F.min("l_quantity").alias("x"), (F.min("l_discount") * 100).alias("y"), (F.min("l_tax") * 100).alias("z"),
        (F.max("l_tax") > 0.01).alias("valid"), (F.max("l_tax") > 0.05).alias("strong"),
    )


def _points_sql(n: int, orders: int) -> str:
    return f"""m AS (SELECT l_orderkey // {orders} AS subject, (l_partkey + l_suppkey * 3 + l_linenumber) % {n} AS idx, min(l_quantity) AS x, min(l_discount) * 100 AS y, min(l_tax) * 100 AS z,
max(l_tax) > 0.01 AS v, max(l_tax) > 0.05 AS strong FROM lineitem GROUP BY 1, 2)"""


def _pivot_sql(idx) -> str:
    cells = ", ".join(f"max({{'x': x, 'y': y, 'z': z, 'v': v}}) FILTER (idx = {i}) AS p{i}" for i in sorted(set(idx)))
    return f"w AS (SELECT subject, {cells} FROM m GROUP BY 1 HAVING count(*) FILTER (idx IN ({', '.join(map(str, sorted(set(idx))))})) > 0)"


def _ok(*idx: int) -> str:
    return "(" + " AND ".join(f"coalesce(p{i}.v, false)" for i in idx) + ")"


def _len(a: int, b: int) -> str:
    return f"(CASE WHEN {_ok(a, b)} THEN sqrt(pow(p{a}.x - p{b}.x, 2) + pow(p{a}.y - p{b}.y, 2) + pow(p{a}.z - p{b}.z, 2)) END)"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 1e-8 THEN {a} / {b} END)"


def _like(r: str, ideal: float = 1.0, good: float = 0.35, bad: float = 1.0) -> str:
    return f"(CASE WHEN {r} IS NULL THEN 0.5::DOUBLE ELSE greatest(0, least(1, 1 - (abs({r} - {ideal}) - {good}) / ({bad} - {good}::DOUBLE))) END)"


def _angle(a: int, b: int, c: int) -> str:
    dot = " + ".join(f"(p{a}.{k} - p{b}.{k}) * (p{c}.{k} - p{b}.{k})" for k in "xyz")
    n = [" + ".join(f"pow(p{e}.{k} - p{b}.{k}, 2)" for k in "xyz") for e in (a, c)]
    return f"(CASE WHEN {_ok(a, b, c)} AND sqrt({n[0]}) > 1e-8 AND sqrt({n[1]}) > 1e-8 THEN degrees(acos(greatest(-1, least(1, ({dot}) / (sqrt({n[0]}) * sqrt({n[1]})))))) END)"


def _bend(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 0.3 WHEN {x} < 5 THEN 0 WHEN {x} < 15 THEN 0.4 WHEN {x} > 175 THEN 0.6 ELSE 1 END)::DOUBLE"


def _avg(parts) -> str:
    parts = list(parts)
    return f"(({' + '.join(parts)}) / {len(parts)}.0::DOUBLE)"


def _flag(x: str) -> str:
    return f"(CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0 END)"


def _foot_sql() -> str:
    feet = {}
    for side, (knee, ankle, heel, toe) in A.FEET.items():
        shin = _len(knee, ankle)
        joined = _avg([_like(_ratio(_len(ankle, heel), shin), 0.20, 0.15, 0.50), _like(_ratio(_len(ankle, toe), shin), 0.35, 0.20, 0.90)])
        feet[side] = f"CASE WHEN {_ok(knee, ankle, heel, toe)} THEN {_avg([_like(_ratio(_len(heel, toe), shin), 0.45, 0.20, 0.80), joined, _bend(_angle(knee, ankle, toe))])} END"
    idx = [i for f in A.FEET.values() for i in f]
    return f"""WITH {_points_sql(33, 16)}, {_pivot_sql(idx)}, f AS (SELECT subject, {feet['left']} AS a, {feet['right']} AS b FROM w)
SELECT subject, a IS NOT NULL OR b IS NOT NULL AS observable, round(coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 0), 6) AS score FROM f"""


@query(_foot_sql())
def foot_plausibility(spark, d):
    return A.foot_score(_points(spark, d, 33, 16)).select("subject", "observable", r6("score").alias("score"))


def _pose_sql() -> str:
    near, far = [_len(a, b) for a, b, _ in A.LIMBS], [_len(b, c) for _, b, c in A.LIMBS]
    whole = [f"({a} + {b})" for a, b in zip(near, far)]
    ratios = [_ratio(a, b) for a, b in zip(near, far)] + [_ratio(whole[0], whole[1]), _ratio(whole[2], whole[3])]
    trunk = _like(_ratio(_len(*A.SHOULDERS), _len(*A.HIPS)), 1.2, 0.5, 1.5)
    share = lambda idx: _avg(_flag(_ok(i)) for i in idx)
    segments = [*near, *far, _len(*A.SHOULDERS), _len(*A.HIPS)]
    return f"""WITH {_points_sql(33, 16)}, {_pivot_sql([*A.CORE, *A.UPPER, *A.LOWER])}, s AS (SELECT subject, count(*) FILTER (strong) / count(*)::DOUBLE AS strong FROM m GROUP BY 1),
f AS (SELECT subject, strong, 0.4 * strong + 0.3 * {share(A.CORE)} + 0.15 * {share(A.UPPER)} + 0.15 * {share(A.LOWER)} AS coverage, {_avg(_flag(_ok(*c)) for c in A.LIMBS)} AS chain,
{_avg([*(_like(r) for r in ratios), trunk])} AS geometry, {_avg(_flag(f'{x} IS NOT NULL') for x in segments)} AS known, {_avg(_bend(_angle(*c)) for c in A.LIMBS)} AS angle FROM w JOIN s USING (subject))
SELECT subject, round(0.35 * coverage + 0.25 * chain + 0.30 * (0.4 * strong + 0.3 * chain + 0.3 * known) * geometry + 0.10 * angle, 6) AS score, round(geometry, 6) AS geometry FROM f"""


@query(_pose_sql())
def pose_plausibility(spark, d):
    return A.pose_score(_points(spark, d, 33, 16)).select("subject", r6("score").alias("score"), r6("geometry").alias("geometry"))


def _hand_sql() -> str:
    share = lambda idx: _avg(_flag(_ok(i)) for i in idx)
    palm = _len(5, 17)

    def finger(k):
        total = "(" + " + ".join(f"coalesce({_len(a, b)}, 0)" for a, b in zip(A.FINGERS[k], A.FINGERS[k][1:])) + ")"
        return _ratio(f"nullif({total}, 0)", palm)

    def spread(idx):
        return "list_avg(list_filter([" + ", ".join(_len(a, b) for k, a in enumerate(idx) for b in idx[k + 1 :]) + "], lambda g: g IS NOT NULL))"

    raw = _avg([_like(finger(1), 1.0, 0.5, 1.6), _like(finger(2), 1.2, 0.5, 1.8), _like(finger(0), 0.8, 0.4, 1.4)])
    wide = _avg([_like(_ratio(spread(A.TIPS), palm), 1.2, 0.6, 2.0), _like(_ratio(spread(A.KNUCKLES), palm), 0.8, 0.5, 1.8)])
    bends = _avg(f"(CASE WHEN {x} IS NULL THEN 0.4 WHEN {x} < 5 THEN 0 ELSE 1 END)::DOUBLE" for x in (_angle(*f[k : k + 3]) for f in A.FINGERS[1:] for k in (0, 1)))
    return f"""WITH {_points_sql(21, 16)}, {_pivot_sql(range(21))},
g AS (SELECT subject, CASE WHEN count(*) >= 3 THEN (floor(max(x * 4)) + 1 - floor(min(x * 4))) * (floor(max(y * 3)) + 1 - floor(min(y * 3))) ELSE 0 END AS area FROM m WHERE v GROUP BY 1),
f AS (SELECT subject, {share(range(21))} AS valid, {_flag(_ok(0))} AS wrist, {share(A.KNUCKLES)} AS k, {share(A.TIPS)} AS t, coalesce(area, 0) AS area, {_avg(_flag(_ok(*x)) for x in A.FINGERS)} AS chain,
{raw} AS raw, {wide} AS spread, {bends} AS bend, {_flag(f'{palm} IS NOT NULL')} AS palm FROM w LEFT JOIN g USING (subject)),
h AS (SELECT *, 0.3 * valid + 0.2 * wrist + 0.2 * k + 0.2 * t + 0.1 * least(1, area / 400) AS seen, 0.55 * chain + 0.25 * k + 0.2 * t AS topology, least(1, 0.45 * k + 0.35 * spread + 0.2 * palm) AS trust FROM f),
z AS (SELECT *, 0.35 * (trust * raw + (1 - trust) * 0.5) + 0.35 * spread + 0.3 * bend AS geometry, seen >= 0.45 AND wrist > 0 AND k >= 0.5 AS observable FROM h)
SELECT subject, observable, round(CASE WHEN observable THEN 0.3 * seen + 0.35 * topology + 0.35 * geometry ELSE 0 END, 6) AS score FROM z"""


@query(_hand_sql())
def hand_plausibility(spark, d):
    points = _points(spark, d, 21, 16).withColumns({"px": F.col("x") * 4, "py": F.col("y") * 3})
    return A.hand_scores(points).select("subject", "observable", r6("score").alias("score"))


_FACE_PART = lambda name, v: "avg({0}) FILTER (idx BETWEEN {1} AND {2})".format(v, *A.FACE_PARTS[name])


@query(f"""WITH {_points_sql(468, 200)}, p AS (SELECT subject, idx, x * 4 + idx % 50 AS x, y * 9 + idx / 6.0::DOUBLE AS y FROM m),
f AS (SELECT subject, count(*) AS n, floor(min(x)) AS x1, floor(max(x)) + 1 AS x2, floor(max(y)) + 1 - floor(min(y)) AS h, {_FACE_PART('left_eye', 'y')} AS le, {_FACE_PART('right_eye', 'y')} AS re,
{_FACE_PART('nose', 'y')} AS nose, {_FACE_PART('mouth', 'y')} AS mouth, {_FACE_PART('left_eye', 'x')} AS lx, {_FACE_PART('right_eye', 'x')} AS rx FROM p GROUP BY 1),
g AS (SELECT *, (x2 - x1) * h / (640 * 480)::DOUBLE AS area, (x2 - x1) / h AS aspect, 0.5 * (le + re) AS eye, abs(0.5 * (x1 + x2) - lx) AS dl, abs(rx - 0.5 * (x1 + x2)) AS dr FROM f)
SELECT subject, n >= 50 AS observable, round(CASE WHEN n >= 50 THEN (greatest(0, CASE WHEN area < 0.005 THEN area / 0.005 WHEN area > 0.65 THEN 1 - (area - 0.65) / 0.35 ELSE 1 END)
+ CASE WHEN aspect < 0.55 THEN aspect / 0.55 WHEN aspect > 1.35 THEN 1.35 / aspect ELSE 1 END + CASE WHEN eye < nose AND nose < mouth THEN 1 ELSE 0 END
+ least(dl, dr) / greatest(1, dl, dr) + least(greatest(0, nose - eye), greatest(0, mouth - nose)) / greatest(1, nose - eye, mouth - nose)) / 5 ELSE 0 END, 6) AS score FROM g""")
def face_plausibility(spark, d):
    points = _points(spark, d, 468, 200).select("subject", "idx", (F.col("x") * 4 + F.col("idx") % 50).alias("x"), (F.col("y") * 9 + F.col("idx") / 6.0).alias("y"))
    return A.face_score(points, F.lit(640), F.lit(480)).select("subject", "observable", r6("score").alias("score"))


@query(f"""WITH b AS (SELECT *, x1 + l_linenumber * 3 AS a1, x1 + l_linenumber * 3 + 7 AS a2, y1 + 2 AS b1, y1 + 8 AS b2 FROM ({_SIZED})), s AS (SELECT *, (x2 - x1) * (y2 - y1) AS la, (a2 - a1) * (b2 - b1) AS ra, abs(0.5 * (a1 + a2) - 0.5 * (x1 + x2)) / w::DOUBLE AS apart FROM b)
SELECT l_orderkey, l_linenumber, round((least(1, least(x2 - x1, y2 - y1, a2 - a1, b2 - b1) / 8.0) + least(la, ra) / greatest(la, ra)::DOUBLE + CASE WHEN apart < 0.2 THEN apart / 0.2 WHEN apart > 0.7 THEN 0.7 / apart ELSE 1 END
+ 1 - least(1, abs(0.5 * (y1 + y2) - 0.5 * (b1 + b2)) / greatest(1, 0.25::DOUBLE * h))) / 4, 6) AS score FROM s""")
def eye_plausibility(spark, d):
    b, k = F.col("box"), F.col("l_linenumber") * 3
    right = G.box(b["x1"] + k, b["y1"] + 2, b["x1"] + k + 7, b["y1"] + 8)
    return _sized(spark, d).select(*_KEY, r6(A.eye_score(b, right, G.box(F.lit(0), F.lit(0), F.col("w"), F.col("h")))).alias("score"))


@query("""WITH c AS (SELECT l_orderkey AS target, l_linenumber * 100000 + l_partkey AS ord, l_discount * 10 AS score, l_quantity * 10 AS area, l_suppkey % 5 AS inside, 4 AS valid, l_partkey % 3 AS violations, l_suppkey % 2 = 1 AS inverted, CASE WHEN l_partkey % 2 = 0 THEN 'box' ELSE 'points' END AS source FROM lineitem),
a AS (SELECT *, max((inside >= 4)::INT) OVER (PARTITION BY target) AS any_in FROM c), b AS (SELECT * FROM a WHERE inside >= 4 OR any_in = 0),
e AS (SELECT *, max((violations = 0)::INT) OVER (PARTITION BY target) AS any_clean FROM b), f AS (SELECT * FROM e WHERE violations = 0 OR any_clean = 0),
g AS (SELECT *, (area - min(area) OVER (PARTITION BY target)) / greatest(1, max(area) OVER (PARTITION BY target) - min(area) OVER (PARTITION BY target)) AS norm FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round_even(greatest(0, least(1, score)) * 10, 0) DESC, abs(norm - 0.25::DOUBLE), violations, inverted, source <> 'box', ord) AS r FROM g)
SELECT target, ord, round(norm, 6) AS norm_area, violations FROM h WHERE r = 1""")
def guided_mask_choice(spark, d):
    k = F.col("l_partkey")
    rows = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("target"), (F.col("l_linenumber") * 100000 + k).alias("ord"), (F.col("l_discount") * 10).alias("score"), (F.col("l_quantity") * 10).alias("area"),
        (F.col("l_suppkey") % 5).alias("inside"), F.lit(4).alias("valid"), (k % 3).alias("violations"), (F.col("l_suppkey") % 2 == 1).alias("inverted"), F.when(k % 2 == 0, "box").otherwise("points").alias("source"),
    )
    return A.choose_mask(rows, ["target"], source="box").select("target", "ord", r6("norm_area").alias("norm_area"), "violations")
