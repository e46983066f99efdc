"""Registered queries of the engine's operators over the test tables, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import colour as C
from .functions import geometry as G
from .functions import scores as S
from .functions import text as T
from .operators import boxes as B
from .operators import clusters, embeddings, landmarks, masks, merges, rank
from .operators import sequences as Q
from .plans import graph
from .sources import artifacts
from .streaming import state

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.col:
    return F.round(c, 6)


# Rankings ---------------------------------------------------------------------------------------------


def _part_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Three scorers over parts: size, price and demand; demand is not observable without line items."""
    part = read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    demand = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("orders"))
    mean = part.agg(F.avg("p_retailprice").alias("price"))
    mean_orders = demand.agg(F.avg("orders").alias("mean_orders"))
    rows = part.join(demand, "p_partkey", "left").join(F.broadcast(mean)).join(F.broadcast(mean_orders))
    ratios = [
        ("size", F.col("p_size") / 25.0, 1.0), ("price", F.col("p_retailprice") / F.col("price"), 2.0),
        ("demand", F.col("orders") / F.col("mean_orders"), 3.0),
    ]
    scored = F.explode(F.array(*(
        F.struct(F.lit(n).alias("scorer_id"), F.lit(i).alias("scorer_ord"), S.ratio_plausibility(r).alias("score"), F.lit(w).alias("score_weight"),
                 (r.isNotNull()).alias("observable")) for i, (n, r, w) in enumerate(ratios)
    ))).alias("s")
    return rows.select(F.col("p_partkey").alias("image"), F.col("p_partkey").alias("ord"), scored).select("image", "ord", "s.*").where("observable")


_PLAUSIBLE = "CASE WHEN abs({0} - 1) <= 0.35 THEN 1.0 WHEN abs({0} - 1) >= 1 THEN 0.0 ELSE 1 - (abs({0} - 1) - 0.35) / 0.65 END"
_RANKINGS = f"""
WITH o AS (SELECT l_partkey, count(DISTINCT l_orderkey)::DOUBLE AS orders FROM lineitem GROUP BY 1),
r AS (SELECT p_partkey AS image, p_size / 25.0::DOUBLE AS a, p_retailprice / (SELECT avg(p_retailprice) FROM part) AS b,
      orders / (SELECT avg(orders) FROM o) AS c FROM part LEFT JOIN o ON p_partkey = l_partkey),
s AS (SELECT image, 0 AS scorer_ord, ({_PLAUSIBLE.format('a')})::DOUBLE AS score, 1.0::DOUBLE AS w FROM r
 UNION ALL SELECT image, 1, ({_PLAUSIBLE.format('b')})::DOUBLE, 2.0 FROM r
 UNION ALL SELECT image, 2, ({_PLAUSIBLE.format('c')})::DOUBLE, 3.0 FROM r WHERE c IS NOT NULL),
m AS (SELECT image, sum(score * w) / sum(w) AS score, count(*) AS n FROM s GROUP BY image)
"""


@query(_RANKINGS + "SELECT image AS p_partkey, n AS n_scorers, round(score, 6) AS score FROM m")
def rank_weighted_mean(spark, d):
    means = rank.weighted_mean(_part_rankings(spark, d))
    return means.select(F.col("image").alias("p_partkey"), F.col("n").alias("n_scorers"), r6("score").alias("score"))


@query(_RANKINGS + "SELECT image, round(score, 6) AS score FROM m WHERE score > 0 ORDER BY round(score, 9) DESC, image LIMIT 1")
def rank_top1(spark, d):
    rows = _part_rankings(spark, d).withColumn("score", F.round("score", 12))
    return rank.best(rows, places=9).select("image", r6("score").alias("score"))


@query(_RANKINGS + """, k AS (SELECT * FROM s WHERE scorer_ord <> 1 UNION ALL SELECT image, 1, 0.5, 1.0 FROM r WHERE image % 3 = 0)
SELECT image, count(*) AS n, round(sum(score * w) / sum(w), 6) AS score FROM k GROUP BY image""")
def rank_chain_union(spark, d):
    """Upstream replaces the scorer of the same id."""
    own = _part_rankings(spark, d).drop("observable")
    upstream = rank.build_ranking(own.where("scorer_ord = 0 and image % 3 = 0").select("ord", "image", F.lit(0.5).alias("score")), "price", 1, 1.0)
    merged = rank.merge_rankings(own, upstream)
    return rank.weighted_mean(merged).select("image", "n", r6("score").alias("score"))


@query("""WITH a AS (SELECT l_suppkey, count(*) AS n, avg(l_discount) AS disc FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey, round(CASE WHEN coalesce(n, 0) > 0
  THEN (0.5 * least(greatest(s_acctbal / 10000, 0), 1) + 0.3 * (1 - disc) + CASE WHEN n >= 10 THEN 0.2 * least(n / 100.0::DOUBLE, 1) ELSE 0 END) / (CASE WHEN n >= 10 THEN 1.0 ELSE 0.8 END)
  ELSE least(greatest(s_acctbal / 10000, 0), 1) END, 6) AS score FROM supplier LEFT JOIN a ON s_suppkey = l_suppkey""")
def observable_weighted_score(spark, d):
    lines = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("disc"))
    rows = read(spark, d, "supplier").select("s_suppkey", "s_acctbal").join(lines, "s_suppkey", "left")
    n = F.coalesce("n", F.lit(0))
    score = S.observable_mean([
        (S.clamp01(F.col("s_acctbal") / 10000), F.lit(True), 0.5), (1 - F.col("disc"), n > 0, 0.3), (S.clamp01(n / 100.0), n >= 10, 0.2),
    ])
    return rows.select("s_suppkey", r6(score).alias("score"))


_MSE = "0.5 * least(greatest((l_discount - l_tax) / greatest(l_discount, 1e-8), 0), 1) + 0.5 / (1 + l_tax)"


@query(f"SELECT l_orderkey, l_linenumber, round({_MSE}, 6) AS score, l_tax >= l_discount AS no_gain FROM lineitem")
def mse_pair_score(spark, d):
    u, c = F.col("l_discount"), F.col("l_tax")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(S.mse_pair_score(u, c)).alias("score"), (c >= u).alias("no_gain"))


@query(f"SELECT l_orderkey, round(avg({_MSE}), 6) AS score, bool_and(l_tax < l_discount) AS observable, count(*) AS steps FROM lineitem GROUP BY 1")
def prompt_alignment(spark, d):
    u, c = F.col("l_discount"), F.col("l_tax")
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(r6(F.avg(S.mse_pair_score(u, c))).alias("score"), F.bool_and(c < u).alias("observable"), F.count("*").alias("steps"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT p_brand, p_partkey, rank FROM p WHERE rank <= 3""")
def ranked_top_k(spark, d):
    rows = read(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return rank.top_k(rows, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "rank")


@query("""WITH f AS (SELECT *, p_retailprice > 1500 AS ok, max((p_retailprice > 1500)::INT) OVER (PARTITION BY p_size) AS any_ok FROM part)
SELECT p_size, count(*) AS n, min(p_partkey) AS first FROM f WHERE ok OR any_ok = 0 GROUP BY 1""")
def filter_unless_empty(spark, d):
    rows = read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return rank.keep_unless_empty(rows, ["p_size"], F.col("p_retailprice") > 1500).groupBy("p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT event_type, min(event_id) AS ord FROM events GROUP BY 1")
def ordered_distinct(spark, d):
    return rank.ordered_distinct(read(spark, d, "events").select("event_type", F.col("event_id").alias("ord")), "event_type")


# Artifacts and payloads -------------------------------------------------------------------------------


@query("""WITH a AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'x' || event_id ELSE strftime(ts, '%Y-%m-%d_%H%M%S') || '_' || event_id END AS name FROM events),
s AS (SELECT *, regexp_extract(name, '^([0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{6})', 1) AS stamp FROM a)
SELECT user_id, name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stamp = '', stamp DESC, name) AS r FROM s) WHERE r = 1""")
def latest_artifact(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd_HHmmss")
    key = F.col("event_id").cast("string")
    name = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), key)).otherwise(F.concat_ws("_", stamp, key))
    return artifacts.latest(read(spark, d, "events").select("user_id", name.alias("name")), "user_id").select("user_id", "name")


@query("""SELECT event_id, CASE WHEN k % 3 = 0 THEN k + 640 WHEN k % 3 = 1 THEN k + 700 ELSE 832 END AS w, CASE WHEN k % 3 = 0 THEN 960 WHEN k % 3 = 1 THEN 900 ELSE 640 END AS h
FROM (SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events)""")
def size_fallback_coalesce(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    pair = lambda c, w, h: F.when(c, F.struct(w.alias("w"), F.lit(h).cast("int").alias("h"))).otherwise(F.struct(F.lit(None).cast("long").alias("w"), F.lit(None).cast("int").alias("h")))
    size = merges.output_size(pair(k % 3 == 0, k + 640, 960), pair(k % 3 == 1, k + 700, 900), pair(F.lit(True), F.lit(832).cast("long"), 640))
    return read(spark, d, "events").select("event_id", size["w"].alias("w"), size["h"].alias("h"))


@query("""SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS prompt FROM conversations GROUP BY 1""")
def prompt_merge(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.trim("text").alias("text"))
    return rows.groupBy("conv_id").agg(F.nullif(merges.join_ordered(rows, ["conv_id"], "turn", F.col("text"), "\n"), F.lit("")).alias("prompt"))


@query("""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, role FROM conversations),
p AS (SELECT conv_id, turn, t AS p, CASE WHEN role = 'assistant' THEN '2:' || t ELSE '' END AS p2 FROM c)
SELECT conv_id, CASE WHEN bool_or(p2 <> '') THEN string_agg(CASE WHEN p2 <> '' THEN p2 ELSE p END, chr(10) ORDER BY turn) FILTER (CASE WHEN p2 <> '' THEN p2 ELSE p END <> '') END AS prompt_2 FROM p GROUP BY 1""")
def prompt_fallback(spark, d):
    t = F.col("text")
    rows = read(spark, d, "conversations").select(
        "conv_id", "turn", t.alias("prompt"), F.when(F.col("role") == "assistant", F.concat(F.lit("2:"), T.strip(t))).alias("prompt_2"), F.lit("").alias("negative_prompt"), F.lit("").alias("negative_prompt_2")
    )
    return merges.merge_prompts(rows, ["conv_id"], "turn").select("conv_id", "prompt_2")


@query("""SELECT conv_id, count(*) AS n, coalesce(min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AND count(DISTINCT turn) = count(*), false) AS contiguous FROM conversations GROUP BY 1""")
def contiguity_check(spark, d):
    return merges.contiguous(read(spark, d, "conversations"), ["conv_id"], "turn")


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, 'img' || l_partkey AS a, 'sup' || l_suppkey AS b FROM lineitem),
n AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i, a, b) - 1 AS idx, a, b FROM l),
f AS (SELECT k, idx, 0 AS pos, a AS path FROM n UNION ALL SELECT k, idx, 1, b FROM n WHERE idx % 2 = 0)
SELECT k AS merge_id, row_number() OVER (PARTITION BY k ORDER BY idx, pos) - 1 AS ord, path FROM f""")
def ordered_list_merge(spark, d):
    rows = read(spark, d, "lineitem")
    a, b = F.concat(F.lit("img"), "l_partkey"), F.concat(F.lit("sup"), "l_suppkey")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", a, b)) - 1
    payload = rows.select(
        F.col("l_orderkey").alias("merge_id"), F.concat(F.lit("image:"), idx.cast("string")).alias("input_id"),
        F.when(idx % 2 == 1, a).alias("image"), F.when(idx % 2 == 0, F.array(a, b)).alias("images"), F.lit(None).cast("string").alias("path"),
    )
    return merges.merge_images(payload, ["merge_id"])


@query("""SELECT l_orderkey, count(*) AS n, min('p' || l_partkey) AS anchor, CASE WHEN count(*) = 1 THEN min('p' || l_partkey) END AS image,
CASE WHEN count(*) > 1 THEN string_agg('p' || l_partkey, ',' ORDER BY l_linenumber, 'p' || l_partkey, l_suppkey) END AS images FROM lineitem GROUP BY 1""")
def finalise_results(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.concat(F.lit("p"), "l_partkey").alias("path"), F.col("l_suppkey").alias("seed"))
    return merges.finalise(items, ["l_orderkey"]).select("l_orderkey", "n", "anchor", "image", F.array_join("images", ",").alias("images"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, regexp_replace(line, '^[ \\t\\r\\f\\v]+|[ \\t\\r\\f\\v]+$', '', 'g') AS line FROM p)
SELECT doc_id, md5(coalesce(string_agg(line, '|' ORDER BY i) FILTER (line <> ''), '')) AS digest FROM s GROUP BY 1""")
def norm_prompt_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.norm_prompt_list(F.split("text", "\n"), "|")).alias("digest"))


@query("""WITH x AS (SELECT page_id, 'a {{img:k[' || page_id % 3 || ']}} b {{img:k[9]}} ' || url AS t FROM pages)
SELECT page_id, replace(replace(replace(t, '{{img:k[0]}}', '<img><|image_1|></img>'), '{{img:k[1]}}', '<img><|image_2|></img>'), '{{img:k[2]}}', '<img><|image_3|></img>') AS rendered FROM x""")
def token_render(spark, d):
    text = F.concat(F.lit("a {{img:k["), (F.col("page_id") % 3).cast("string"), F.lit("]}} b {{img:k[9]}} "), F.col("url"))
    return read(spark, d, "pages").select("page_id", T.render_tokens(text, F.array(*(F.lit(f"k[{i}]") for i in range(3)))).alias("rendered"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN text WHEN turn % 2 = 0 THEN 'spec' ELSE '' END AS prompt FROM conversations""")
def prompt_precedence(spark, d):
    up = F.when(F.col("role") == "user", F.col("text")).otherwise("")
    return read(spark, d, "conversations").select("conv_id", "turn", T.first_text(up, F.when(F.col("turn") % 2 == 0, "spec")).alias("prompt"))


@query("""SELECT * FROM (VALUES ('red', 255, 0, 0), ('#0f8', 0, 255, 136), ('#102030', 16, 32, 48), ('1, 2,255', 1, 2, 255), ('300,0,0', NULL, NULL, NULL), ('nope', NULL, NULL, NULL)) t(value, r, g, b)""")
def colour_parse(spark, d):
    rows = spark.createDataFrame([(v,) for v in ("red", "#0f8", "#102030", "1, 2,255", "300,0,0", "nope")], "value string")
    c = T.parse_colour(F.col("value"))
    return rows.select("value", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))


@query("""WITH w AS (SELECT n_nationkey AS id, n_regionkey AS ord, CASE WHEN n_nationkey % 2 = 0 THEN 'arms' ELSE n_name END AS word FROM nation),
t AS (SELECT 'arms' AS word, 0 AS pos, 'left-arm' AS label UNION ALL SELECT 'arms', 1, 'right-arm')
SELECT id, ord, coalesce(pos, 0) AS pos, coalesce(label, w.word) AS label FROM w LEFT JOIN t ON w.word = t.word""")
def alias_expansion(spark, d):
    word = F.when(F.col("n_nationkey") % 2 == 0, "arms").otherwise(F.col("n_name"))
    targets = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("ord"), word.alias("word"))
    table = spark.createDataFrame([("arms", 0, "left-arm"), ("arms", 1, "right-arm")], "word string, pos int, label string")
    return merges.expand_aliases(targets, table).select("id", "ord.ord", "ord.pos", "label")


# Embeddings -------------------------------------------------------------------------------------------

_COSINE = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, list_cosine_similarity(q.v, c.v) AS s FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
"""


def _sides(spark, d):
    rows = read(spark, d, "embeddings")
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), rows.select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("c"))


@query(_COSINE + "SELECT query_id, candidate_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, candidate_id) AS rank FROM p) WHERE rank <= 5")
def cosine_topk(spark, d):
    return embeddings.nearest(*_sides(spark, d), 5).select("query_id", "candidate_id", r6("similarity").alias("similarity"), "rank")


@query(_COSINE + "SELECT query_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, candidate_id) AS r FROM p) WHERE r = 1")
def cosine_top1(spark, d):
    return embeddings.nearest(*_sides(spark, d), 1).select("query_id", "candidate_id")


@query(_COSINE + "SELECT query_id, round(max(s), 6) AS similarity, round(greatest(0, least(1, max(s))), 6) AS score FROM p GROUP BY 1")
def max_ref_similarity(spark, d):
    return embeddings.best_match(*_sides(spark, d)).select("query_id", r6("similarity").alias("similarity"), r6("score").alias("score"))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM x GROUP BY 1, 2), z AS (SELECT label, sqrt(sum(m * m)) AS z FROM m GROUP BY 1)
SELECT label, i - 1 AS dim, n, round(m / z, 6) AS value FROM m JOIN z USING (label)""")
def mean_embedding_normalised(spark, d):
    rows = embeddings.mean_embedding(read(spark, d, "embeddings"), ["label"], "embedding")
    return rows.select("label", "n", F.posexplode("mean").alias("dim", "value")).select("label", F.col("dim").cast("long").alias("dim"), "n", r6("value").alias("value"))


@query("""SELECT p_partkey, f.i * 7 + r.i AS ord, f.v AS flip, r.v AS rotation FROM part, (VALUES (0, 'none'), (1, 'h'), (2, 'v'), (3, 'hv')) f(i, v),
(VALUES (0, -45), (1, -30), (2, -15), (3, 0), (4, 15), (5, 30), (6, 45)) r(i, v)""")
def image_variants(spark, d):
    rows = read(spark, d, "part").select("p_partkey")
    return embeddings.variants(rows, ["none", "h", "v", "hv"], [-45, -30, -15, 0, 15, 30, 45]).select("p_partkey", "ord", "flip", "rotation")


@query()
def kmeans_fixed_iter(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))
    out = clusters.kmeans(rows, [f"e{i}" for i in range(64)], "vec_id", 6, 4)
    return out.select("rank", "population", F.transform("centre", lambda v: F.round(v, 6)).alias("centre"))


# Boxes ------------------------------------------------------------------------------------------------

_BOX = "l_partkey % 50 AS x1, l_suppkey % 40 AS y1, l_partkey % 50 + 5 + l_quantity::INT % 20 AS x2, l_suppkey % 40 + 3 + l_linenumber * 4 AS y2"
_DET = f"SELECT l_orderkey AS image_id, l_linenumber AS ord, l_discount * 10 + l_tax AS score, {_BOX} FROM lineitem"


def _detections(spark, d):
    x, y = F.col("l_partkey") % 50, F.col("l_suppkey") % 40
    b = G.box(x, y, x + 5 + F.col("l_quantity").cast("int") % 20, y + 3 + F.col("l_linenumber") * 4)
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ord"), b.alias("box"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("score"), F.lit("person").alias("label"))


def _pick(order: str) -> str:
    return f"WITH b AS ({_DET}) SELECT image_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}, ord) AS r FROM b) WHERE r = 1"


@query(_pick("score DESC"))
def select_best(spark, d):
    return B.select(_detections(spark, d), "best").select("image_id", "ord")


@query(_pick("(x2 - x1) * (y2 - y1) DESC"))
def select_largest(spark, d):
    return B.select(_detections(spark, d), "largest").select("image_id", "ord")


@query(_pick("(0.5::DOUBLE * (x1 + x2) - 37.5) ** 2 + (0.5::DOUBLE * (y1 + y2) - 37.5) ** 2"))
def select_center(spark, d):
    return B.select(_detections(spark, d), "center", F.lit(75), F.lit(75)).select("image_id", "ord")


_IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"""


@query(f"""WITH d AS ({_DET}), p AS (SELECT a.image_id, a.ord AS a, b.ord AS b, ({_IOU})::DOUBLE AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
FROM d a JOIN d b ON a.image_id = b.image_id AND a.ord < b.ord) SELECT image_id, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i > 0""")
def iou_join(spark, d):
    rows = _detections(spark, d).select("image_id", F.col("ord").alias("a"), F.col("box").alias("p"))
    other = rows.select("image_id", F.col("a").alias("b"), F.col("p").alias("q"))
    return rows.join(other, "image_id").where("a < b").select("image_id", "a", "b", r6(G.iou(F.col("p"), F.col("q"))).alias("iou")).where("iou > 0")


@query(f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS r FROM ({_DET})),
k AS (SELECT image_id, 0::BIGINT AS r, [] :: STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, ord BIGINT)[] AS kept FROM (SELECT DISTINCT image_id FROM d)
 UNION ALL SELECT k.image_id, k.r + 1, CASE WHEN len(list_filter(k.kept, lambda a: ({_IOU}) > 0.7::DOUBLE * ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IOU}))) > 0 THEN k.kept
  ELSE list_append(k.kept, {{'x1': b.x1::BIGINT, 'y1': b.y1::BIGINT, 'x2': b.x2::BIGINT, 'y2': b.y2::BIGINT, 'ord': b.ord::BIGINT}}) END
 FROM k JOIN d b ON k.image_id = b.image_id AND b.r = k.r + 1),
z AS (SELECT image_id, arg_max(kept, r) AS kept FROM k GROUP BY 1)
SELECT image_id, unnest(kept).ord AS ord FROM z""")
def nms_sequential(spark, d):
    return B.suppress(_detections(spark, d)).select("image_id", F.col("ord").cast("long").alias("ord"))


@query(f"WITH d AS ({_DET}) SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM d GROUP BY 1")
def union_boxes(spark, d):
    return B.union(_detections(spark, d), ["image_id"]).select("image_id", "box.*")


@query(f"""WITH d AS ({_DET}), p AS (SELECT o_orderkey AS image_id, unnest([0, 11, 12, 23]) AS idx, o_custkey % 60 AS x, o_orderkey % 50 AS y FROM orders)
SELECT image_id, ord, count(*) FILTER (x >= x1 AND x < x2 AND y >= y1 AND y < y2) AS points FROM d JOIN p USING (image_id) GROUP BY 1, 2""")
def points_in_boxes(spark, d):
    points = read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.explode(F.array(*(F.lit(i) for i in (0, 11, 12, 23)))).alias("idx"), (F.col("o_custkey") % 60).alias("x"), (F.col("o_orderkey") % 50).alias("y"))
    inside = G.contains_point(F.col("box"), F.col("x"), F.col("y"))
    return _detections(spark, d).join(points, "image_id").groupBy("image_id", "ord").agg(F.count_if(inside).alias("points"))


@query(f"""WITH d AS ({_DET}), p AS (SELECT o_orderkey AS image_id, unnest([0, 11, 12, 23]) AS idx, o_custkey % 60 AS x, o_orderkey % 50 AS y FROM orders),
s AS (SELECT image_id, ord, x1, y1, x2, y2, count(*) FILTER (i AND idx IN (11, 12, 23, 24)) AS t, count(*) FILTER (i) AS n, count(*) FILTER (i AND idx <= 10) AS f
 FROM (SELECT d.*, idx, x >= x1 AND x < x2 AND y >= y1 AND y < y2 AS i FROM d JOIN p USING (image_id)) GROUP BY ALL)
SELECT image_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY t DESC, n DESC, f DESC, (x2 - x1) * (y2 - y1) DESC, ord) AS r FROM s) WHERE r = 1""")
def best_person_box(spark, d):
    points = read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.explode(F.array(*(F.lit(i) for i in (0, 11, 12, 23)))).alias("idx"), (F.col("o_custkey") % 60).alias("x"), (F.col("o_orderkey") % 50).alias("y"))
    return B.best_person(_detections(spark, d).select("image_id", "ord", "box"), points).select("image_id", "ord")


_BB = [
    ("a", 13, 7, "xyxy", ["25%", "25%", "50%", "50%"], [3, 1, 7, 4]), ("b", 20, 12, "xywh", ["-10%", "75%", "120%", "50%"], [-2, 9, 22, 15]),
    ("c", 20, 12, "xyl", ["0", "0", "100%"], [0, 0, 20, 20]), ("d", 20, 12, "xywh", ["1.5px", "2.5px", "3px", "4px"], [1, 2, 5, 7]),
]


@query("SELECT * FROM (VALUES ('a', 3, 1, 7, 4, 3, 1, 7, 4), ('b', -2, 9, 22, 15, 0, 9, 20, 12), ('c', 0, 0, 20, 20, 0, 0, 20, 12), ('d', 1, 2, 5, 7, 1, 2, 5, 7)) t(id, x1, y1, x2, y2, cx1, cy1, cx2, cy2)")
def bbox_convert(spark, d):
    rows = spark.createDataFrame([r[:5] for r in _BB], "id string, w int, h int, form string, v array<string>")
    made = F.lit(None)
    for form in ("xyxy", "xywh", "xyl"):
        made = F.when(F.col("form") == form, G.convert_bbox([F.get("v", F.lit(i)) for i in range(3 if form == "xyl" else 4)], form, F.col("w"), F.col("h"))).otherwise(made)
    rows = rows.select("id", "w", "h", made.alias("b"))
    clamped = G.clamp_bbox(F.col("b"), F.col("w"), F.col("h"))
    return rows.select("id", "b.*", *(clamped[c].alias("c" + c) for c in G.CORNERS))


@query("SELECT * FROM (VALUES ('0', 1.0::DOUBLE, 0.0::DOUBLE), ('0%', 1, 0), ('25%', 3, 3.25), ('2.5px', 2, 2.5), ('-25%', NULL, -3.25), ('-1.5px', NULL, -1.5), ('x', NULL, NULL)) t(expr, size, signed)")
def size_expr_resolve(spark, d):
    rows = spark.createDataFrame([(v,) for v in ("0", "0%", "25%", "2.5px", "-25%", "-1.5px", "x")], "expr string")
    e, r = F.col("expr"), F.lit(13)
    return rows.select("expr", G.size_expr(e, r, unitless=True).alias("size"), G.size_expr(e, r, None, True, True, False).alias("signed"))


@query(f"""WITH d AS ({_DET}), c AS (SELECT image_id, ord, x1, y1, least(70, x2) AS x2, least(70, y2) AS y2 FROM d),
g AS (SELECT *, round_even((x2 - x1) * 0.25::DOUBLE, 0)::INT AS dx, round_even((y2 - y1) * 0.25::DOUBLE, 0)::INT AS dy FROM c)
SELECT image_id, ord, greatest(0, x1 - dx) AS x1, greatest(0, y1 - dy) AS y1, least(70, x2 + dx) AS x2, least(70, y2 + dy) AS y2 FROM g""")
def bbox_expand(spark, d):
    b = G.expand_bbox(F.col("box"), F.lit(70), F.lit(70), 0.25)
    return _detections(spark, d).select("image_id", "ord", b.alias("b")).select("image_id", "ord", *(F.col(f"b.{c}").cast("long").alias(c) for c in G.CORNERS))


@query(f"""WITH r AS (SELECT *, (x2 - x1)::DOUBLE AS bw, (y2 - y1)::DOUBLE AS bh FROM ({_DET})),
s AS (SELECT *, least(greatest(bw, ceil(bh * (3 / 4.0::DOUBLE))), 80) AS cw, least(greatest(bh, ceil(bw / (3 / 4.0::DOUBLE))), 80) AS ch FROM r),
p AS (SELECT *, greatest(0, least(80 - cw, floor(0.5::DOUBLE * (x1 + x2) - cw / 2))) AS px, greatest(0, least(80 - ch, floor(0.5::DOUBLE * (y1 + y2) - ch / 2))) AS py FROM s),
q AS (SELECT *, greatest(x2 - cw, least(x1, px)) AS ax, greatest(y2 - ch, least(y1, py)) AS ay FROM p)
SELECT image_id, ord, ax::BIGINT AS x1, ay::BIGINT AS y1, (ax + cw)::BIGINT AS x2, (ay + ch)::BIGINT AS y2 FROM q""")
def bbox_to_ratio(spark, d):
    """Every box grown towards 3:4."""
    b = G.expand_to_ratio(F.col("box"), F.lit(80), F.lit(80), (3, 4))
    rows = _detections(spark, d).select("image_id", "ord", b.alias("b"))
    return rows.select("image_id", "ord", *(F.col(f"b.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("""SELECT p_partkey, CASE WHEN w >= h THEN greatest(8, (64 // 8) * 8) ELSE greatest(8, floor(round_even(w * (64::DOUBLE / h), 0) / 8) * 8) END::INT AS w,
CASE WHEN w >= h THEN greatest(8, floor(round_even(h * (64::DOUBLE / w), 0) / 8) * 8) ELSE 64 END::INT AS h FROM (SELECT p_partkey, 10 + p_partkey % 37 AS w, p_size AS h FROM part)""")
def long_side_resize(spark, d):
    s = G.long_side_size(10 + F.col("p_partkey") % 37, F.col("p_size"), 64)
    return read(spark, d, "part").select("p_partkey", s["w"].alias("w"), s["h"].alias("h"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 93.0 ELSE 50.0 END::DOUBLE AS x, CASE n_regionkey % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 74.0 ELSE 40.0 END::DOUBLE AS y FROM nation""")
def position_resolve(spark, d):
    px = F.when(F.col("n_nationkey") % 3 == 0, "left").when(F.col("n_nationkey") % 3 == 1, "right").otherwise("center")
    py = F.when(F.col("n_regionkey") % 3 == 0, "top").when(F.col("n_regionkey") % 3 == 1, "bottom").otherwise("center")
    p = G.position_xy(F.concat_ws("-", py, px), F.lit(100), F.lit(80), F.lit(12), F.lit(10), F.lit(5), F.lit(4))
    return read(spark, d, "nation").select("n_nationkey", p["x"].alias("x"), p["y"].alias("y"))


@query("SELECT * FROM (VALUES (0.0::DOUBLE, 0.1::DOUBLE), (6, 0.1), (30, 0.5), (60, 1.0), (70, 0.5), (80, 0.0), (-70, 0.5), (-30, 0.5)) t(yaw, weight)")
def yaw_weights(spark, d):
    rows = spark.createDataFrame([(float(v),) for v in (0, 6, 30, 60, 70, 80, -70, -30)], "yaw double")
    return rows.select("yaw", r6(S.yaw_weight(F.col("yaw"))).alias("weight"))


@query(f"""WITH d AS ({_DET}), s AS (SELECT image_id, ord, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) / 4900.0::DOUBLE AS a, (x1 <= 0)::INT + (y1 <= 0)::INT + (x2 >= 70)::INT + (y2 >= 70)::INT AS t FROM d)
SELECT image_id, ord, round(0.45::DOUBLE * least(1, least(w, h) / 96.0::DOUBLE) + 0.35::DOUBLE * CASE WHEN a < 0.01 THEN a / 0.01 WHEN a > 0.45 THEN greatest(0, 1 - (a - 0.45) / 0.35) ELSE 1 END
+ 0.2::DOUBLE * CASE t WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.45 WHEN 3 THEN 0.2 ELSE 0 END, 8)::DOUBLE AS score FROM s""")
def face_size(spark, d):
    return _detections(spark, d).select("image_id", "ord", F.round(S.face_size_score(F.col("box"), F.lit(70), F.lit(70)), 8).alias("score"))


# Sequences --------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, ts, value, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN abs(value - p) > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, run::BIGINT AS run, count(*) AS length, round(avg(value), 6) AS mean FROM r GROUP BY 1, 2 HAVING count(*) >= 2""")
def chromatic_runs(spark, d):
    """Gaps and islands: a run ends where the value jumps."""
    w = Q.window_of(["user_id"], ["ts", "event_id"])
    rows = Q.split_runs(read(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], F.abs(F.col("value") - F.lag("value").over(w)) > 20)
    return rows.groupBy("user_id", "run").agg(F.count("*").alias("length"), r6(F.avg("value")).alias("mean")).where("length >= 2")


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
o AS (SELECT a.user_id, a.event_id, b.value FROM e a, (VALUES (-2), (-1), (0), (1), (2)) k(k) JOIN e b ON b.user_id = a.user_id AND b.i = greatest(1, least(a.n, a.i + k.k)))
SELECT user_id, event_id, round(median(value), 6) AS smooth FROM o GROUP BY 1, 2""")
def median_smooth_padded(spark, d):
    rows = read(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return Q.median_smooth(rows, ["user_id"], "i", "value", 5).select("user_id", "event_id", r6("smooth").alias("smooth"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, value::DOUBLE AS ema FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, 0.6::DOUBLE * r.ema + (1 - 0.6::DOUBLE) * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, round(ema, 6) AS ema FROM r""")
def ema_state(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return Q.moving_average(rows, ["user_id"], ["ts", "event_id"], "value", 0.6).select("user_id", "event_id", r6("ema").alias("ema"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM e WHERE n <= 4 OR i IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1)""")
def sample_evenly(spark, d):
    return Q.sample_evenly(read(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 4).select("user_id", "event_id")


@query("""WITH p AS (SELECT p_partkey, 64 + p_partkey % 500 AS length FROM part)
SELECT p_partkey, unnest(CASE WHEN length <= 100 THEN [0] ELSE list_sort(list_distinct(list_append(range(0, length - 99, 50), length - 100))) END) AS start FROM p""")
def tile_starts(spark, d):
    rows = read(spark, d, "part").select("p_partkey", (64 + F.col("p_partkey") % 500).cast("int").alias("length"))
    return rows.select("p_partkey", F.explode(Q.tile_starts(F.col("length"), 100, 0.5)).alias("start")).select("p_partkey", F.col("start").cast("long").alias("start"))


@query("""WITH p AS (SELECT p_partkey, 50 + p_partkey % 60 AS w, 40 + p_size AS h FROM part), s AS (SELECT *, greatest(1, round_even(w * 0.5::DOUBLE, 0)::INT) AS ww, greatest(1, round_even(h * 0.5::DOUBLE, 0)::INT) AS wh FROM p)
SELECT p_partkey, r * 3 + c AS ord, round_even((w - ww) * c / 2.0::DOUBLE, 0)::INT AS x1, round_even((h - wh) * r / 1.0::DOUBLE, 0)::INT AS y1 FROM s, range(3) a(c), range(2) b(r)""")
def sliding_windows(spark, d):
    frames = read(spark, d, "part").select("p_partkey", (50 + F.col("p_partkey") % 60).cast("int").alias("w"), (40 + F.col("p_size")).alias("h"))
    return Q.sliding_windows(frames, 3, 2).select("p_partkey", F.col("ord").cast("long").alias("ord"), F.col("box.x1").alias("x1"), F.col("box.y1").alias("y1"))


@query("SELECT * FROM (VALUES (1, 0, 0, 50, 100, 100), (1, 1, 0, 100, 100, 150), (2, 0, 45, 0, 70, 50), (2, 1, 25, 0, 55, 50), (2, 2, 10, 0, 35, 50)) t(id, ord, x1, y1, x2, y2)")
def band_segments(spark, d):
    rows = spark.createDataFrame(
        [(1, 100, 200, "y", "25%", "75%", 2, "0", "forward"), (2, 100, 50, "x", "10", "70", 3, "5", "reverse")],
        "id int, w int, h int, axis string, start string, `end` string, segments int, overlap string, `order` string",
    )
    return Q.bands(rows).select("id", "ord", "box.*")


@query("SELECT event_id, round_even(event_id * 1000 / 24.0::DOUBLE, 0)::BIGINT AS ms FROM events")
def frame_times(spark, d):
    return read(spark, d, "events").select("event_id", Q.frame_time(F.col("event_id"), F.lit(24.0)).alias("ms"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS k, l_quantity AS v, l_discount * 3.7::DOUBLE AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount) AS i FROM lineitem),
f AS (SELECT DISTINCT k, 0::BIGINT AS i, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a FROM l
UNION ALL SELECT l.k, l.i, CASE WHEN l.a + f.a * (1 - l.a) = 0 THEN 0 ELSE (l.v * l.a + f.v * f.a * (1 - l.a)) / (l.a + f.a * (1 - l.a)) END, l.a + f.a * (1 - l.a) FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1)
SELECT k AS l_orderkey, round(arg_max(v, i), 6) AS value, round(arg_max(a, i), 6) AS alpha FROM f GROUP BY 1""")
def layer_fold(spark, d):
    layers = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("value"), (F.col("l_discount") * 3.7).alias("alpha"))
    return Q.fold_layers(layers, ["l_orderkey"]).select("l_orderkey", r6("value").alias("value"), r6("alpha").alias("alpha"))


# Pixels and masks -------------------------------------------------------------------------------------

_W = _H = 24
_MASK = "SELECT DISTINCT (l_orderkey // 4000) * 10 + l_linenumber AS mask_id, (l_partkey * 7 + l_suppkey) % 24 AS x, (l_orderkey + l_partkey) % 24 AS y FROM lineitem WHERE l_quantity < {q}"


def _mask(spark, d, q):
    """Masks from all line items: each run of 4000 order keys gives masks of its own, so that none fills up with the table."""
    rows = read(spark, d, "lineitem").where(F.col("l_quantity") < q)
    x, y = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % _W, (F.col("l_orderkey") + F.col("l_partkey")) % _H
    mask_id = F.floor(F.col("l_orderkey") / 4000) * 10 + F.col("l_linenumber")
    return rows.select(mask_id.alias("mask_id"), x.cast("int").alias("x"), y.cast("int").alias("y")).distinct()


def _set_sql(op: str) -> str:
    return f"SELECT mask_id, count(*) AS n, sum(x * 100 + y) AS digest FROM (({_MASK.format(q=10)}) {op} ({_MASK.format(q=4)})) GROUP BY 1"


def _digest(df):
    return df.groupBy("mask_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * 100 + F.col("y")).alias("digest"))


@query(_set_sql("UNION"))
def mask_union(spark, d):
    return _digest(masks.unite(_mask(spark, d, 10), _mask(spark, d, 4)))


@query(_set_sql("INTERSECT"))
def mask_intersection(spark, d):
    return _digest(masks.intersect(_mask(spark, d, 10), _mask(spark, d, 4)))


@query(_set_sql("EXCEPT"))
def mask_difference(spark, d):
    return _digest(masks.subtract(_mask(spark, d, 10), _mask(spark, d, 4)))


@query(f"WITH a AS ({_MASK.format(q=10)}), b AS ({_MASK.format(q=4)}) SELECT a.mask_id, round(count(b.x) / count(*)::DOUBLE, 6) AS coverage FROM a LEFT JOIN b USING (mask_id, x, y) GROUP BY 1")
def mask_coverage(spark, d):
    return masks.coverage(_mask(spark, d, 10), _mask(spark, d, 4)).select("mask_id", r6("coverage").alias("coverage"))


@query(f"WITH m AS ({_MASK.format(q=3)}) SELECT mask_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS area, 0.5 * (min(x) + max(x) + 1)::DOUBLE AS centre_x FROM m GROUP BY 1")
def mask_bbox(spark, d):
    return masks.tight_box(_mask(spark, d, 3)).select("mask_id", "box.*", "area", "centre_x")


@query(f"WITH m AS ({_MASK.format(q=3)}) SELECT DISTINCT mask_id, (x // 6) * 4 + y // 6 AS label FROM m WHERE (x // 6) * 4 + y // 6 > 0")
def touched_labels(spark, d):
    mask = _mask(spark, d, 3)
    labels = masks.grid(spark.createDataFrame([(0,)], "mask_id int"), _W, _H).select("x", "y", (F.floor(F.col("x") / 6) * 4 + F.floor(F.col("y") / 6)).alias("label"))
    return masks.touched_labels(labels, mask)


@query(f"""WITH m AS ({_MASK.format(q=3)}), s AS (SELECT mask_id, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM m GROUP BY 1)
SELECT mask_id, round(degrees(0.5 * atan2(2 * c, a - b)), 6) AS angle FROM s""")
def pca_angle(spark, d):
    return masks.pca_angle(_mask(spark, d, 3)).select("mask_id", r6("angle").alias("angle"))


@query(f"""WITH RECURSIVE m AS (SELECT * FROM ({_MASK.format(q=2)})), e AS (SELECT a.mask_id, a.x AS ax, a.y AS ay, b.x AS nx, b.y AS ny FROM m a JOIN m b ON a.mask_id = b.mask_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
c AS (SELECT mask_id, x, y, x AS sx, y AS sy FROM m UNION SELECT mask_id, nx, ny, sx, sy FROM c JOIN e USING (mask_id) WHERE c.x = ax AND c.y = ay)
SELECT mask_id, x, y, min(sy * 1048576 + sx) AS label FROM c GROUP BY 1, 2, 3""")
def connected_components(spark, d):
    return masks.components(_mask(spark, d, 2)).select("mask_id", "x", "y", "label")


@query(f"""WITH RECURSIVE m AS ({_MASK.format(q=40)}), g AS (SELECT mask_id, gx.x, gy.y FROM (SELECT DISTINCT mask_id FROM m), (SELECT unnest(range(24)) AS x) gx, (SELECT unnest(range(24)) AS y) gy),
bg AS (SELECT * FROM g ANTI JOIN m USING (mask_id, x, y)), e AS (SELECT a.mask_id, a.x AS ax, a.y AS ay, b.x AS nx, b.y AS ny FROM bg a JOIN bg b ON a.mask_id = b.mask_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
c AS (SELECT mask_id, x, y, x AS sx, y AS sy FROM bg UNION SELECT mask_id, nx, ny, sx, sy FROM c JOIN e USING (mask_id) WHERE c.x = ax AND c.y = ay),
l AS (SELECT mask_id, x, y, min(sy * 1048576 + sx) AS label FROM c GROUP BY 1, 2, 3),
h AS (SELECT mask_id, label FROM l GROUP BY 1, 2 HAVING count(*) <= 6 AND min(x) > 0 AND min(y) > 0 AND max(x) < 23 AND max(y) < 23),
f AS (SELECT * FROM m UNION SELECT mask_id, x, y FROM l SEMI JOIN h USING (mask_id, label)), k AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy)),
o AS (SELECT DISTINCT mask_id, x + dx AS x, y + dy AS y FROM (SELECT * FROM g ANTI JOIN f USING (mask_id, x, y)), k), r AS (SELECT * FROM f ANTI JOIN o USING (mask_id, x, y)),
w AS (SELECT DISTINCT mask_id, x + dx AS x, y + dy AS y FROM r, k WHERE x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23),
n AS (SELECT a.mask_id, a.x, a.y, b.x AS nx, b.y AS ny FROM w a JOIN w b ON a.mask_id = b.mask_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
n2 AS (SELECT DISTINCT a.mask_id, a.x, a.y, b.nx, b.ny FROM n a JOIN n b ON a.mask_id = b.mask_id AND a.nx = b.x AND a.ny = b.y),
n3 AS (SELECT DISTINCT a.mask_id, a.x, a.y, b.nx, b.ny FROM n2 a JOIN n b ON a.mask_id = b.mask_id AND a.nx = b.x AND a.ny = b.y),
z AS (SELECT mask_id, x, y FROM n3 GROUP BY 1, 2, 3 HAVING count(*) > 3) SELECT mask_id, count(*) AS n, sum(x * 100 + y) AS digest FROM z GROUP BY 1""")
def mask_cleanup(spark, d):
    """Holes, opening and small components, as a digest by mask."""
    return _digest(masks.cleanup(_mask(spark, d, 40), _W, _H, 6, 1, 3))


@query(f"""WITH RECURSIVE m AS ({_MASK.format(q=3)}), e AS (SELECT a.mask_id, a.x AS ax, a.y AS ay, b.x AS nx, b.y AS ny FROM m a JOIN m b ON a.mask_id = b.mask_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
c AS (SELECT mask_id, x, y, x AS sx, y AS sy FROM m UNION SELECT mask_id, nx, ny, sx, sy FROM c JOIN e USING (mask_id) WHERE c.x = ax AND c.y = ay),
l AS (SELECT mask_id, x, y, min(sy * 1048576 + sx) AS label FROM c GROUP BY 1, 2, 3), r AS (SELECT mask_id, label, row_number() OVER (PARTITION BY mask_id ORDER BY count(*) DESC, label) AS r FROM l GROUP BY 1, 2)
SELECT mask_id, count(*) AS n, sum(x * 100 + y) AS digest FROM l JOIN r USING (mask_id, label) WHERE r <= 2 GROUP BY 1""")
def largest_components(spark, d):
    return _digest(masks.keep_largest(_mask(spark, d, 3), 2))


@query(f"""WITH m AS ({_MASK.format(q=12)}), k AS (SELECT unnest(range(25)) AS k), i AS (SELECT DISTINCT mask_id FROM m),
p AS (SELECT i.mask_id, a.k AS x, b.k AS y, count(m.x) AS n FROM i CROSS JOIN k a CROSS JOIN k b LEFT JOIN m ON m.mask_id = i.mask_id AND m.x < a.k AND m.y < b.k GROUP BY 1, 2, 3),
s AS (SELECT a.mask_id, a.y, a.x AS x1, b.x AS x2, b.n - a.n AS n FROM p a JOIN p b ON a.mask_id = b.mask_id AND a.y = b.y AND a.x < b.x),
r AS (SELECT u.mask_id, u.x1, u.y AS y1, u.x2, v.y AS y2, v.n - u.n AS n FROM s u JOIN s v ON u.mask_id = v.mask_id AND u.x1 = v.x1 AND u.x2 = v.x2 AND u.y < v.y),
o AS (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY n DESC, y2, x2, y2 - y1 DESC) AS o FROM r WHERE n = (x2 - x1) * (y2 - y1)) SELECT mask_id, x1, y1, x2, y2 FROM o WHERE o = 1""")
def largest_rectangle(spark, d):
    return masks.largest_rectangle(_mask(spark, d, 12))


@query(f"""WITH m AS ({_MASK.format(q=3)}) SELECT DISTINCT mask_id, x + dx AS x, y + dy AS y FROM m, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) k(dx, dy) WHERE x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 23""")
def mask_dilate(spark, d):
    return masks.dilate(_mask(spark, d, 3), 1, _W, _H)


_PIX = "SELECT l_orderkey, l_linenumber, (l_quantity * 5)::INT AS r, (l_discount * 2500)::INT AS g, (l_tax * 3000)::INT AS b FROM lineitem"


def _pixels(spark, d):
    byte = lambda c, f: F.round(F.col(c) * f).cast("int")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", byte("l_quantity", 5).alias("r"), byte("l_discount", 2500).alias("g"), byte("l_tax", 3000).alias("b"))


_Y = "((r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) / 255.0::DOUBLE)"


@query(f"SELECT l_orderkey, l_linenumber, round({_Y}, 6) AS luma, 255 - r AS inverted, abs(tr - (r * (1 - {_Y} * 0.5) + {_Y} * 0.5 * 200)) <= 0.5000001 AS tinted FROM (SELECT *, round_even(r * (1 - {_Y} * 0.5) + {_Y} * 0.5 * 200, 0) AS tr FROM ({_PIX}))")
def luma_tint(spark, d):
    r, g, b = (F.col(c) for c in "rgb")
    t = C.tint(r, g, b, (200, 100, 50), 0.5)
    exact = r * (1 - C.luminance(r, g, b) * 0.5) + C.luminance(r, g, b) * 0.5 * 200
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", r6(C.luminance(r, g, b)).alias("luma"), C.invert(r).alias("inverted"), (F.abs(t["r"] - exact) <= 0.5000001).alias("tinted"))


def _lab_sql() -> str:
    lin = lambda c: f"(CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END)"
    f = lambda x: f"(CASE WHEN {x} > 0.008856 THEN cbrt({x}) ELSE 7.787 * {x} + 16.0 / 116.0 END)"
    xyz = ", ".join(f"({' + '.join(f'{m} * l{c}' for m, c in zip(row, 'rgb'))}) / {w} AS {n}" for row, w, n in zip(C.TO_XYZ, C.WHITE, "xyz"))
    return f"""WITH p AS ({_PIX}), l AS (SELECT *, {lin('r')} AS lr, {lin('g')} AS lg, {lin('b')} AS lb FROM p), x AS (SELECT *, {xyz} FROM l)
SELECT l_orderkey, l_linenumber, round(116 * {f('y')} - 16, 4)::DOUBLE AS lightness, round(500 * ({f('x')} - {f('y')}), 4)::DOUBLE AS a, round(200 * ({f('y')} - {f('z')}), 4)::DOUBLE AS b FROM x"""


@query(_lab_sql())
def lab_convert(spark, d):
    lab = C.to_lab(F.col("r"), F.col("g"), F.col("b"))
    return _pixels(spark, d).select("l_orderkey", "l_linenumber", *(F.round(lab[k], 4).alias(n) for k, n in (("l", "lightness"), ("a", "a"), ("b", "b"))))


@query(f"""WITH p AS ({_PIX}), s AS (SELECT l_linenumber, avg(r) AS m, stddev_pop(r) AS sd, avg(g) AS tm, stddev_pop(g) AS tsd FROM p GROUP BY 1)
SELECT l_orderkey, l_linenumber, round((r - m) * (tsd / (sd + 1e-6)) + tm, 4) AS matched FROM p JOIN s USING (l_linenumber)""")
def color_match_stats(spark, d):
    """A channel moved to the mean and spread of another, per image."""
    from .operators import anatomy

    matched = anatomy.colour_match(_pixels(spark, d), ["r"], ["g"], ["l_linenumber"], ["matched"])
    return matched.select("l_orderkey", "l_linenumber", F.round("matched", 4).alias("matched"))


@query(f"WITH m AS ({_MASK.format(q=3)}) SELECT mask_id, 23 - x AS fx, y AS fy, 23 - y AS tx, x AS ty FROM m")
def flip_and_turn(spark, d):
    m = _mask(spark, d, 3).select("mask_id", "x", "y", F.col("x").alias("ox"), F.col("y").alias("oy"))
    flipped = masks.flip(m, _W, _H, horizontal=True).select("mask_id", F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("ox").alias("x"), F.col("oy").alias("y"))
    turned = masks.quarter_turn(flipped, _H)
    return turned.select("mask_id", "fx", "fy", F.col("x").alias("tx"), F.col("y").alias("ty"))


@query("""WITH t AS (SELECT p_partkey % 3 AS image_id, p_partkey AS triangle, (p_partkey * 3 % 20)::DOUBLE AS x0, (p_partkey * 5 % 20)::DOUBLE AS y0, (p_partkey * 7 % 20)::DOUBLE AS x1, (p_partkey * 11 % 20)::DOUBLE AS y1,
(p_partkey * 13 % 20)::DOUBLE AS x2, (p_partkey * 17 % 20)::DOUBLE AS y2, 1.0::DOUBLE + p_partkey * 2 % 9 AS z0, 1.0::DOUBLE + p_partkey * 4 % 9 AS z1, 1.0::DOUBLE + p_partkey * 8 % 9 AS z2 FROM part),
d AS (SELECT *, (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) AS det FROM t),
c AS (SELECT d.*, gx.x, gy.y, ((y1 - y2) * (gx.x - x2) + (x2 - x1) * (gy.y - y2)) / det AS a, ((y2 - y0) * (gx.x - x2) + (x0 - x2) * (gy.y - y2)) / det AS b
FROM d, (SELECT unnest(range(20)) AS x) gx, (SELECT unnest(range(20)) AS y) gy WHERE abs(det) > 1e-12),
f AS (SELECT *, 1 / (a / z0 + b / z1 + (1 - a - b) / z2) AS depth FROM c WHERE a >= -1e-6 AND b >= -1e-6 AND 1 - a - b >= -1e-6),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY round(depth, 9), triangle) AS r FROM f WHERE depth > 0) SELECT image_id, x, y, triangle, round(depth, 6) AS depth FROM r WHERE r = 1""")
def depth_raster(spark, d):
    rows = read(spark, d, "part")
    k = F.col("p_partkey")
    tri = rows.select(
        (k % 3).alias("image_id"), k.alias("triangle"), *((k * a % 20).cast("double").alias(n) for n, a in (("x0", 3), ("y0", 5), ("x1", 7), ("y1", 11), ("x2", 13), ("y2", 17))),
        *((1.0 + k * a % 9).alias(n) for n, a in (("z0", 2), ("z1", 4), ("z2", 8))),
    )
    return masks.nearest_depth(masks.rasterise(tri).withColumn("depth", F.round("depth", 9))).select("image_id", "x", "y", "triangle", r6("depth").alias("depth"))


# Landmarks --------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey AS subject, l_linenumber AS idx, l_discount * 10 AS score, l_tax > 0.02 AS seen, l_quantity AS w FROM lineitem)
SELECT subject, round(CASE WHEN coalesce(sum(w) FILTER (seen), 0) > 1e-8 THEN sum(w * score) FILTER (seen) / sum(w) FILTER (seen) ELSE 0 END, 6) AS score FROM s GROUP BY 1""")
def landmark_weighted_parts(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("part"), (F.col("l_discount") * 10).alias("score"), (F.col("l_tax") > 0.02).alias("observable"), F.col("l_quantity").alias("weight"))
    return landmarks.weighted_parts(rows).select("subject", r6("score").alias("score"))


def _landmarks(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("subject"), F.col("l_linenumber").alias("idx")).agg(
        F.min("l_quantity").alias("x"), (F.min("l_discount") * 100).alias("y"), (F.min("l_tax") * 100).alias("z"), (F.min("l_tax") > 0.01).alias("valid")
    )


_LM = "WITH m AS (SELECT l_orderkey AS subject, l_linenumber AS idx, min(l_quantity) AS x, min(l_discount) * 100 AS y, min(l_tax) * 100 AS z, min(l_tax) > 0.01 AS valid FROM lineitem GROUP BY 1, 2)"


@query(_LM + """, p AS (SELECT a.subject, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS g FROM m a JOIN m b ON a.subject = b.subject AND a.idx < b.idx WHERE a.valid AND b.valid)
SELECT subject, round(avg(g), 6) AS distance FROM p GROUP BY 1""")
def mean_pair_distance(spark, d):
    return landmarks.mean_pair_distance(_landmarks(spark, d)).select("subject", r6("distance").alias("distance"))


@query(_LM + """, w AS (SELECT subject, max({'x': x, 'y': y, 'z': z, 'v': valid}) FILTER (idx = 1) AS a, max({'x': x, 'y': y, 'z': z, 'v': valid}) FILTER (idx = 2) AS b,
max({'x': x, 'y': y, 'z': z, 'v': valid}) FILTER (idx = 3) AS c FROM m GROUP BY 1),
l AS (SELECT subject, CASE WHEN a.v AND b.v THEN sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) END AS p, CASE WHEN b.v AND c.v THEN sqrt((b.x - c.x) ** 2 + (b.y - c.y) ** 2 + (b.z - c.z) ** 2) END AS q
FROM w WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL), t AS (SELECT subject, CASE WHEN q > 1e-8 THEN p / q END AS r FROM l)
SELECT subject, round(CASE WHEN r IS NULL THEN 0.5 ELSE least(1, greatest(0, 1 - (abs(r - 1) - 0.35) / 0.65)) END, 6)::DOUBLE AS score FROM t""")
def symmetry_score(spark, d):
    return landmarks.symmetry_score(_landmarks(spark, d), (1, 2), (2, 3)).select("subject", r6("score").alias("score"))


@query("""WITH s AS (SELECT l_linenumber AS source_id, l_partkey % 20 AS idx, min(l_quantity) AS x, min(l_discount) AS y, min(l_tax) AS z, abs(l_linenumber * 12.0::DOUBLE - 20) AS turn FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN turn >= 80 THEN 0 ELSE greatest(0.1::DOUBLE, CASE WHEN turn <= 60 THEN turn / 60 ELSE (80 - turn) / 20 END) END AS w FROM s), z AS (SELECT idx, sum(z * w) / nullif(sum(w), 0) AS z FROM w GROUP BY 1),
b AS (SELECT source_id FROM w ORDER BY turn, source_id LIMIT 1) SELECT idx, s.x, s.y, round(coalesce(z.z, s.z), 6) AS z FROM s JOIN b USING (source_id) JOIN z USING (idx)""")
def depth_fusion(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("source_id"), (F.col("l_partkey") % 20).alias("idx")).agg(
        F.min("l_quantity").alias("x"), F.min("l_discount").alias("y"), F.min("l_tax").alias("z")
    ).withColumn("yaw", F.col("source_id") * 12.0 - 20.0)
    return landmarks.fuse_depth(rows).select("idx", "x", "y", r6("z").alias("z"))


@query("""SELECT DISTINCT l_linenumber, 2.0::DOUBLE AS scale, 1.0::DOUBLE AS shift_x, 0.0::DOUBLE AS shift_y, -3.0::DOUBLE AS shift_z FROM lineitem""")
def landmark_similarity(spark, d):
    """Points moved by a known similarity; the twin states it."""
    rows = read(spark, d, "lineitem").select("l_linenumber", *(F.col(c).alias(n) for c, n in (("l_quantity", "sx"), ("l_discount", "sy"), ("l_tax", "sz"))))
    rows = rows.withColumns({"tx": 2 * F.col("sy") + 1, "ty": -2 * F.col("sx"), "tz": 2 * F.col("sz") - 3})
    return landmarks.similarity(rows, ["l_linenumber"]).select("l_linenumber", r6("scale").alias("scale"), *((F.round(F.col("shift")[i], 4) + 0.0).alias(f"shift_{c}") for i, c in enumerate("xyz")))


# Graphs as tables -------------------------------------------------------------------------------------

_EDGES = """WITH node AS (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region),
edge AS (SELECT 'r' || n_regionkey AS node_from, 'n' || n_nationkey AS node_to, 'default' AS input_id FROM nation
UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 5), CASE WHEN n_nationkey % 4 = 0 THEN 'default' ELSE 'side' END FROM nation)"""


def _graph(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    n, r = lambda c: F.concat(F.lit("n"), c.cast("string")), lambda c: F.concat(F.lit("r"), c.cast("string"))
    k = F.col("n_nationkey")
    node = nation.select(n(k).alias("id")).union(region.select(r(F.col("r_regionkey")).alias("id")))
    edge = nation.select(r(F.col("n_regionkey")).alias("node_from"), n(k).alias("node_to"), F.lit("default").alias("input_id"))
    return node, edge.union(nation.select(n(k), n(k + 5), F.when(k % 4 == 0, "default").otherwise("side")))


@query(_EDGES + " SELECT id, 'entry' AS kind FROM node WHERE id NOT IN (SELECT node_to FROM edge) UNION ALL SELECT id, 'output' FROM node WHERE id NOT IN (SELECT node_from FROM edge)")
def dag_entry_out(spark, d):
    node, edge = _graph(spark, d)
    return graph.entry_nodes(node, edge).withColumn("kind", F.lit("entry")).union(graph.output_nodes(node, edge).withColumn("kind", F.lit("output")))


@query(_EDGES.replace("WITH", "WITH RECURSIVE", 1) + ", c AS (SELECT 'r1' AS id UNION SELECT node_to FROM c JOIN edge ON id = node_from) SELECT id FROM c")
def dag_closure(spark, d):
    _, edge = _graph(spark, d)
    return graph.closure(edge, spark.createDataFrame([("r1",)], "id string"))


@query(_EDGES + " SELECT node_to, input_id, count(*) AS n FROM edge GROUP BY 1, 2 HAVING count(*) > 1")
def dag_duplicate_input(spark, d):
    return graph.doubled_inputs(_graph(spark, d)[1])


@query(_EDGES + " SELECT DISTINCT id FROM (SELECT node_from AS id FROM edge UNION SELECT node_to FROM edge) WHERE id NOT IN (SELECT id FROM node)")
def dag_missing_endpoint(spark, d):
    return graph.missing_endpoints(*_graph(spark, d))


@query(_EDGES + " SELECT node_to AS id, count(*) AS n_inputs FROM edge GROUP BY 1 HAVING bool_and(node_from LIKE 'r%')")
def dag_ready_nodes(spark, d):
    node, edge = _graph(spark, d)
    return graph.ready_nodes(edge, node.where(F.col("id").startswith("r")))


# State ------------------------------------------------------------------------------------------------


@query()
def greedy_track(spark, d):
    """Events as detections: a user's group is a clip, the hour is the frame."""
    rows = read(spark, d, "events").select(
        (F.col("user_id") % 50).alias("clip"), F.floor(F.unix_timestamp("ts") / 3600).alias("frame"), F.col("event_id").alias("ord"),
        (F.col("value") % 10 / 10).alias("x"), (F.col("event_id") % 7 / 7.0).alias("y"),
    )
    return state.track(rows, state.TrackerConfig(hold=1)).select("clip", "frame", "track", r6("x").alias("x"), r6("y").alias("y"), "missed")


@query("""SELECT user_id % 50 AS clip, event_id % 5 AS frame, round(quantile_cont(value, 0.02), 6) AS lo, round(quantile_cont(value, 0.98), 6) AS hi FROM events GROUP BY 1, 2""")
def depth_percentiles(spark, d):
    rows = read(spark, d, "events").select((F.col("user_id") % 50).alias("clip"), (F.col("event_id") % 5).alias("frame"), F.col("value").alias("depth"))
    return state.depth_ranges(rows).select("clip", "frame", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("""WITH RECURSIVE r AS (SELECT user_id % 50 AS clip, event_id % 5 AS frame, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame) AS i FROM r),
s AS (SELECT clip, frame, i, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM n WHERE i = 1 UNION ALL SELECT n.clip, n.frame, n.i, 0.9::DOUBLE * s.lo + 0.1::DOUBLE * n.lo, 0.9::DOUBLE * s.hi + 0.1::DOUBLE * n.hi FROM s JOIN n ON n.clip = s.clip AND n.i = s.i + 1)
SELECT clip, frame, event_id, round(greatest(0, least(1, (value - lo) / greatest(hi - lo, 1e-6))), 6) AS norm FROM events e JOIN s ON s.clip = e.user_id % 50 AND s.frame = e.event_id % 5""")
def depth_normalised(spark, d):
    rows = read(spark, d, "events").select((F.col("user_id") % 50).alias("clip"), (F.col("event_id") % 5).alias("frame"), "event_id", F.col("value").alias("depth"))
    return state.normalise_depth(rows, "running").select("clip", "frame", "event_id", r6("norm").alias("norm"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_more, queries_wiring  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries_more, queries_wiring  # noqa: F401

    return dict(_SQL)
