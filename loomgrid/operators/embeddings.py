"""Embedding retrieval, identity scores and aggregation over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from .rank import top_k

#: A set of queries is broadcast up to this many rows and compared in blocks beyond.
QUERY_BLOCK = 4096


def _blocks(queries: DataFrame, key: str) -> list[DataFrame]:
    n = queries.count()
    if n <= QUERY_BLOCK:
        return [queries]
    parts = -(-n // QUERY_BLOCK)
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def similarities(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, candidate_id, similarity): cosine of each query (query_id, q) with each candidate (candidate_id, c).

    Lengths are computed once per vector. A block of queries has a bounded, counted size; each block
    is broadcast to the candidates.
    """
    left = queries.select("query_id", F.transform("q", lambda v: v.cast("double")).alias("q"), S.norm(F.col("q")).alias("qn"))
    right = candidates.select("candidate_id", F.transform("c", lambda v: v.cast("double")).alias("c"), S.norm(F.col("c")).alias("cn"))
    out = None
    for block in _blocks(left, "query_id"):
        pairs = right.join(F.broadcast(block), F.col("candidate_id") != F.col("query_id"))
        made = pairs.select("query_id", "candidate_id", F.try_divide(S.dot(F.col("q"), F.col("c")), F.col("qn") * F.col("cn")).alias("similarity"))
        out = made if out is None else out.unionByName(made)
    return out


def nearest(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar candidates of each query with their rank; equals by candidate id."""
    pairs = similarities(queries, candidates).withColumn("_s", F.round("similarity", 9))
    return top_k(pairs, ["query_id"], [F.desc("_s"), F.asc("candidate_id")], k).drop("_s")


def best_match(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, similarity, score): the largest cosine with any reference, and that in [0, 1]."""
    pairs = similarities(queries, references)
    return pairs.groupBy("query_id").agg(F.max("similarity").alias("similarity")).withColumn("score", S.clamp01(F.col("similarity")))


def mean_embedding(vectors: DataFrame, keys: list[str], column: str, normalise: bool = True, eps: float = 1e-8) -> DataFrame:
    """(keys, n, mean): the mean per dimension, of length 1 if normalised. Vectors must have one size."""
    dims = vectors.select(*keys, F.posexplode(column).alias("i", "v"))
    means = dims.groupBy(*keys, "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    rows = means.groupBy(*keys).agg(
        F.max("n").alias("n"), F.min("n").alias("_least"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_l")
    )
    rows = rows.withColumn("n", F.when(F.col("n") == F.col("_least"), F.col("n")).otherwise(F.raise_error(F.lit("vectors differ in size"))))
    mean = F.transform("_l", lambda p: p["m"])
    out = rows.select(*keys, "n", mean.alias("mean"))
    if normalise:
        size = F.greatest(S.norm(F.col("mean")), F.lit(eps))
        out = out.withColumn("mean", F.transform("mean", lambda v: v / size))
    return out


def transfer_slices(source: DataFrame, target: DataFrame, keys: list[str], ranges: list[tuple[int, int]]) -> DataFrame:
    """(keys, i, v): the source's value per dimension inside the ranges, the target's elsewhere."""
    inside = F.lit(False)
    for lo, hi in ranges:
        inside = inside | ((F.col("i") >= lo) & (F.col("i") < hi))
    s = source.select(*keys, "i", F.col("v").alias("s"))
    return target.join(s, [*keys, "i"], "left").select(*keys, "i", F.when(inside, F.coalesce("s", "v")).otherwise(F.col("v")).alias("v"))


def variants(images: DataFrame, flips: list[str], rotations: list[int]) -> DataFrame:
    """Each image with every flip and rotation: flips outside, rotations inside, ``ord`` in that order."""
    f = F.posexplode(F.array(*(F.lit(v) for v in flips))).alias("fi", "flip")
    r = F.posexplode(F.array(*(F.lit(v) for v in rotations))).alias("ri", "rotation")
    rows = images.select("*", f).select("*", r)
    return rows.withColumn("ord", F.col("fi") * len(rotations) + F.col("ri")).drop("fi", "ri")
