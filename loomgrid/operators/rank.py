"""Candidate rankings: ordered merges, weighted means over scorers and deterministic argmax.

A ranking is a relation (scorer_id, scorer_ord, ord, image, score, score_weight). Equal scores go to
the row with the least ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_by(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The first row of each group by ``order``, without a window: one partially aggregated minimum.

    A group never has to fit a task, so this holds for a hot key too. ``order`` must be ascending.
    """
    columns = columns or [c for c in df.columns if c not in keys]
    key = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = F.min(F.struct(*key, *(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best._c{i}").alias(c) for i, c in enumerate(columns)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; hot groups are cut down in salted parts first."""
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    few = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).withColumn("_r", F.row_number().over(part))
    few = few.where(F.col("_r") <= k).drop("_salt", "_r")
    return few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def build_ranking(candidates: DataFrame, scorer_id: str, scorer_ord: int, weight: float) -> DataFrame:
    """Rows of one scorer from (ord, image, score)."""
    return candidates.select(
        F.lit(scorer_id).alias("scorer_id"), F.lit(scorer_ord).alias("scorer_ord"), "ord", "image", "score",
        F.lit(float(weight)).alias("score_weight"),
    )


def merge_rankings(own: DataFrame, upstream: DataFrame) -> DataFrame:
    """Own rows and those of upstream; upstream replaces a scorer of the same id."""
    rest = own.join(upstream.select("scorer_id").distinct(), "scorer_id", "left_anti")
    return rest.unionByName(upstream)


def weighted_mean(rankings: DataFrame, key: str = "image") -> DataFrame:
    """(key, score, n, ord): the mean score by weight, an image listed twice counting twice."""
    return rankings.groupBy(key).agg(
        F.try_divide(F.sum(F.col("score") * F.col("score_weight")), F.sum("score_weight")).alias("score"),
        F.count("*").alias("n"),
        F.min(F.struct("scorer_ord", "ord")).alias("ord"),
    )


def best(rankings: DataFrame, key: str = "image", places: int | None = None) -> DataFrame:
    """The one image with the largest mean; the first listed of equals; none where that is not above 0.

    With ``places``, means that agree in so many decimals are equal.
    """
    means = weighted_mean(rankings, key)
    means = means if places is None else means.withColumn("score", F.round("score", places))
    first = means.agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("ord"), F.col(key).alias("k"))).alias("b"))
    return first.where(F.col("b.s") < 0).select(F.col("b.k").alias(key), (-F.col("b.s")).alias("score"))


def ordered_distinct(df: DataFrame, key: str, ord_col: str = "ord") -> DataFrame:
    """Each key once with the place where it was first seen."""
    return df.groupBy(key).agg(F.min(ord_col).alias(ord_col))


def keep_unless_empty(df: DataFrame, group: list[str], passes: Column) -> DataFrame:
    """Filter that holds only in groups where something passes."""
    flagged = df.withColumn("_pass", F.coalesce(passes, F.lit(False)))
    some = flagged.groupBy(*group).agg(F.max("_pass").alias("_some"))
    return flagged.join(some, group).where(F.col("_pass") | ~F.col("_some")).drop("_pass", "_some")
