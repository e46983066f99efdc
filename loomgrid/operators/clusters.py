"""Deterministic k-means: farthest-point seeds, a fixed number of rounds, and clusters by population."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import top_by


def _distance2(a: list[Column], b: list[float]) -> Column:
    return sum(((x - float(v)) * (x - float(v)) for x, v in zip(a[1:], b[1:])), (a[0] - float(b[0])) * (a[0] - float(b[0])))


def kmeans(points: DataFrame, dims: list[str], order: str, clusters: int, keep: int, rounds: int = 12) -> DataFrame:
    """(rank, population, centre): the ``keep`` most populous of ``clusters`` centres over a whole relation.

    Seeds are the point farthest from the mean and then, again and again, the point farthest from all
    seeds (the first by ``order`` of equals). Every round is one aggregation; only the centres (a
    bounded handful of numbers) come to the driver. An empty cluster keeps its centre.
    """
    cols = [F.col(d).cast("double") for d in dims]
    rows = points.select(*(c.alias(d) for c, d in zip(cols, dims)), F.col(order))
    cols = [F.col(d) for d in dims]
    distinct = rows.select(*dims).distinct().limit(clusters).count()
    clusters = min(clusters, distinct)
    if not clusters:
        raise ValueError("no points to cluster")
    mean = list(rows.agg(*(F.avg(d).alias(d) for d in dims)).first())

    def farthest(gap: Column) -> list[float]:
        best = rows.agg(F.min(F.struct((-gap).alias("g"), F.col(order), *dims)).alias("b")).first().b
        return [best[d] for d in dims]

    centres = [farthest(_distance2(cols, mean))]
    while len(centres) < clusters:
        gaps = [_distance2(cols, c) for c in centres]
        centres.append(farthest(F.least(*gaps) if len(gaps) > 1 else gaps[0]))

    def nearest() -> Column:
        gaps = F.array(*(_distance2(cols, c) for c in centres))
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")

    counts: dict[int, int] = {}
    for _ in range(rounds):
        found = rows.groupBy(nearest().alias("k")).agg(F.count("*").alias("n"), *(F.avg(d).alias(d) for d in dims)).collect()
        moved = [list(c) for c in centres]
        for r in found:
            moved[r.k] = [r[d] for d in dims]
        before, counts = counts, {r.k: r.n for r in found}
        done = before == counts and np.allclose(moved, centres)
        centres = moved
        if done:
            break
    ranked = sorted(range(clusters), key=lambda k: (-counts.get(k, 0), k))[:keep]
    data = [(i, counts.get(k, 0), [float(v) for v in centres[k]]) for i, k in enumerate(ranked)]
    return points.sparkSession.createDataFrame(data, "rank int, population long, centre array<double>")


def tile_kmeans(samples: DataFrame, keys: list[str], dims: list[str], order: str, clusters: int, keep: int, rounds: int = 12) -> DataFrame:
    """(keys, rank, population, centre) of each small group (a tile) by itself, as one Arrow group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order, kind="stable")[dims].to_numpy(float)
        n = min(clusters, len(np.unique(x, axis=0)))
        centres = x[[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]]
        while len(centres) < n:
            gap = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, x[np.argmax(gap)]])
        label = np.zeros(len(x), int)
        for _ in range(rounds):
            new = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([x[new == k].mean(axis=0) if (new == k).any() else centres[k] for k in range(n)])
            done = (new == label).all() and np.allclose(moved, centres)
            centres, label = moved, new
            if done:
                break
        counts = np.bincount(label, minlength=n)
        ranked = np.argsort(-counts, kind="stable")[:keep]
        return pd.DataFrame([(*key, i, int(counts[k]), centres[k].tolist()) for i, k in enumerate(ranked)])

    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    return samples.groupBy(*keys).applyInPandas(run, f"{kinds}, rank int, population long, centre array<double>")


def nearest_centre(points: DataFrame, centres: list[list[float]], dims: list[str]) -> Column:
    """Place of the nearest of a bounded list of centres, the first of equals."""
    gaps = F.array(*(_distance2([F.col(d) for d in dims], c) for c in centres))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_by(df, keys, order)
