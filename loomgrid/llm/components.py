"""Connected components of a link table, by rounds of neighbour minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop, files_for


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in ``links``, a table, the least id that links reach.

    Each round replaces a label by the least label among the neighbours and then by that label's own
    label, so a chain shrinks by more than half in a round. Labels are aggregated before they are
    exchanged, and every round is a table of its own, of as many files as its size asks for. Links with a
    null end are left out.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    files = files_for(2 * links.count())
    edges = cut(pairs.union(pairs.select("v", "u")).distinct().coalesce(files), "links")
    labels = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).coalesce(files), "labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        lower = labels.join(near, "u").select("u", "c", F.least("c", "m").alias("m"))
        jump = labels.select(F.col("u").alias("m"), F.col("c").alias("j"))
        moved = cut(lower.join(jump, "m", "left").select("u", F.least("m", "j").alias("n"), "c").coalesce(files), "labels")
        changed = moved.where("n < c").limit(1).count()
        drop(labels)
        labels = moved.select("u", F.col("n").alias("c"))
        labels._loomgrid_path = moved._loomgrid_path
        if not changed:
            drop(edges)
            out = labels.select(F.col("u").alias("id"), F.col("c").alias("component"))
            out._loomgrid_path = moved._loomgrid_path
            return out
