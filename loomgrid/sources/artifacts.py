"""Artifacts: results of nodes by name, the newest of which is the node's current result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import top_by

#: Fixed value: the time that begins an artifact's name.
STAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{6})"


def latest(artifacts: DataFrame, key: str = "node_id", name: str = "name") -> DataFrame:
    """Per key the artifact with the latest time in its name, the first name of equals.

    Names without a time come after all others, in alphabetical order.
    """
    stamp = F.regexp_extract(name, STAMP, 1)
    # Digits turned about make the greatest time the least text, so that one minimum decides.
    order = [F.when(stamp == "", 1).otherwise(0), F.translate(stamp, "0123456789", "9876543210"), F.col(name)]
    return top_by(artifacts, [key], order)


def latest_or_fail(artifacts: DataFrame, wanted: DataFrame, key: str = "node_id") -> DataFrame:
    """The latest artifacts of the wanted keys; a key without one is an error."""
    found = latest(artifacts, key).withColumn("_found", F.lit(True))
    joined = wanted.select(key).distinct().join(found, key, "left")
    ok = F.when(F.col("_found"), True).otherwise(F.raise_error(F.concat(F.lit("no artifact for "), F.col(key))).cast("boolean"))
    return joined.where(ok).drop("_found")
