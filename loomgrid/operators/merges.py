"""Ordered merges of image lists and prompts, payload look-ups and result finalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def image_list(image: Column, images: Column, path: Column, first: str = "image") -> Column:
    """Paths of a payload; ``first`` tells whether a single ``image`` or the list ``images`` goes first.

    Empty strings and empty lists count as missing; ``path`` is the last resort.
    """
    single = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c))
    many = F.when(F.size(images) > 0, images)
    order = [single(image), many] if first == "image" else [many, single(image)]
    return F.coalesce(*order, single(path))


def merge_images(payloads: DataFrame, keys: list[str], prefix: str = "image") -> DataFrame:
    """(keys, ord, path): the lists of the inputs ``prefix:N`` in order of N; null ``ord`` never occurs.

    A merge whose indexes are not 0..n-1 fails.
    """
    idx = T.input_index(F.col("input_id"), prefix)
    rows = payloads.select(*keys, idx.alias("idx"), image_list(F.col("image"), F.col("images"), F.col("path"), "images").alias("l"))
    check = rows.groupBy(*keys).agg(F.max("idx").alias("m"), F.count_distinct("idx").alias("d"), F.count("*").alias("n"))
    good = check.withColumn(
        "ok", F.when((F.col("m") + 1 == F.col("d")) & (F.col("d") == F.col("n")), True).otherwise(F.raise_error(F.lit("input indexes are not contiguous from 0")).cast("boolean"))
    ).where("ok")
    flat = rows.join(good.select(*keys), keys).select(*keys, "idx", F.posexplode("l").alias("pos", "path"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy("idx", "pos")) - 1
    return flat.select(*keys, place.alias("ord"), "path")


def contiguous(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, n, contiguous): whether the indexes of a group are 0..n-1, each once."""
    i = F.col(index)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce((F.min(i) == 0) & (F.max(i) + 1 == F.count_distinct(i)) & (F.count_distinct(i) == F.count("*")), F.lit(False)).alias("contiguous")
    )


def join_ordered(df: DataFrame, keys: list[str], order: str, value: Column, joiner: str) -> Column:
    """Aggregate: non-empty values of a group in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    kept = F.filter(F.transform(parts, lambda p: p["v"]), lambda v: v.isNotNull() & (v != ""))
    return F.array_join(kept, joiner)


def merge_prompts(prompts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Prompts joined by lines and negative prompts by commas, in order.

    The second fields exist only if a source has one; a source without then gives its first field.
    """
    p, p2, n, n2 = (T.norm_prompt(F.col(c)) for c in ("prompt", "prompt_2", "negative_prompt", "negative_prompt_2"))
    joined = prompts.groupBy(*keys).agg(
        join_ordered(prompts, keys, order, p, "\n").alias("prompt"),
        F.when(F.max(p2 != ""), join_ordered(prompts, keys, order, F.when(p2 != "", p2).otherwise(p), "\n")).alias("prompt_2"),
        join_ordered(prompts, keys, order, n, ", ").alias("negative_prompt"),
        F.when(F.max(n2 != ""), join_ordered(prompts, keys, order, F.when(n2 != "", n2).otherwise(n), ", ")).alias("negative_prompt_2"),
    )
    return joined


def merge_sequence(default: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, ord, path): a default list first, then indexed ones in order."""
    first = default.select(*keys, F.lit(-1).alias("part"), "ord", "path")
    return first.unionByName(indexed.select(*keys, F.col("idx").alias("part"), "ord", "path"))


def finalise(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per result: a single item gives scalars, several give lists; ``anchor`` is the least path."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "path", "seed")))
    out = items.groupBy(*keys).agg(F.count("*").alias("n"), F.min("path").alias("anchor"), ordered.alias("l"))
    many, one = F.col("n") > 1, F.get(F.col("l"), F.lit(0))
    return out.select(
        *keys, "n", "anchor", F.when(~many, one["path"]).alias("image"), F.when(~many, one["seed"]).alias("seed"),
        F.when(many, F.transform("l", lambda x: x["path"])).alias("images"), F.when(many, F.transform("l", lambda x: x["seed"])).alias("seeds"),
    )


def passthrough(payload: DataFrame, node_id: str, op: str) -> DataFrame:
    """A payload under another identity."""
    return payload.drop("metadata", "id", "node", "op", "from").withColumns({"id": F.lit(node_id), "node": F.lit(op)})


def output_size(params: Column, output: Column, resized: Column) -> Column:
    """(w, h) from the first source that has both."""
    pair = lambda c: F.when(c["w"].isNotNull() & c["h"].isNotNull(), F.struct(c["w"].alias("w"), c["h"].alias("h")))
    return F.coalesce(pair(params), pair(output), pair(resized))


def override(base: Column, other: Column, fields: list[str]) -> Column:
    """A struct whose fields are the other's where those are not null."""
    return F.struct(*(F.coalesce(other[f], base[f]).alias(f) for f in fields))


def exactly_one(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, failing for a group that has not exactly one row."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ok = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"not exactly one {what}: "), F.col("_n"))).cast("boolean"))
    return df.join(n.where(ok).drop("_n"), keys)


def one_of(a: Column, b: Column, message: str) -> Column:
    """True where exactly one is given; fails elsewhere."""
    return F.when(a.isNull() != b.isNull(), True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def slot_value(indexed: Column, shared: Column, place: Column) -> Column:
    """A slot's own value, else the one shared value, else that of an exact list at its place."""
    return F.coalesce(indexed, F.when(F.size(shared) == 1, F.get(shared, F.lit(0))).otherwise(F.get(shared, place)))


def expand_aliases(targets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, ord, label): ordered distinct labels of the target words (id, ord, word) by a table (word, pos, label).

    A word without an entry is its own label.
    """
    rows = targets.join(aliases, "word", "left").select("id", F.struct("ord", F.coalesce("pos", F.lit(0)).alias("pos")).alias("o"), F.coalesce("label", "word").alias("label"))
    return rows.groupBy("id", "label").agg(F.min("o").alias("ord")).select("id", "ord", "label")
