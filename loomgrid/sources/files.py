"""Files as relations: ordered path lists, payload documents, binary images and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(source_ord, path, length): files and the files directly in folders, in the order given.

    Only the listing is read. A path list that gives no file is an error.
    """
    out = None
    for i, path in enumerate(paths):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
        rows = rows.select(F.lit(i).alias("source_ord"), "path", "length")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no paths given")
    if suffixes:
        out = out.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    if out.isEmpty():
        raise FileNotFoundError(f"no files under {paths}")
    return out


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload): whole JSON documents, each an object; anything else is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    good = F.trim("value").startswith("{")
    return rows.select("path", F.when(good, F.parse_json("value")).otherwise(F.parse_json(F.raise_error(F.lit("a payload must be an object")).cast("string"))).alias("payload"))


def write_payloads(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_binary(df: DataFrame, folder_column: str, name_column: str, bytes_column: str) -> None:
    """Write each row's bytes as a file of its own in a folder that all executors share."""

    def save(rows):
        import os

        for r in rows:
            os.makedirs(r[folder_column], exist_ok=True)
            partial = os.path.join(r[folder_column], f".{r[name_column]}.part")
            with open(partial, "wb") as f:
                f.write(r[bytes_column])
            os.replace(partial, os.path.join(r[folder_column], r[name_column]))

    df.select(folder_column, name_column, bytes_column).foreachPartition(save)


def load_embeddings(spark: SparkSession, paths: list[str], column: str, size: int) -> DataFrame:
    """Union of embedding tables; vectors of another size are an error."""
    out = spark.read.parquet(*paths)
    ok = F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(F.lit(f"an embedding has not {size} values")).cast(out.schema[column].dataType))
    return out.withColumn(column, ok)


def output_name(ts: Column, seed: Column, suffix: str) -> Column:
    """``YYYY-MM-DD_HHMMSS[_seedN].suffix``."""
    stamp = F.date_format(ts, "yyyy-MM-dd_HHmmss")
    return F.concat(F.concat_ws("_", stamp, F.concat(F.lit("seed"), seed.cast("string"))), F.lit("." + suffix))


def output_folder(root: Column, node_id: Column) -> Column:
    """A dotted id as folders under a root."""
    return F.concat_ws("/", root, F.replace(node_id, F.lit("."), F.lit("/")))
