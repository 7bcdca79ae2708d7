"""Shared helpers of the corpus operators.

Every operator first selects the columns that it works on by name, so that further
columns of its input can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.workspace import cut_lineage, new_folder

__all__ = ["cut_lineage", "fold_out", "ids_and_text", "numbered", "read", "remainder", "stored", "words"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def fold_out(key: str, mod: int, rest: int) -> Column:
    """True for rows that are kept out of learning."""
    return remainder(key, mod) == rest


def ids_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null: empty) and the named columns, nothing else."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *more)


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and the five ASCII controls 09-0D, with A-Z in lower case.

    ``bytes.lower`` and ``bytes.split`` act on ASCII alone, which is just that.
    """
    return text.lower().split()


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, label: str, *more: Column) -> DataFrame:
    """n (a number of each row), row (all columns of ``docs``) and further columns, written once, so that the numbers
    hold for all later reads. Names of ``docs`` cannot clash with them."""
    return stored(docs.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row"), *more), label, "zstd")
