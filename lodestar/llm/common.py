"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D], which count as white space in every contract here.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id falls in no fold (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)), F.lit(-1)).cast("int")


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def as_text(name: str = "doc_id") -> Column:
    """An id as text, to go through pandas: a null among long numbers would turn them into floats there."""
    return F.col(name).cast("string")


def as_before(df: DataFrame, source: DataFrame, name: str = "doc_id", source_name: str | None = None) -> DataFrame:
    """df with the id in the type that it has in source."""
    return df.withColumn(name, F.col(name).cast(source.schema[source_name or name].dataType))


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as keep it apart from the columns of docs."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


#: Bits of a filter of ids for each of them, and at most (16 MB).
ID_BITS = 64
ID_FILTER_BITS = 1 << 27


def split_by_ids(df: DataFrame, id_col: str, ids: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose id may be among the ids (column col of ids, of the same type), and those whose id isn't. A
    bitmap of the ids is broadcast, of a bounded size however many they are, so no row of df moves; an id that isn't there
    is let through by chance only, so a join after it takes little more than the rows that it is about."""
    bits, many = 1 << 15, ids.count()
    while bits < min(ID_BITS * many, ID_FILTER_BITS):
        bits *= 2
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(bits)) + 1
    bucket, byte = fresh(df, "bucket"), fresh(df, "bitmap")
    maps = ids.groupBy(F.bitmap_bucket_number(place(col)).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(col))).alias(byte))
    at = F.bitmap_bit_position(place(id_col)).cast("int")
    # lowest bit first; a bucket that isn't there has no id
    there = F.conv(F.hex(F.col(byte).substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.call_function("shiftright", there, at % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    found = df.withColumn(bucket, F.bitmap_bucket_number(place(id_col))).join(F.broadcast(maps), bucket, "left")
    return found.where(maybe).drop(bucket, byte), found.where(~maybe).drop(bucket, byte)


def give_back() -> None:
    """Hand the freed memory of this Python worker back to the system. Workers outlive their tasks, and would keep what
    their largest batch took while stages without Python need the executor's memory."""
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only there with glibc
    if trim:
        trim(0)
