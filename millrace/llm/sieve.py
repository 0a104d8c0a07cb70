"""Joins of wide rows with keys of which most rows have none: a bitmap of fixed size tells first which rows may match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import staged

_BITS = 24  # of a hash: a bitmap of 2 MB, whatever the number of keys
_MAP = 15  # of these inside one of Spark's bitmaps


def _marked(rows: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """rows with a column _may: false only where name is none of the keys (a column of that name)."""

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << _BITS))

    bit = place(F.col(name)).bitwiseAND(F.lit((1 << _MAP) - 1))
    maps = keys.select(F.shiftright(place(F.col(name)), _MAP).alias("_map"), bit.alias("_bit")).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    may = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    told = rows.withColumn("_map", F.shiftright(place(F.col(name)), _MAP)).join(F.broadcast(maps), "_map", "left")
    return told.select(*rows.columns, may.alias("_may"))


def sifted(rows: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """All rows whose name is one of the keys, and a few others; an exact join follows. Only the bitmap of the keys is sent out,
    so rows that can't match aren't shuffled. With very many keys more rows pass, never fewer."""
    return _marked(rows, name, keys).filter("_may").drop("_may")


def without(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """rows whose name is none of gone's (a left anti join). Rows that the bitmap clears stay where they are; the others are
    joined, by a merge at every size."""
    gone = staged(gone.select(name), "sieve-gone")  # read twice
    told = _marked(rows, name, gone)
    doubtful = told.filter("_may").join(gone.hint("merge"), name, "left_anti")
    return told.filter("not _may").unionByName(doubtful).select(rows.columns)
