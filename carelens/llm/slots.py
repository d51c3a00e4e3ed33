"""A bitmap over the hashes of some rows: which rows of a large table can be among them.

The bitmap has ``SLOTS`` bits whatever the tables hold, so it may be broadcast.  Rows
outside it are surely not among the keys and need no join, so their texts are not moved;
the others go through an exact join.  More keys than slots only send more rows there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path

SLOTS = 1 << 24


def _slot(key: Column) -> Column:
    return key.bitwiseAND(F.lit(SLOTS - 1))


def slot_words(keys: DataFrame, key: Column) -> DataFrame:
    """(word, bits): the bitmap of the 64-bit hashes ``key``, 64 slots a row; written."""
    spark = keys.sparkSession
    path = scratch_path(spark, "slots")
    slot = keys.select(_slot(key).alias("slot")).filter("slot IS NOT NULL")
    (slot.groupBy(F.shiftright("slot", 6).alias("word"))
     .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")).write.parquet(path))
    return spark.read.parquet(path)


def slot_bits(words: DataFrame) -> np.ndarray:
    """The bitmap as an array of SLOTS booleans, for tasks in Python."""
    rows = words.toArrow()                                # SLOTS / 64 rows at most
    bits = np.zeros(SLOTS // 64, "<i8")
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


def parted(rows: DataFrame, key: Column, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows whose key is not in the bitmap, the rows whose key may be).

    A row with a null key is not in it.
    """
    names = [F.col(f"`{c}`") for c in rows.columns]
    mine = "__"
    while any(c.lower().startswith(mine) for c in rows.columns):
        mine += "_"                                       # names that no column of the rows has
    slot, word = F.col(mine + "slot"), F.col(mine + "word")
    marked = rows.withColumn(mine + "slot", _slot(key)).join(
        F.broadcast(words.select(F.col("word").alias(mine + "word"), F.col("bits").alias(mine + "bits"))),
        F.shiftright(slot, 6) == word, "left")
    inside = F.coalesce(F.expr(f"shiftright({mine}bits, cast({mine}slot & 63 AS int)) & 1") == 1, F.lit(False))
    return marked.filter(~inside).select(*names), marked.filter(inside).select(*names)
