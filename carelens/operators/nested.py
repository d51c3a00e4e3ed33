"""Recursive cleaning of nested records.

Walks the schema: every string leaf gets the same Column expression, struct fields are
rebuilt, arrays are transformed element-wise and maps value-wise.  The result is one
projection evaluated on the JVM; no per-record Python.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..functions.text import strip_unwanted_chars


def map_strings(col: Column, dtype: DataType, fn: Callable[[Column], Column]) -> Column:
    if isinstance(dtype, StringType):
        return fn(col)
    if isinstance(dtype, StructType):
        rebuilt = F.struct(*[map_strings(col[f.name], f.dataType, fn).alias(f.name) for f in dtype.fields])
        return F.when(col.isNull(), F.lit(None)).otherwise(rebuilt)
    if isinstance(dtype, ArrayType):
        return F.transform(col, lambda x: map_strings(x, dtype.elementType, fn))
    if isinstance(dtype, MapType):
        return F.transform_values(col, lambda k, v: map_strings(v, dtype.valueType, fn))
    return col


def clean_nested(df: DataFrame, fn: Callable[[Column], Column] = strip_unwanted_chars,
                 columns: list[str] | None = None) -> DataFrame:
    """Apply ``fn`` to every string leaf of the chosen (default: all) columns."""
    cols = columns or df.columns
    return df.select(*[map_strings(F.col(f.name), f.dataType, fn).alias(f.name) if f.name in cols
                       else F.col(f.name) for f in df.schema.fields])
