"""Normalization of extracted term lists (M12, M13) and the vocabulary.

Per term: clean (T8), drop if in the remove list, replace through the mapping table if
present, blanks to underscores; per row the distinct results.  The mapping and remove
list are tables joined on the cleaned term (broadcast by Spark when their measured size
is small, shuffle joins otherwise), so they can be arbitrarily large.  The input is
hash-partitioned on its unique row key once; the exploded terms, their regrouping and the
join back to the rows all reuse that partitioning, so the rows cross the network once and
no key is hot.  Rows whose list ends up empty keep an empty list.  The original's set
order is arbitrary, so lists come out sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_term


def normalize_terms(df: DataFrame, key: str, list_col: str, mapping: DataFrame,
                    remove: DataFrame | None = None, out_prefix: str = "normalized_symptom",
                    with_replaced: bool = True) -> DataFrame:
    """M12 (``with_replaced=True``) / M13.

    ``mapping`` has columns (term, mapped); ``remove`` has one column (term) of cleaned
    terms.  Adds ``<prefix>_list`` (sorted distinct array), ``<prefix>_str`` (joined by
    blanks) and, for M12, ``replaced`` (some mapped value differs from its cleaned term).
    """
    base = df.repartition(key)
    ex = base.select(key, F.explode_outer(F.coalesce(F.col(list_col), F.array().cast("array<string>")))
                     .alias("__raw"))
    ex = ex.withColumn("__t", clean_term("__raw"))
    if remove is not None:
        r = remove.select(F.col(remove.columns[0]).alias("__rm")).distinct()
        ex = ex.join(r, F.col("__t") == F.col("__rm"), "left").withColumn(
            "__keep", F.col("__raw").isNotNull() & F.col("__rm").isNull()).drop("__rm")
    else:
        ex = ex.withColumn("__keep", F.col("__raw").isNotNull())
    m = mapping.select(F.col(mapping.columns[0]).alias("__mk"), F.col(mapping.columns[1]).alias("__mv"))
    m = m.dropDuplicates(["__mk"])
    ex = ex.join(m, F.col("__t") == F.col("__mk"), "left")
    norm = F.replace(F.coalesce(F.col("__mv"), F.col("__t")), F.lit(" "), F.lit("_"))
    ex = ex.select(key, F.when(F.col("__keep"), norm).alias("__n"),
                   (F.col("__keep") & F.col("__mv").isNotNull() & (F.col("__mv") != F.col("__t")))
                   .alias("__rep"))
    aggs = [F.array_sort(F.collect_set("__n")).alias(out_prefix + "_list")]
    if with_replaced:
        aggs.append(F.coalesce(F.max("__rep"), F.lit(False)).alias("replaced"))
    g = ex.groupBy(key).agg(*aggs).withColumn(out_prefix + "_str",
                                              F.array_join(F.col(out_prefix + "_list"), " "))
    return base.join(g, key, "left")


def vocabulary(df: DataFrame, list_col: str) -> DataFrame:
    """The distinct normalized terms (one row each)."""
    return df.select(F.explode(list_col).alias("term")).distinct()


def vocabulary_size(df: DataFrame, list_col: str) -> DataFrame:
    """Number of distinct normalized terms."""
    return df.select(F.explode(list_col).alias("term")).agg(F.countDistinct("term").alias("n_terms"))
