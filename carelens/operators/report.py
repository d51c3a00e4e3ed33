"""Frequency, share and pivot reports over enriched mentions.

Totals are one-row aggregates used as scalar subqueries (``DataFrame.scalar``), so a
share never needs a cross join or an unpartitioned window over raw rows; every group-by
aggregates partially on the map side before its shuffle.

The report functions accept either one row per mention or a pre-aggregated table with a
count column (``count_col``).  ``mention_cube`` aggregates the mention table once to
(concept, category, country, month) counts; all shares, pivots and trends then read that
small table instead of scanning the mentions again for every total.

Joins carry no broadcast hints: their small sides (dictionary, category lists) are
broadcast by Spark after it measures them (adaptive execution), without an extra job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import NOISE_CATEGORIES, REPORT_EXCLUDED_CATEGORIES, UNCATEGORIZED
from .select import exclude_categories
from .semantic import distinct_dictionary


def _n(count_col: str | None) -> Column:
    return F.count(F.lit(1)) if count_col is None else F.sum(count_col)


def mention_cube(enriched: DataFrame, date_col: str | None = "created_date", concept: str = "symptom",
                 category: str = "lancet_category", country: str = "country",
                 count_col: str | None = None, is_month: bool = False) -> DataFrame:
    """Counts per (symptom, lancet_category, country[, month]) over all mention rows (NULLs kept
    as their own groups); map-side partial aggregation keeps the shuffle at the size of the
    result, not of the mentions.  ``count_col`` sums an existing count instead of counting."""
    keys = [F.col(concept).alias("symptom"), F.col(category).alias("lancet_category"),
            F.col(country).alias("country")]
    if date_col is not None:
        month = F.col(date_col) if is_month else F.date_format(F.col(date_col).cast("date"), "yyyy-MM")
        keys.append(month.alias("month"))
    return enriched.groupBy(*keys).agg(_n(count_col).alias("n"))


def term_cube(mentions: DataFrame, term: str = "symptom_adjusted", country: str = "country",
              date_col: str | None = "created_date") -> DataFrame:
    """Mentions pre-aggregated by (term, country, month) before any mapping join."""
    keys = [F.col(term).alias(term), F.col(country).alias(country)]
    if date_col is not None:
        keys.append(F.date_format(F.col(date_col).cast("date"), "yyyy-MM").alias("month"))
    return mentions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def term_frequency(df: DataFrame, col: str = "symptom_adjusted") -> DataFrame:
    """A2: (term, frequency); NULL terms dropped (as pandas ``groupby`` does)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("frequency"))


def frequency_totals(freq: DataFrame) -> DataFrame:
    """A2: total occurrences and number of distinct terms."""
    return freq.agg(F.sum("frequency").alias("total"), F.count(F.lit(1)).alias("n_terms"))


def order_by_frequency(df: DataFrame, freq: str = "frequency", key: str | None = None) -> DataFrame:
    """O1: frequency descending, then the key for a total order."""
    return df.orderBy(F.col(freq).desc(), *([F.col(key)] if key else []))


def top_n(df: DataFrame, n: int, freq: str = "frequency", key: str | None = None) -> DataFrame:
    """O2: first ``n`` rows by frequency (TakeOrderedAndProject: a per-task top-n, then a merge)."""
    return order_by_frequency(df, freq, key).limit(n)


def top_n_per_group(df: DataFrame, group: str, n: int, order: list[Column]) -> DataFrame:
    """O2 per group: ``row_number`` over the group, partitioned by the group key."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def concept_share(enriched: DataFrame, dictionary: DataFrame, concept: str = "symptom",
                  abr: str = "abr_symptoms", category: str = "categories",
                  noise=tuple(NOISE_CATEGORIES), count_col: str | None = None) -> DataFrame:
    """A4: frequency per mapped concept with its category, noise removed, and
    ``perc = 100 * frequency / total`` where the total is taken after the noise removal.

    Returns (symptom, frequency, lancet_category, perc).
    """
    f = enriched.filter(F.col(concept).isNotNull()).groupBy(F.col(concept).alias("symptom")).agg(
        _n(count_col).alias("frequency"))
    dim = distinct_dictionary(dictionary, abr, category)
    c = f.join(dim, F.col("symptom") == F.col("abr"), "left").select(
        "symptom", "frequency", F.col("category").alias("lancet_category"))
    c = exclude_categories(c, "lancet_category", noise)
    total = c.agg(F.sum("frequency")).scalar()
    return c.withColumn("perc", F.lit(100.0) * F.col("frequency") / total)


def category_share(shares: DataFrame, excluded=tuple(REPORT_EXCLUDED_CATEGORIES)) -> DataFrame:
    """A5: per category the summed frequency over the A4 total (which still holds the
    excluded categories, so shares do not sum to 100).  Returns (lancet_category, count, perc)."""
    total = shares.agg(F.sum("frequency")).scalar()
    kept = exclude_categories(shares, "lancet_category", excluded).filter(F.col("lancet_category").isNotNull())
    g = kept.groupBy("lancet_category").agg(F.sum("frequency").alias("count"))
    return g.withColumn("perc", F.lit(100.0) * F.col("count") / total)


def uncategorized_top(shares: DataFrame, n: int = 16, category: str = UNCATEGORIZED) -> DataFrame:
    """The ``n`` most frequent concepts of the uncategorized category."""
    return top_n(shares.filter(F.col("lancet_category") == category), n, "frequency", "symptom")


def _in_share_categories(enriched: DataFrame, shares: DataFrame) -> DataFrame:
    """mentions whose category occurs in A4 (NULL matches NULL, as pandas ``isin``)."""
    cats = shares.select(F.col("lancet_category").alias("__c")).distinct()
    return enriched.join(cats, F.col("lancet_category").eqNullSafe(F.col("__c")), "left_semi")


def country_share(enriched: DataFrame, shares: DataFrame, country: str = "country",
                  count_col: str | None = None) -> DataFrame:
    """Mentions per country among the A4 categories; ``perc`` is a fraction of the A4
    total (not x100).  NULL countries are dropped; ``''`` is a real country."""
    total = shares.agg(F.sum("frequency")).scalar()
    f = _in_share_categories(enriched, shares).filter(F.col(country).isNotNull())
    g = f.groupBy(F.col(country).alias("country")).agg(_n(count_col).alias("count"))
    return g.withColumn("perc", F.col("count") / total)


def country_coverage(enriched: DataFrame, shares: DataFrame, country: str = "country",
                     count_col: str | None = None) -> DataFrame:
    """The fraction of the A4 total that carries a country."""
    c = country_share(enriched, shares, country, count_col)
    return c.agg((F.sum("count") / shares.agg(F.sum("frequency")).scalar()).alias("covered"))


def category_country_long(enriched: DataFrame, shares: DataFrame, country: str = "country",
                          minimum: float = 1.0, count_col: str | None = None) -> DataFrame:
    """A8 in long form: (category, country, perc) with perc = 100 x mentions of the
    category in the country / the category's A4 frequency; cells under ``minimum`` dropped."""
    bm = shares.groupBy(F.col("lancet_category").alias("category")).agg(F.sum("frequency").alias("bm"))
    f = _in_share_categories(enriched, shares).filter(F.col(country).isNotNull())
    g = f.groupBy(F.col("lancet_category").alias("category"), F.col(country).alias("country")).agg(
        _n(count_col).alias("n"))
    j = g.join(bm, g.category.eqNullSafe(bm.category)).select(
        g.category, "country", (F.lit(100.0) * F.col("n") / F.col("bm")).alias("perc"))
    return j.filter(F.col("perc") >= minimum)


def category_country_matrix(enriched: DataFrame, shares: DataFrame, countries: list[str],
                            country: str = "country", minimum: float = 1.0,
                            count_col: str | None = None) -> DataFrame:
    """A8 as the category x country matrix: one column per listed country, NULL where the
    cell is under ``minimum``.  The list is given, so no job collects the countries."""
    long = category_country_long(enriched, shares, country, minimum, count_col)
    return long.groupBy("category").pivot("country", list(countries)).agg(F.first("perc"))


def month_trend(enriched: DataFrame, date_col: str, concept: str = "symptom",
                count_col: str | None = None, is_month: bool = False) -> DataFrame:
    """Mentions per month and mapped concept: (month 'yyyy-MM', concept, count).
    ``is_month`` when ``date_col`` already holds 'yyyy-MM' (as in ``mention_cube``)."""
    month = F.col(date_col) if is_month else F.date_format(F.col(date_col).cast("date"), "yyyy-MM")
    return (enriched.filter(F.col(concept).isNotNull())
            .groupBy(month.alias("month"), F.col(concept).alias("concept"))
            .agg(_n(count_col).alias("count")))
