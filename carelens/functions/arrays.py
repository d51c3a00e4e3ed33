"""Array helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scan(a: Column) -> Column:
    """Inclusive prefix sums of a short int array by a fold (quadratic in its length)."""
    return F.aggregate(a, F.array().cast("array<int>"),
                       lambda acc, v: F.concat(acc, F.array(
                           F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v)))


def prefix_sum(col: str, block: int = 128) -> Column:
    """Inclusive prefix sums of the int-array column ``col`` in O(n * block + (n / block)^2).

    Two levels: the array is cut into blocks of ``block`` elements, each block is scanned
    on its own, the block totals are scanned, and every block's offset is added back.

    ``col`` must name a column (materialized by an earlier projection): it is read inside
    the block lambda, and a column is an O(1) read there, while an inline expression
    would be re-evaluated for every block.  The column is referenced more than once, so
    Catalyst keeps the producing projection instead of inlining it.
    """
    a = F.col(col)
    n = F.size(a)
    nb = F.greatest(F.ceil(n / F.lit(block)).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), nb - 1), lambda b: F.slice(a, b * block + 1, F.lit(block)))
    local = F.transform(blocks, _scan)
    totals = F.transform(local, lambda l: F.coalesce(F.try_element_at(l, F.lit(-1)), F.lit(0)))
    offsets = F.slice(F.concat(F.array(F.lit(0)), _scan(totals)), 1, nb)
    out = F.flatten(F.zip_with(local, offsets, lambda l, o: F.transform(l, lambda v: v + o)))
    return F.when(n > 0, out).otherwise(F.array().cast("array<int>"))
