"""Pseudonymization Column builders.

The original hashes with SHA-224 (hex).  ``bits`` is a parameter because SQL engines
without SHA-224 (DuckDB) can only check the 256-bit form; 224 is the default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import WORD, escape_literal

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_value(c: ColumnOrName, bits: int = 224) -> Column:
    """Hex SHA-2 of the UTF-8 bytes; NULL stays NULL."""
    return F.sha2(_c(c).cast("string"), bits)


def hash_mentions(c: ColumnOrName, prefix: str = "@", bits: int = 224) -> Column:
    """Replace every ``<prefix>\\w*`` by ``<prefix>`` + SHA-2 of the name after the prefix.

    A bare prefix hashes the empty name, as in the original.  Built without a UDF: the
    text is split on the mention pattern, the mentions are extracted, hashed with ``sha2``
    and zipped back between the pieces, so it stays a JVM expression.
    """
    col = _c(c)
    pat = escape_literal(prefix) + WORD + "*"
    found = F.regexp_extract_all(col, F.lit(pat), 0)
    start = len(prefix) + 1
    hashed = F.transform(found, lambda m: F.concat(F.lit(prefix),
                                                   F.sha2(F.substring(m, start, 1 << 30), bits)))

    def rejoined(pieces: Column) -> Column:
        rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        tail = F.zip_with(hashed, rest, lambda h, p: F.concat(h, F.coalesce(p, F.lit(""))))
        return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))

    # as a variable of the function, the pieces are split off once, not once for each use
    return F.element_at(F.transform(F.array(F.split(col, pat, -1)), rejoined), 1)
