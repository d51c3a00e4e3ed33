"""Lexicon extraction (M2): surface expressions of a concept lexicon found in texts.

Texts and expressions are tokenized the same way (lower case, maximal runs of word
characters).  Matching is exact on token sequences, then overlaps are resolved
leftmost-longest.

Plan, chosen for scale:

1. The lexicon is normalized (byte-order marks stripped, trimmed, lower-cased, de-duplicated)
   and each expression gets an *anchor*: its token that occurs in the fewest expressions.
2. Each text is exploded into (position, token) and probed against the anchor table with
   a broadcast hash join (the lexicon is size-checked first).  A hit proposes one start.
3. The proposal is verified in the same stage by comparing the text's token slice with
   the expression's tokens; nothing is shuffled up to here.  A lexicon beyond the size check
   is joined by shuffle on the token instead; a token then travels with its neighbours up
   to the widest expression, not with its text.
4. A verified match is four values (text, start, width, expression id).  Overlap removal
   sorts these by text and keeps, left to right, the longest match at each free start.

The anchor is the token that is rarest among the expressions, the first one on ties; how
common it is in the texts is not known, so an expression of words that each occur in one
expression only may be anchored on a common word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import WORD
from .sizing import DEFAULT_BROADCAST_ROWS, is_small

TOKEN = WORD + "+"


def tokenize(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def read_lexicon(spark, path: str, sep: str = "\t") -> DataFrame:
    """The lexicon file (header ``Symptom CUI LexicalExpression``), text columns only."""
    return spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)


def normalize_lexicon(lex: DataFrame, expr: str = "LexicalExpression", concept: str = "Symptom",
                      code: str = "CUI") -> DataFrame:
    """Strip U+FEFF anywhere in a field, trim, lower-case, drop duplicates and empties.

    Returns (concept, code, expression, tokens, width, eid); ``eid`` is a 64-bit id of the
    token sequence.
    """
    def clean(c):
        return F.trim(F.regexp_replace(F.col(c), "﻿", ""))
    out = lex.select(clean(concept).alias("concept"), clean(code).alias("code"),
                     F.lower(clean(expr)).alias("expression"))
    out = out.withColumn("tokens", tokenize("expression")).withColumn("width", F.size("tokens"))
    out = out.withColumn("eid", F.xxhash64(F.array_join("tokens", " ")))
    return out.filter(F.col("width") > 0).dropDuplicates(["concept", "code", "expression"])


def anchor_table(norm: DataFrame) -> DataFrame:
    """One row per distinct token sequence: (eid, etokens, width, anchor, anchor_k).

    The anchor is the token of the expression that occurs in the fewest distinct
    expressions (first such position on ties).
    """
    seqs = norm.select("eid", F.col("tokens").alias("etokens"), "width").dropDuplicates(["eid"])
    toks = seqs.select("eid", "etokens", "width", F.posexplode("etokens").alias("k", "tok"))
    freq = toks.select("tok", "eid").distinct().groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ranked = toks.join(freq, "tok")
    w = Window.partitionBy("eid").orderBy("df", "k")
    best = ranked.withColumn("r", F.row_number().over(w)).filter(F.col("r") == 1)
    return best.select("eid", "etokens", "width", F.col("tok").alias("anchor"), F.col("k").alias("anchor_k"))


def _raw_hits(docs: DataFrame, norm: DataFrame, id_col: str, text: str,
              small: bool) -> DataFrame:
    """Verified occurrences (id, start, width, eid), overlaps included.

    ``small``: the lexicon passed the size check, so its anchor table (at most one row
    per expression) is broadcast; otherwise the anchor join is a shuffle join on tokens.
    """
    anchors = anchor_table(norm)
    t = docs.select(F.col(id_col).alias("__id"), tokenize(text).alias("__toks"))
    # the outer form keeps Catalyst from inferring a size(tokens) > 0 filter that it would
    # push below the scan's exchange, tokenizing every text twice
    ex = t.select("__id", "__toks", F.posexplode_outer("__toks").alias("__pos", "__tok"))
    ex = ex.filter(F.col("__tok").isNotNull())
    if small:
        anchors = F.broadcast(anchors)
        around, first = F.col("__toks"), F.lit(0)
    else:
        # the neighbours within reach of the widest expression stand in for the text
        reach = (norm.agg(F.max("width")).collect()[0][0] or 1) - 1
        first = F.greatest(F.col("__pos") - reach, F.lit(0))
        ex = ex.select("__id", "__pos", "__tok", first.alias("__first"), F.slice(
            "__toks", first + 1, F.col("__pos") - first + 1 + reach).alias("__near"))
        around, first = F.col("__near"), F.col("__first")
    j = ex.join(anchors, F.col("__tok") == F.col("anchor"))
    start = F.col("__pos") - F.col("anchor_k")
    fits = (start >= first) & (start - first + F.col("width") <= F.size(around))
    same = F.when(fits, F.slice(around, F.greatest(start - first + 1, F.lit(1)), F.col("width")) == F.col("etokens"))
    return j.filter(F.coalesce(same, F.lit(False))).select(
        F.col("__id").alias(id_col), start.alias("start"), "width", "eid")


def _names(norm: DataFrame, small: bool) -> DataFrame:
    names = norm.select("eid", "expression", "concept", "code")
    return F.broadcast(names) if small else names


def lexicon_hits(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text: str = "text",
                 broadcast_rows: int = DEFAULT_BROADCAST_ROWS, normalized: bool = False) -> DataFrame:
    """All occurrences of all expressions, overlaps included.

    Returns (id, start, width, expression, concept, code); ``start`` is the 0-based token
    position.
    """
    small = is_small(lexicon, broadcast_rows)     # bounds both derived tables
    norm = lexicon if normalized else normalize_lexicon(lexicon)
    hits = _raw_hits(docs, norm, id_col, text, small)
    return hits.join(_names(norm, small), "eid").drop("eid")


def resolve_overlaps(hits: DataFrame, id_col: str = "doc_id", fold_limit: int = 256) -> DataFrame:
    """Leftmost-longest, non-overlapping selection per text.

    Greedy rule: walk spans by (start, longer first) and keep a span when it starts at or
    after the end of the last kept span.  The matches are shuffled once by text, sorted inside
    the partitions by Spark, and walked as they stream by: between batches the walk holds two
    ends of the last text, whatever it holds.  Input needs (id, start, width, eid) with unique
    text ids; returns the kept rows.  ``fold_limit`` has no effect: runs of overlapping
    matches of every size are walked alike.
    """
    spans = hits.select(id_col, "start", "width", "eid").repartition(id_col)
    spans = spans.sortWithinPartitions(id_col, "start", F.col("width").desc(), "eid")
    return spans.mapInArrow(_walk, spans.schema)


def _walk(batches):
    """Greedy leftmost-longest walk over the sorted spans of whole texts (linear).

    A span that starts at or after the end of every earlier span of its text is kept whatever
    came before; these are found for a batch at once, only the others are walked one by one.
    """
    text, reach, end = None, -1, -1               # of the rows before: text, largest end, end of the last kept
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, starts = batch.column(0), batch.column(1).to_numpy().astype("int64")
        ends = starts + batch.column(2).to_numpy()
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        other = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
        new = np.concatenate([[reach < 0 or ids[0].as_py() != text], other | (null[1:] != null[:-1])])
        apart = np.cumsum(new) << 32              # the spans of a text lie beyond all of the text before
        far = np.maximum.accumulate(np.concatenate([[reach], ends + apart]))
        free = starts + apart >= far[:-1]
        keep = free.copy()
        for i in np.flatnonzero(~free):
            if i and free[i - 1]:
                end = ends[i - 1]
            if starts[i] >= end:
                keep[i], end = True, ends[i]
        text, reach, end = ids[-1].as_py(), far[-1] - apart[-1], ends[-1] if free[-1] else end
        yield batch.filter(pa.array(keep))


def lexicon_matches(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text: str = "text",
                    broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """M2: non-overlapping matches with their concepts: (id, start, width, expression,
    concept, code).  An expression listed under several concepts gives one row each."""
    small = is_small(lexicon, broadcast_rows)
    norm = normalize_lexicon(lexicon)
    kept = resolve_overlaps(_raw_hits(docs, norm, id_col, text, small), id_col)
    return kept.join(_names(norm, small), "eid").drop("eid")


def concept_counts(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mentions and texts per concept: (concept, code, mentions, texts)."""
    return matches.groupBy("concept", "code").agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct(id_col).alias("texts"))
