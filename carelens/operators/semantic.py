"""Similarity normalization of terms against a concept dictionary.

Two exact kernels for "best dictionary concept per term by cosine":

* ``best_concepts_dense`` - dense vectors (from any encoder, e.g. ``infer.score_batches``).
  A dictionary that passes a size check (rows and bytes) is broadcast once as a matrix
  with its row norms and each Arrow batch of terms is scored with one matrix product in
  ``mapInPandas``; there is no join at all.  A larger dictionary is split into blocks and terms into blocks; every
  (term block, dictionary block) pair is one bounded ``cogroup`` task, and the per-block
  winners are reduced per term.  Both paths give the same exact top-k.
* ``best_concepts_sparse`` - bag-of-words vectors: an inverted-index join on shared
  tokens (the dictionary side is broadcast by Spark once measured small) and a
  per-(term, entry) count, so only pairs that share a token are ever formed.

Ties are broken by the dictionary key (smaller first), which the original leaves to the
tensor library.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import SEMANTIC_CUTOFF
from .lexicon import tokenize
from .select import similarity_cutoff
from .sizing import DEFAULT_BROADCAST_ROWS

# Bounds of the dictionary broadcast as one float64 matrix: rows, and bytes (rows x dim x 8).
DENSE_BROADCAST_ROWS = 200_000
DENSE_BROADCAST_BYTES = 256 * 1024 * 1024


#: Bytes that the scores of one step may take (a step is some terms against one dictionary).
SCORE_BYTES = 64 * 1024 * 1024


def _topk(q: np.ndarray, m: np.ndarray, mnorm: np.ndarray, k: int):
    """(index, score) of the ``k`` best rows of ``m`` per row of ``q``, earlier rows on ties.

    A zero vector on either side has cosine 0.0.  Terms are scored some at a time, so that
    no score matrix exceeds ``SCORE_BYTES``; the best are picked one by one, not sorted.
    """
    kk = min(k, m.shape[0])
    idx = np.empty((len(q), kk), dtype=np.int64)
    best = np.empty((len(q), kk))
    step = max(1, SCORE_BYTES // (8 * max(m.shape[0], 1)))
    unit = np.where(mnorm > 0, mnorm, 1.0)
    for i in range(0, len(q), step):
        part = q[i:i + step]
        norm = np.linalg.norm(part, axis=1)
        s = part @ m.T
        s /= np.where(norm > 0, norm, 1.0)[:, None]
        s /= unit
        rows = np.arange(len(part))
        for j in range(kk):
            at = s.argmax(axis=1)
            idx[i:i + step, j], best[i:i + step, j] = at, s[rows, at]
            s[rows, at] = -np.inf
    return idx, best


def _stack(vals) -> np.ndarray:
    return np.asarray([np.asarray(v, dtype=np.float64) for v in vals], dtype=np.float64)


OUT_SCHEMA = "term string, rank int, concept string, score double"


def best_concepts_dense(terms: DataFrame, dictionary: DataFrame, k: int = 1,
                        term: str = "term", tvec: str = "vector", concept: str = "concept",
                        cvec: str = "vector", broadcast_rows: int = DENSE_BROADCAST_ROWS,
                        block_rows: int = 20_000, broadcast_bytes: int = DENSE_BROADCAST_BYTES,
                        dict_block_rows: int | None = None) -> DataFrame:
    """M7 + O3: top-``k`` dictionary concepts per term by cosine: (term, rank, concept, score).

    Rank 1 is the reference's choice.  Terms should already be distinct (the caller
    aggregates first, as the original does, so the encoder and this product run once
    per term).  A zero vector scores 0.0 against everything, so the smallest concepts are
    its best; a NULL vector has no rows, as a term or as an entry.
    """
    spark = terms.sparkSession
    t = terms.select(F.col(term).alias("term"), F.col(tvec).alias("v")).filter("v IS NOT NULL")
    d = dictionary.select(F.col(concept).alias("concept"), F.col(cvec).alias("v")).filter("v IS NOT NULL")
    first = d.select(F.size("v").alias("dim")).limit(1).collect()
    dim = max(first[0]["dim"], 1) if first else 1
    limit = min(broadcast_rows, max(broadcast_bytes // (8 * dim), 1))
    n = d.count()
    if n <= limit:
        rows = d.orderBy("concept").collect()          # bounded in rows and bytes by the check above
        names = np.array([r["concept"] for r in rows], dtype=object)
        mat = _stack([r["v"] for r in rows]) if rows else np.zeros((0, 0))
        bc = spark.sparkContext.broadcast((names, mat, np.linalg.norm(mat, axis=1) if rows else mat))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names_, m, mn = bc.value
            for b in batches:
                if len(b) == 0 or len(names_) == 0:
                    continue
                idx, sc = _topk(_stack(b["v"]), m, mn, k)
                kk = idx.shape[1]
                yield pd.DataFrame({
                    "term": np.repeat(b["term"].to_numpy(), kk),
                    "rank": np.tile(np.arange(1, kk + 1, dtype=np.int32), len(b)),
                    "concept": names_[idx.ravel()],
                    "score": sc.ravel(),
                })

        return t.mapInPandas(run, schema=OUT_SCHEMA)
    return _blocked_dense(t, d, k, block_rows, dict_block_rows or limit)


def _blocked_dense(t: DataFrame, d: DataFrame, k: int, term_block_rows: int,
                   dict_block_rows: int) -> DataFrame:
    """Exact top-k for dictionaries too large to broadcast: blocked all-pairs product.

    Terms go to ``tb`` blocks and dictionary entries to ``db`` blocks by hash; each term
    block meets each dictionary block in one ``cogroup`` task (both sides bounded), and
    the per-block top-k lists are merged per term.  Every term row is shuffled ``db``
    times and every dictionary row ``tb`` times, so dictionary blocks are as large as the
    broadcast bound allows (fewest copies of the usually larger term side).
    """
    n_d = d.count()
    n_t = t.count()
    db = max(1, math.ceil(n_d / max(dict_block_rows, 1)))
    tb = max(1, math.ceil(n_t / max(term_block_rows, 1)))
    dd = d.withColumn("db", F.pmod(F.xxhash64("concept"), F.lit(db)).cast("int"))
    dd = dd.select("concept", "v", F.explode(F.sequence(F.lit(0), F.lit(tb - 1))).alias("tb"), "db")
    tt = t.withColumn("tb", F.pmod(F.xxhash64("term"), F.lit(tb)).cast("int"))
    tt = tt.select("term", "v", "tb", F.explode(F.sequence(F.lit(0), F.lit(db - 1))).alias("db"))

    def pair(tp: pd.DataFrame, dp: pd.DataFrame) -> pd.DataFrame:
        if len(tp) == 0 or len(dp) == 0:
            return pd.DataFrame({"term": pd.Series([], dtype=object), "rank": pd.Series([], dtype="int32"),
                                 "concept": pd.Series([], dtype=object), "score": pd.Series([], dtype="float64")})
        dp = dp.sort_values("concept", kind="stable")
        m = _stack(dp["v"])
        idx, sc = _topk(_stack(tp["v"]), m, np.linalg.norm(m, axis=1), k)
        kk = idx.shape[1]
        names = dp["concept"].to_numpy()
        return pd.DataFrame({"term": np.repeat(tp["term"].to_numpy(), kk),
                             "rank": np.tile(np.arange(1, kk + 1, dtype=np.int32), len(tp)),
                             "concept": names[idx.ravel()], "score": sc.ravel()})

    part = (tt.groupBy("tb", "db").cogroup(dd.groupBy("tb", "db"))
            .applyInPandas(pair, schema=OUT_SCHEMA))
    w = Window.partitionBy("term").orderBy(F.col("score").desc(), F.col("concept"))
    return (part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("term", F.col("rank").cast("int"), "concept", "score"))


def best_concepts_sparse(terms: DataFrame, dictionary: DataFrame, term: str = "term",
                         text: str = "text", key: str = "key", label: str = "label",
                         broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """M7 with bag-of-words vectors (distinct lower-case word tokens, binary weights).

    cosine = shared tokens / sqrt(tokens(term) x tokens(entry)).  Returns
    (term, semantics, score) with the ``label`` of the best entry; ties go to the
    smaller ``key``.  Terms sharing no token with any entry get no row.
    """
    qt = terms.select(F.col(term).alias("term"), F.array_distinct(tokenize(text)).alias("tk"))
    qt = qt.select("term", F.size("tk").alias("nq"), F.explode_outer("tk").alias("tok")).filter(
        F.col("tok").isNotNull())
    ct = dictionary.select(F.col(key).alias("key"), F.col(label).alias("label"),
                           F.array_distinct(tokenize(text)).alias("tk"))
    ct = ct.select("key", "label", F.size("tk").alias("nc"), F.explode_outer("tk").alias("tok")).filter(
        F.col("tok").isNotNull())
    pairs = qt.join(ct, "tok").groupBy("term", "key", "label", "nq", "nc").agg(
        F.count(F.lit(1)).alias("dot"))
    pairs = pairs.withColumn("score", F.col("dot") / F.sqrt(F.col("nq") * F.col("nc")))
    best = pairs.groupBy("term").agg(F.min(F.struct((-F.col("score")).alias("ns"), "key", "label")).alias("b"))
    return best.select("term", F.col("b.label").alias("semantics"), (-F.col("b.ns")).alias("score"))


def distinct_dictionary(dictionary: DataFrame, abr: str = "abr_symptoms",
                        category: str = "categories") -> DataFrame:
    """Dimension for J4/A4: one row per (abr, category).

    The original joins the raw dictionary and multiplies frequencies when an abbreviation
    repeats; a distinct dimension keeps the left joins exact.
    """
    return dictionary.select(F.col(abr).alias("abr"), F.col(category).alias("category")).distinct()


def map_mentions(mentions: DataFrame, best: DataFrame, dictionary: DataFrame,
                 term: str = "symptom_adjusted", cutoff: float = SEMANTIC_CUTOFF,
                 abr: str = "abr_symptoms", category: str = "categories",
                 count_col: str | None = None) -> DataFrame:
    """M8: attach the mapped concept and its category to every mention row.

    ``best`` is (term, semantics, score) from M7.  Steps: term frequency (A2), cut-off
    (F10), frequency per mapped concept (A3), mention x best match (J5), mapped concept
    x dictionary (J4), mention x mapped concept (J6).  Adds ``score``, ``symptom`` and
    ``lancet_category`` to each mention; unmapped mentions keep NULLs.

    ``count_col``: ``mentions`` is already aggregated (one row per term and other keys
    with a count); the mapping depends on the term only, so mapping the aggregate is exact
    and the joins then touch one row per key instead of one per mention.
    """
    n = F.count(F.lit(1)) if count_col is None else F.sum(count_col)
    freq = mentions.filter(F.col(term).isNotNull()).groupBy(term).agg(n.alias("frequency"))
    b = best.select(F.col("term").alias(term), "semantics", "score")
    cut = similarity_cutoff(freq.join(b, term), "score", "semantics", cutoff)
    mapped = cut.groupBy("semantics").agg(F.sum("frequency").alias("frequency"))
    dim = distinct_dictionary(dictionary, abr, category)
    mapped_cat = mapped.join(dim, F.col("semantics") == F.col("abr"), "left").select(
        F.col("semantics").alias("symptom"), F.col("category").alias("lancet_category"))
    # one row per distinct term: Spark broadcasts it once measured small, so a hot term
    # makes no hot partition; beyond the threshold the skew join splits a hot term
    enriched = mentions.join(cut.select(term, "semantics", "score"), term, "left")
    enriched = enriched.join(mapped_cat, F.col("semantics") == F.col("symptom"), "left")
    return enriched.drop("semantics")


def semantic_frequency(freq_best: DataFrame, cutoff: float = SEMANTIC_CUTOFF) -> DataFrame:
    """A3: summed term frequency per mapped concept after the cut-off: (semantics, count)."""
    cut = similarity_cutoff(freq_best, "score", "semantics", cutoff)
    return cut.groupBy("semantics").agg(F.sum("frequency").alias("count"))
