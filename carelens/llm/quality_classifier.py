"""Quality by hierarchical empirical Bayes.

A logistic regression on figures of the text gives each document's evidence, the
probability that it is good.  Sites then supply the prior: the evidence of all documents is
summed by host and by path of a host, and the rates are shrunk level by level - hosts toward
the global rate, paths toward their host - by Beta priors whose strength is estimated from
how much the rates of a level differ beyond chance.  A site with few documents keeps nearly
its parent's rate.  The document's odds are its evidence's odds with the global rate in
them replaced by its path's.

The regression is fitted on the first ``sample_rows`` labelled rows by the hash of their id;
everything else covers all rows: one scan for the evidence, an aggregate by (host, path) with
partial sums per task, and a join of the scores with the much smaller table of sites.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .toxicity import _logistic
from .words import steps

#: Byte classes whose share in the text is a figure.
CLASSES = {"symbols": b"#*$%&|<>@^~_=+\\", "upper": bytes(range(65, 91)), "digits": b"0123456789",
           "marks": b"!?", "points": b".,;:", "breaks": b"\n", "bars": b"|{}[]()"}
FIGURES = (*CLASSES, "log_words", "distinct", "repeats", "word_bytes")
_LEAST = 1e-6


def figures(words) -> np.ndarray:
    """One row of FIGURES per text."""
    lo, hi = int(words.text_start[0]) if len(words.text_start) else 0, words.text_end
    data = words.data[lo:hi]
    edges = np.append(words.text_start, hi) - lo
    size = np.maximum(np.diff(edges), 1)
    n = words.counts()
    out = []
    for members in CLASSES.values():
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        total = np.concatenate([[0], np.cumsum(table[data])])
        out.append((total[edges[1:]] - total[edges[:-1]]) / size)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words.name, doc))
    name, owner = words.name[order], doc[order]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    same = np.zeros(len(name), bool)
    same[1:] = (words.name[1:] == words.name[:-1]) & (doc[1:] == doc[:-1])
    at_least = np.maximum(n, 1)
    out += [np.log1p(n), np.bincount(doc[order][fresh], minlength=len(n)) / at_least,
            np.bincount(doc[same], minlength=len(n)) / at_least,
            np.bincount(doc, weights=words.end - words.start, minlength=len(n)) / at_least]
    return np.column_stack(out)


@dataclasses.dataclass
class Evidence:
    """A fitted regression: mean and spread of the figures, and the weights."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = _terms((x - self.mean) / self.spread) @ self.weights[1:] + self.weights[0]
        return np.clip(1 / (1 + np.exp(-np.clip(z, -35, 35))), _LEAST, 1 - _LEAST)


def _terms(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.column_stack([z, z * z])


def _figures_task(batches):
    for batch, words in steps(batches):
        x = figures(words)
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", sample_rows: int = 20_000) -> Evidence:
    """Fit on labelled rows; without both labels the evidence is one half for every text."""
    picked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .filter("doc_id IS NOT NULL AND label IN (0, 1)").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows))
    texts = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
             .filter("doc_id IS NOT NULL"))
    # at most sample_rows pairs of numbers are broadcast; figures, not texts, come back
    rows = (texts.join(F.broadcast(picked), "doc_id").select("label", "text")
            .mapInArrow(_figures_task, "label int, x array<double>").toArrow())
    n = len(FIGURES)
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, n)
    y = rows.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))                       # the same sums in any order of rows
    x, y = x[order], y[order]
    if len(np.unique(y)) < 2:
        return Evidence(np.zeros(n), np.ones(n), np.zeros(2 * n + 1))
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weights = np.array(_logistic(_terms((x - mean) / spread), y, ridge=1.0))
    return Evidence(mean, spread, weights)


def _evidence_task(model: Evidence):
    def run(batches):
        for batch, words in steps(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "host", "path")]
                + [pa.array(model(figures(words)))], names=["doc_id", "host", "path", "evidence"])
    return run


def _strength(groups: DataFrame, rate, parent) -> float:
    """Strength (pseudo-count) of the Beta prior of a level, by the method of moments.

    ``groups`` has n documents each; the rates' spread around the parent's rate, less what
    chance gives, is the spread between groups.
    """
    mean, spread, chance = groups.agg(
        F.sum(F.col("n") * parent) / F.sum("n"),
        F.sum(F.col("n") * (rate - parent) ** 2) / F.sum("n"),
        F.sum(parent * (1 - parent)) / F.sum("n")).collect()[0]
    if mean is None:
        return 1.0
    between = max(spread - chance, 1e-9)
    return float(min(max(mean * (1 - mean) / between - 1, 1.0), 1e6))


def quality_scores(docs: DataFrame, model: Evidence, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, evidence, prior, score, kept): one row per row of ``docs``.

    ``path_col`` is the section of the host (in these documents the language, which is also
    the first part of the pages' paths).  Null hosts and paths are sites of their own.  A
    null text counts as empty.  ``kept`` is score >= threshold.  Null and repeated ids and
    repeated rows are scored as they come; an empty table gives no rows; further columns are
    ignored; texts are read whole, about a megabyte (or one longer text) at a time.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    def key(c):
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       key(host_col)("host"), key(path_col)("path"))
    scored = stored(rows.mapInArrow(
        _evidence_task(model), "doc_id long, host string, path string, evidence double"), "evidence")
    # sums of whole millionths: the same in any order
    paths = stored(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("evidence") * 1e6).cast("long")) / 1e6).alias("s")),
        "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = paths.agg(F.sum("n"), F.sum("s")).collect()[0]
    rate = F.col("s") / F.col("n")
    overall = min(max((total[1] or 0) / total[0], _LEAST), 1 - _LEAST) if total[0] else 0.5
    k = _strength(hosts, rate, F.lit(overall))
    hosts = hosts.select("host", ((F.col("s") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k = _strength(paths, rate, F.col("host_rate"))
    sites = stored(paths.select("host", "path", F.least(F.greatest(
        (F.col("s") + k * F.col("host_rate")) / (F.col("n") + k), F.lit(_LEAST)), F.lit(1 - _LEAST))
        .alias("prior")), "sites")

    def logit(c):
        return F.log(c / (1 - c))

    odds = logit(F.col("evidence")) - logit(F.lit(overall)) + logit(F.col("prior"))
    out = scored.join(sites, ["host", "path"]).withColumn("score", 1 / (1 + F.exp(-odds)))

    def name(c):
        return F.when(F.col(c) != "", F.substring(F.col(c), 2, 1 << 30)).alias(c)
    return out.select("doc_id", name("host"), name("path"), "evidence", "prior", "score",
                      (F.col("score") >= threshold).alias("kept"))
