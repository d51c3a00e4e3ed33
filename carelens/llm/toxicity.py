"""Toxicity: a weighted lexicon matched with Aho-Corasick in folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and, inside
words, digits and signs to the letters they stand for.  Patterns are whole words or word
beginnings (for languages that inflect); a word scores the greatest weight among the
patterns that fit it.  Words inside an exception phrase do not count.  The sum, also per
hundred words, goes through a fitted logistic curve, so a long text needs more than a short
one.

Lexicon, exceptions and curve are learned from a bounded sample of labelled rows: the
``sample_rows`` first by the hash of their id (20,000).  Copies teach nothing new: of the
texts that share their least hashed 5-word sequence only one is used.  Scoring is a scan of
whole texts without a shuffle; the model, at most ``max_terms`` patterns, is a constant.
"""

from __future__ import annotations

import collections
import dataclasses
import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .words import Rolling, steps

#: Fixed tables: letters of other scripts that look like Latin ones, and signs for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "l", "ꜱ": "s",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

# anything that folding may change: the soft hyphen and the dotless i, and all beyond these blocks
_FAR = re.compile("[^\\x00-\\u00ac\\u00ae-\\u0130\\u0132-\\u024f\\u1e00-\\u1eff\\u2010-\\u2026]")
_GLYPHS = str.maketrans(HOMOGLYPHS)
_JOINERS = re.compile("[\\u00ad\\u0300-\\u036f\\u200b-\\u200d\\u2060\\ufeff]")
# a run of word signs that holds a letter and one of SIGNS, without marks at its end
_MIXED = re.compile(r"(?<![\w@$!])(?=\w*[0134578@$!])(?=[\w@$!]*[^\W\d_])[\w@$!]*[\w@$]")
_SIGNS = str.maketrans(SIGNS)
_WORD = re.compile(r"[^\W\d_]+")
_LENGTHS = range(3, 9)                  # of word beginnings


def fold(text: str) -> str:
    """Lower case, with homoglyphs as Latin letters and signs inside words as letters."""
    text = text.lower()
    if _FAR.search(text):
        # accents that stand alone or were composed stay as they are in one form
        text = _JOINERS.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_GLYPHS)
    if any(sign in text for sign in SIGNS):
        text = _MIXED.sub(lambda m: m.group().translate(_SIGNS), text)
    return text


def terms_of(folded: str) -> set[str]:
    """Words and word beginnings (with a ``*``) of a folded text."""
    words = set(_WORD.findall(folded))
    return words | {w[:n] + "*" for w in words for n in _LENGTHS if len(w) > n}


@dataclasses.dataclass
class Model:
    """``terms``: pattern -> weight; ``exceptions``: phrases; ``curve``: intercept and slopes."""

    terms: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, float, float]

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        entries = {}
        for term, weight in self.terms.items():
            entries.setdefault(term.rstrip("*"), []).append((weight, term.endswith("*")))
        for text, kinds in entries.items():
            a.add_word(text, (len(text), kinds, False))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), entries.get(phrase, []), True))
        a.make_automaton()
        return a


def hits(automaton, folded: str) -> list[tuple[int, float]]:
    """(start, weight) of every word that fits a pattern, exception phrases left out."""
    if not len(automaton):
        return []
    best: dict[int, float] = {}
    spared = []
    size = len(folded)
    for end, (n, kinds, exception) in automaton.iter(folded):
        start = end - n + 1
        if start and (folded[start - 1].isalpha()):
            continue
        whole = end + 1 == size or not folded[end + 1].isalpha()
        if exception and whole:
            spared.append((start, end))
        for weight, open_ in kinds:
            if (open_ or whole) and weight > best.get(start, -math.inf):
                best[start] = weight
    out, reach, at = [], -1, 0
    spared.sort()
    for start in sorted(best):                           # one pass over both, by position
        while at < len(spared) and spared[at][0] <= start:
            reach = max(reach, spared[at][1])
            at += 1
        if start > reach:
            out.append((start, best[start]))
    return out


def evidence(automaton, text: str) -> tuple[float, float]:
    """(log of the summed weight, log of the weight per hundred words)."""
    folded = fold(text)
    total = sum(w for _, w in hits(automaton, folded))
    if total <= 0:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100 * total / max(1, len(folded.split())))


def _least_task(batches):
    """Rows with ``who``, the least hashed 5-word sequence of the text (or all its words)."""
    for batch, words in steps(batches):
        n = words.counts()
        end = words.first[1:]
        at = np.arange(len(words.name))
        roll = Rolling(words.name)
        h = roll.of(at, np.minimum(at + 5, np.repeat(end, n))) if len(at) else np.zeros(0, np.uint64)
        full = at + 5 <= np.repeat(end, n)
        first = at == np.repeat(words.first[:-1], n)
        h = np.where(full | first, h, np.uint64((1 << 64) - 1))
        who = [int(h[a:b].min().view(np.int64)) if b > a else 0 for a, b in zip(words.first[:-1], end)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), batch.column("text"), pa.array(who, pa.int64())],
            names=["doc_id", "label", "text", "who"])


def _terms_task(batches):
    for batch in batches:
        counts: dict[str, list[int]] = collections.defaultdict(lambda: [0, 0])
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
            for term in terms_of(fold(text.as_py())):
                counts[term][label] += 1
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "clean", "toxic"])


def _phrases_task(terms: dict[str, float]):
    """Two-word phrases around a matched word, by label."""
    def run(batches):
        automaton = Model(terms, [], (0, 0, 0)).automaton()
        for batch in batches:
            counts: dict[str, list[int]] = collections.defaultdict(lambda: [0, 0])
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                folded = fold(text.as_py())
                starts = {s for s, _ in hits(automaton, folded)}
                if not starts:
                    continue
                words = list(_WORD.finditer(folded))
                seen = set()
                for a, b in zip(words, words[1:]):
                    if (a.start() in starts or b.start() in starts) and folded[a.end():b.start()] == " ":
                        seen.add(folded[a.start():b.end()])
                for phrase in seen:
                    counts[phrase][label] += 1
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()),
                     pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "clean", "toxic"])
    return run


def _evidence_task(model: Model):
    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            got = [evidence(automaton, t.as_py()) for t in batch.column("text")]
            if got:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), *(pa.array(c, pa.float64()) for c in zip(*got))],
                    names=["label", "total", "rate"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> tuple[float, ...]:
    """Intercept and slopes by Newton steps; the ridge keeps separable data finite."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return tuple(w.tolist())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_rows: int = 20_000, max_terms: int = 500, least_docs: int = 8,
          least_odds: float = 3.0, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn a model from labelled documents.

    A pattern needs ``least_docs`` toxic texts and log odds of ``least_odds``; the
    ``max_terms`` best stay.  Two-word phrases around a matched word that stand in clean
    texts four times as often as in toxic ones, and in three at least, are exceptions, as
    are the given ``exceptions``.  Rows without an id, text or 0/1 label teach nothing;
    without toxic rows the lexicon is empty and every text scores 0.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    picked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .filter("doc_id IS NOT NULL AND label IN (0, 1)").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows))
    texts = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
             .filter("doc_id IS NOT NULL AND text IS NOT NULL"))
    kind = "doc_id long, label int, text string, who long"
    # at most sample_rows pairs of numbers are broadcast
    sample = stored(texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")
                    .mapInArrow(_least_task, kind), "toxic-sample")
    unique = sample.groupBy("who").agg(F.min(F.struct("doc_id", "label")).alias("one"))
    unique = unique.select("one.doc_id", "one.label")
    sample = stored(sample.join(F.broadcast(unique), ["doc_id", "label"]).dropDuplicates(["doc_id"]), "toxic-texts")
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)

    counts = "term string, clean long, toxic long"
    summed = (sample.mapInArrow(_terms_task, counts).groupBy("term")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    odds = (F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1)))
    best = (summed.filter(F.col("toxic") >= least_docs).withColumn("odds", odds)
            .filter(F.col("odds") >= least_odds).orderBy(F.desc("odds"), "term").limit(max_terms).collect())
    terms = {r["term"]: round(r["odds"], 6) for r in best}
    if not terms:
        return Model({}, [], (-math.inf, 0.0, 0.0))
    phrases = (sample.mapInArrow(_phrases_task(terms), counts).groupBy("term")
               .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
               .filter("clean >= 3 AND clean >= 4 * toxic").orderBy(F.desc("clean"), "term")
               .limit(max_terms).collect())
    model = Model(terms, sorted({r["term"] for r in phrases} | set(exceptions)), (0.0, 0.0, 0.0))
    rows = sample.mapInArrow(_evidence_task(model), "label int, total double, rate double").toArrow()
    x = np.column_stack([rows.column(c).to_numpy() for c in ("total", "rate")])
    model.curve = _logistic(x, rows.column("label").to_numpy().astype(float))
    return model


def _score_task(model: Model):
    def run(batches):
        automaton = model.automaton()
        base, *slopes = model.curve
        for batch in batches:
            out, found = [], []
            for t in batch.column("text"):
                x = evidence(automaton, t.as_py() or "")
                z = base + sum(a * b for a, b in zip(slopes, x))
                out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
                found.append(x[0] > 0)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(found, pa.bool_())],
                    names=["doc_id", "score", "matched"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, matched): one row per row of ``docs``; a null text scores as an empty one.

    Null and repeated ids and repeated rows are scored as they come; an empty table gives no
    rows; further columns are ignored.  Texts are folded and matched whole, in time linear in
    their length and their hits.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _score_task(model), "doc_id long, score double, matched boolean")
