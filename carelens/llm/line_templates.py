"""Line deduplication with a log-template tree of fixed depth.

A line's tokens are its words; a token with a digit is a variable field, ``<*>``.  The tree
parses a line by its token count and then its first ``depth`` tokens; in the leaf, lines
that agree in ``similarity`` of their positions are one template, whose differing positions
become ``<*>`` too.  Templates that recur in ``min_docs`` or more distinct documents are
dropped from all documents but the first that holds one.

Copies of one another are not distinct documents: where ``min_docs`` different texts hold a
template, those texts are dealt into near-duplicate classes (order_minhash), and the classes
are counted.  So a text with thousands of copies or near copies is not a template (finding
these is another operator's work), and a footer on unrelated pages is one, however many
copies some page has and however much the pages share.

Texts are told apart by their hash, also under one id.

Only leaves that can hold a recurring template are parsed further: leaf counts come first,
on hashes alone.  In those, equal lines are one line (an aggregate), so a line in a third
of all documents is parsed once.  The tree has one depth at every size: a leaf with more
than ``leaf_lines`` different lines is parsed in hash parts, whose (far fewer) templates are
then merged by the same similarity, in rounds, until one task can hold them all.  Where
they stay too many, the rounds bring together what agrees in one band of positions: of two
lines similar enough, at least one band agrees, so each such pair meets.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from .order_minhash import near_duplicates
from .slots import SLOTS, parted, slot_bits, slot_words
from .words import Rolling, join_names, mix, signed, steps

VARIABLE = "<*>"
_VARIABLE_NAME = np.uint64(0x7C3A11E5D00D5EED)
_LINES = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("leaf", pa.int64()),
                    ("line", pa.int64()), ("who", pa.int64())])


def _line_table(words, depth: int):
    """(document, line number, leaf, line, first word, end word) of every line with a word."""
    data, start = words.data, words.start
    if not len(start):
        return (np.zeros(0, np.int64),) * 6
    lo, hi = int(start[0]), int(words.end[-1])
    digits = np.concatenate([[0], np.cumsum((data[lo:hi] >= 48) & (data[lo:hi] <= 57))])
    name = np.where(digits[words.end - lo] > digits[start - lo], _VARIABLE_NAME, words.name)
    breaks = np.concatenate([[0], np.cumsum(data[lo:hi] == 10)])[start - lo]
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
    fresh = np.ones(len(start), bool)
    fresh[1:] = (np.diff(breaks) != 0) | (np.diff(doc) != 0)
    first = np.flatnonzero(fresh)
    end = np.append(first[1:], len(start))
    roll = Rolling(name)
    n = (end - first).astype(np.uint64)
    leaf = mix(roll.of(first, np.minimum(first + depth, end)) + n)
    return doc[first], breaks[first], leaf, roll.of(first, end), first, end


def _line_numbers(words, doc, breaks):
    """Breaks before a line, counted from the start of its text."""
    text_start = words.text_start[doc]
    lo = int(words.start[0]) if len(words.start) else 0
    at = np.flatnonzero(words.data[int(words.text_start[0]):int(words.text_end)] == 10) + int(words.text_start[0])
    return breaks + np.searchsorted(at, lo) - np.searchsorted(at, text_start)


def _lines_task(depth: int):
    def run(batches):
        for batch, words in steps(batches):
            doc, breaks, leaf, line, first, _ = _line_table(words, depth)
            if not len(doc):
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)),
                 pa.array(_line_numbers(words, doc, breaks).astype(np.int32)),
                 pa.array(signed(leaf)), pa.array(signed(line)), batch.column("who").take(pa.array(doc))],
                schema=_LINES)
    return run


def _texts_task(depth: int, leaves):
    """(leaf, line, text) of the different lines whose leaf may be one of ``leaves``."""
    def run(batches):
        inside = leaves.value
        for _, words in steps(batches):
            _, _, leaf, line, first, end = _line_table(words, depth)
            hit = np.flatnonzero(inside[(leaf & np.uint64(SLOTS - 1)).astype(np.int64)]) if len(leaf) else []
            if not len(hit):
                continue
            hit = hit[np.unique(join_names(leaf[hit], line[hit]), return_index=True)[1]]
            lo, hi = words.start[first[hit]].tolist(), words.end[end[hit] - 1].tolist()
            text = [words.data[a:b].tobytes() for a, b in zip(lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(leaf[hit])), pa.array(signed(line[hit])), pa.array(text, pa.binary()).cast(pa.string())],
                names=["leaf", "line", "text"])
    return run


def parse_leaf(lines: list[list[str]], similarity: float) -> list[list[str]]:
    """The template of each line of one leaf (all of one length), in the order given.

    Each line joins the most similar template, the oldest on ties, or founds one.
    """
    codes: dict[str, int] = {VARIABLE: 0}
    rows = np.array([[codes.setdefault(t, len(codes)) for t in line] for line in lines], np.int32)
    width = rows.shape[1]
    found = np.empty((width, len(rows)), np.int32)         # a column for each template: sums run along rows
    number = np.uint8 if width < 256 else np.int32
    home = np.empty(len(rows), np.int64)
    count = 0
    for i, row in enumerate(rows):
        if count:
            same = (found[:, :count] == row[:, None]).sum(axis=0, dtype=number)
            best = int(np.argmax(same))
            if same[best] >= similarity * width:
                found[found[:, best] != row, best] = 0
                home[i] = best
                continue
        found[:, count] = row
        home[i] = count
        count += 1
    token = list(codes)
    named = [[token[c] for c in t] for t in found[:, :count].T.tolist()]
    return [named[h] for h in home.tolist()]


def _parse_task(similarity: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line", kind="stable")
        tokens = [list(t) for t in part["tokens"]]
        templates = [" ".join(t) for t in parse_leaf(tokens, similarity)]
        return pd.DataFrame({"leaf": part["leaf"], "line": part["line"], "template": templates})
    return run


def _merge_task(similarity: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "template"], ascending=[False, True], kind="stable")
        merged = [" ".join(t) for t in parse_leaf([t.split(" ") for t in part["template"]], similarity)]
        return pd.DataFrame({"leaf": part["leaf"], "template": part["template"], "merged": merged})
    return run


def _bands(template: Column, depth: int, similarity: float) -> Column:
    """Hashes of one more band of positions than a similar line may differ in."""
    tokens = F.split(template, " ")
    width = F.size(tokens)
    rest = F.greatest(width - depth, F.lit(0))
    bands = (width - F.ceil(width * similarity - 1e-9) + 1).cast("int")

    def edge(j):
        return F.floor(j * rest / bands).cast("int")

    return F.transform(F.sequence(F.lit(0), bands - 1), lambda j: F.xxhash64(
        F.slice(tokens, edge(j) + depth + 1, edge(j + 1) - edge(j))))


def _wide_templates(names: DataFrame, depth: int, similarity: float, leaf_lines: int, stored) -> DataFrame:
    """(leaf, line, template) of wide leaves; ``names`` has the lines themselves as templates."""
    done = []
    bands = F.posexplode(_bands(F.col("template"), depth, similarity)).alias("band", "key")
    # a line without a variable that shares no band with another is a template of its own
    shared = stored(names.select("leaf", bands).groupBy("leaf", "band", "key").agg(F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").select("leaf", "band", "key"), "shared-bands")
    meets = names.select("leaf", "line", bands).join(shared, ["leaf", "band", "key"]).select("leaf", "line")
    varies = names.filter(F.array_contains(F.split("template", " "), VARIABLE)).select("leaf", "line")
    meets = stored(meets.unionByName(varies).distinct(), "meeting-lines")
    done.append(names.join(meets, ["leaf", "line"], "left_anti"))
    names = stored(names.join(meets, ["leaf", "line"], "left_semi"), "wide-lines")
    step, band, last, before = 0, -1, -1, None
    while True:
        items = stored(names.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n"))
                       .withColumn("keys", _bands(F.col("template"), depth, similarity)), "wide-templates")
        wide = stored(items.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf_lines)
                      .select("leaf", F.lit(True).alias("wide")), "wide-leaves")
        if band < 0:                                       # one sweep: the whole leaf, then each band
            count, last = items.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("keys")), F.lit(0))).first()
            if count == before:
                return functools.reduce(DataFrame.unionByName, done + [names])
            before = count
        # leaves that fit one task are parsed whole, and for the last time
        key = F.lit(0).cast("long") if band < 0 else F.get("keys", F.lit(band))
        placed = (items.join(wide, "leaf", "left").withColumn("key", F.when(F.col("wide"), key).otherwise(F.lit(0)))
                  .filter("key IS NOT NULL"))
        sizes = (placed.groupBy("leaf", "key").agg(F.ceil(F.count(F.lit(1)) / leaf_lines).cast("int").alias("parts"),
                                                   F.count(F.lit(1)).alias("m"))
                 .filter("m > 1").drop("m"))
        dealt = (placed.join(stored(sizes, "wide-parts"), ["leaf", "key"])
                 .withColumn("part", F.pmod(F.xxhash64("template", F.lit(step)), F.col("parts"))))
        moved = stored(dealt.select("leaf", "key", "part", "template", "n").groupBy("leaf", "key", "part").applyInPandas(
            _merge_task(similarity), "leaf long, template string, merged string"), "merged")
        names = stored(names.join(moved, ["leaf", "template"], "left")
                       .select("leaf", "line", F.coalesce("merged", "template").alias("template")), "wide-lines")
        done.append(names.join(wide, "leaf", "left_anti"))
        if wide.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        names = stored(names.join(wide, "leaf", "left_semi"), "still-wide")
        step, band = step + 1, band + 1 if band + 1 < last else -1


def line_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3,
                   similarity: float = 0.7, min_docs: int = 10,
                   leaf_lines: int = 5000) -> DataFrame:
    """(doc_id, line_no, template, first_doc, who, first_who): every line that falls under a
    recurring template; ``who`` is the hash of the text that holds it.

    ``line_no`` counts line breaks from 0.  Lines without a word are no lines.  Null or empty
    texts and rows without an id hold none.  Rows repeated under one id are told apart by
    their texts; equal ones count as one document.  Further columns are ignored.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    texts = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
             .filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("who", F.xxhash64("text")))
    lines = stored(texts.mapInArrow(_lines_task(depth), "doc_id long, line_no int, leaf long, line long, who long"),
                   "lines")
    leaves = stored(lines.groupBy("leaf").agg(F.count_distinct("who").alias("n")).filter(F.col("n") >= min_docs)
                    .select("leaf"), "leaves")
    held = stored(lines.join(leaves, "leaf"), "leaf-lines")

    # a second scan gives the lines' texts: leaves are looked up in a bitmap, then exactly
    inside = spark.sparkContext.broadcast(slot_bits(slot_words(leaves, F.col("leaf"))))
    words = F.filter(F.split("text", r"[ \x09-\x0D]+"), lambda t: t != "")
    tokens = stored(
        texts.mapInArrow(_texts_task(depth, inside), "leaf long, line long, text string")
        .groupBy("leaf", "line").agg(F.any_value("text").alias("text")).join(leaves, "leaf", "left_semi")
        .select("leaf", "line", F.transform(words, lambda t: F.when(t.rlike("[0-9]"), VARIABLE).otherwise(t))
                .alias("tokens")), "tokens")
    wide = stored(tokens.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > leaf_lines)
                  .select("leaf"), "wide-leaves")
    template = tokens.join(wide, "leaf", "left_anti").groupBy("leaf").applyInPandas(
        _parse_task(similarity), "leaf long, line long, template string")
    if not wide.isEmpty():
        names = stored(tokens.join(wide, "leaf", "left_semi").select(
            "leaf", "line", F.array_join("tokens", " ").alias("template")), "wide-lines")
        template = template.unionByName(_wide_templates(names, depth, similarity, leaf_lines, stored))
    template = stored(template, "templates")

    named = stored(held.join(template, ["leaf", "line"])
                   .select("doc_id", "line_no", "who", "template"), "template-lines")
    often = stored(named.groupBy("template").agg(F.count_distinct("who").alias("n"),
                                                 F.min(F.struct("doc_id", "who")).alias("first"))
                   .filter(F.col("n") >= min_docs).select("template", "first"), "often-held")
    held = stored(named.join(often.select("template"), "template"), "often-held-lines")
    holders = stored(held.groupBy("who").agg(F.min("doc_id").alias("doc_id")), "holders")
    # one row of each text, named by its hash; a few others may come along and change nothing
    key = F.xxhash64("doc_id", "who")
    unlike = parted(texts, key, slot_words(holders, key))[1].select("who", "text")
    classes = stored(near_duplicates(unlike, "who").distinct().withColumnRenamed("doc_id", "who"), "holder-classes")
    distinct = (held.select("template", "who").distinct().join(classes, "who")
                .groupBy("template").agg(F.count_distinct("class_id").alias("n")).filter(F.col("n") >= min_docs))
    recurring = stored(often.join(distinct, "template").select(
        "template", F.col("first.doc_id").alias("first_doc"), F.col("first.who").alias("first_who")), "recurring")
    return held.join(recurring, "template").select("doc_id", "line_no", "template", "first_doc", "who", "first_who")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the lines of recurring templates, first holders excepted.

    One row per input row with all its columns, plus n_dropped (lines) and kept_text; the
    rest of the text is unchanged.  A null text stays null.  A row without an id loses no
    line.  Rows with one id and one text lose the same lines.  Input columns named n_dropped
    or kept_text are replaced.
    """
    path = scratch_path(docs.sparkSession, "dropped-lines")
    (line_templates(docs, id_col, text_col, **options).filter("doc_id <> first_doc OR who <> first_who")
     .groupBy(F.col("doc_id").alias("__id"), F.col("who").alias("__who"))
     .agg(F.collect_set("line_no").alias("__drop")).write.parquet(path))
    drop = docs.sparkSession.read.parquet(path)
    given = [c for c in docs.columns if c not in ("n_dropped", "kept_text")]
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    # texts that lose no line stay where they are
    whole, some = parted(docs, F.when(id_.isNotNull() & text.isNotNull(), F.xxhash64(id_, F.xxhash64(text))),
                         slot_words(drop, F.xxhash64("__id", "__who")))
    whole = whole.select(*given, F.lit(0).alias("n_dropped"), text.alias("kept_text"))
    some = some.join(drop.hint("merge"), (id_ == drop["__id"]) & (F.xxhash64(text) == drop["__who"]), "left")
    some = some.withColumn("__lines", F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    some = some.select(*given, F.coalesce(F.array_size("__drop"), F.lit(0)).alias("n_dropped"),
                       F.when(F.col("__drop").isNull(), text).otherwise(kept).alias("kept_text"))
    return whole.unionByName(some)
