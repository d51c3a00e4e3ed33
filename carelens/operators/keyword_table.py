"""Keyword search with spans for keyword lists held in a table (M1).

Same rules as ``keywords.keyword_search``: case-insensitive, whole words (only ASCII letters,
digits and ``_`` are word characters), the longest keyword at a start, no overlaps, left to
right.  That operator turns a short list into one regular expression; here the list is a
DataFrame of any length, and each task matches with an Aho-Corasick automaton.

A long table is first reduced, by a bitmap, to the keywords whose words all occur in the
texts; so what a task holds follows the keywords that can match, not the table.

The table is dealt by hash into blocks of at most about ``block_rows`` keywords and
``block_bytes`` bytes, sized by an aggregate beforehand; a block is what a task holds.  One
block is the usual case: one scan, spans settled in the task, nothing shuffled.  More blocks
are more scans of the texts, each giving its candidates (the longest per start); the
candidates of a text then meet by its number and are settled by the same walk.  So the rows
are the same however many blocks there are.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..llm.slots import parted, slot_words
from ..session import scratch_path

SPANS = "array<struct<keyword:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("keyword", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_WORD = re.compile("[A-Za-z0-9_]")
#: Longer keyword tables are first reduced to the keywords whose words occur in the texts.
LIVE_ROWS = 10_000


def automaton(rows: list[tuple[str, str]]) -> ahocorasick.Automaton | None:
    """Of (lower-case keyword, keyword as given) rows; the greatest spelling of one keyword wins."""
    found = ahocorasick.Automaton()
    for low, given in sorted(rows):
        found.add_word(low, (len(low), given))
    if not len(found):
        return None
    found.make_automaton()
    return found


def longest_per_start(machine, text: str) -> list[tuple[int, int, str]]:
    """(start, end, keyword): whole-word matches, the longest of each start, in order."""
    best: dict[int, tuple[int, str]] = {}
    size = len(text)
    for last, (length, given) in machine.iter(text):
        start, end = last - length + 1, last + 1
        if start and _WORD.match(text, start - 1) or end < size and _WORD.match(text, end):
            continue
        if start not in best or best[start][0] < end:
            best[start] = (end, given)
    return [(s, *best[s]) for s in sorted(best)]


def leftmost(candidates: list[tuple[int, int, str]]) -> list[dict]:
    """The matches of a walk from left to right that skips what overlaps the last one taken;
    ``candidates`` are sorted by start, then the longest first."""
    out, free = [], 0
    for start, end, given in candidates:
        if start >= free:
            out.append({"keyword": given, "start": start, "end": end})
            free = end
    return out


def _match_task(shared, settle: bool):
    def run(batches):
        machine = automaton(shared.value)
        for batch in batches:
            out = []
            for text in batch.column("low"):
                found = longest_per_start(machine, text.as_py() or "") if machine else []
                out.append(leftmost(found) if settle else
                           [{"keyword": k, "start": s, "end": e} for s, e, k in found])
            columns = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "low"]
            names = [n for n in batch.schema.names if n != "low"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, _SPAN)], names=[*names, "spans"])
    return run


def _settle_task(batches):
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            found = sorted(((s["start"], s["end"], s["keyword"]) for s in spans),
                           key=lambda s: (s[0], -s[1], s[2]))
            out.append(leftmost(found))
        yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(out, _SPAN))


def _live(words: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``words`` whose runs of word characters may all be runs of ``texts`` (low).

    A match begins and ends at the edge of a run, so each run of a keyword is a whole run of
    its text; others cannot match.  The runs of the texts meet in a bitmap, which may let
    a few more keywords through.  A keyword without a run stays.
    """
    def runs(df):
        return F.array_distinct(F.regexp_extract_all(df["low"], F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    held = slot_words(texts.select(F.explode_outer(runs(texts)).alias("run")).filter("run IS NOT NULL"),
                      F.xxhash64("run"))
    each = words.withColumn("runs", runs(words)).withColumn("n", F.size("runs"))
    bare = each.filter("n = 0").select("given", "low")
    each = each.select("given", "low", "n", F.explode_outer("runs").alias("run")).filter("run IS NOT NULL")
    inside = parted(each, F.xxhash64("run"), held)[1]
    whole = inside.groupBy("given", "low", "n").agg(F.count(F.lit(1)).alias("m")).filter("m = n").select("given", "low")
    path = scratch_path(words.sparkSession, "live-keywords")
    whole.unionByName(bare).write.parquet(path)
    return words.sparkSession.read.parquet(path)


def keyword_table_search(df: DataFrame, col_name: str, keywords: DataFrame, keyword_col: str = "keyword",
                         block_rows: int = 200_000, block_bytes: int = 16 << 20) -> DataFrame:
    """Adds ``keywords_<col_name>`` = array<struct<keyword, start, end>> (end exclusive).

    Null and empty keywords are left out; of spellings that differ in case the greatest is
    reported.  A null text, an empty keyword table and a text without a match give an empty
    list.  Repeated rows and any other columns stay as they are.
    """
    spark = df.sparkSession
    words = (keywords.select(F.col(keyword_col).alias("given"), F.lower(keyword_col).alias("low"))
             .filter("given IS NOT NULL AND low <> ''").distinct())
    measure = F.count(F.lit(1)), F.sum(F.octet_length("low") + F.octet_length("given"))
    n, size = words.agg(*measure).collect()[0]
    if n > LIVE_ROWS:
        words = _live(words, df.select(F.lower(F.col(f"`{col_name}`")).alias("low")))
        n, size = words.agg(*measure).collect()[0]
    blocks = max(1, -(-n // block_rows), -(-(size or 0) // block_bytes))
    block = F.pmod(F.xxhash64("low"), F.lit(blocks))

    def shared(b):
        rows = words.filter(block == b).select("low", "given").collect()       # one block, as sized above
        return spark.sparkContext.broadcast([(r["low"], r["given"]) for r in rows])

    out = "keywords_" + col_name
    given = [c for c in df.columns if c != out]
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)),
                     F.lower(F.col(f"`{col_name}`")).alias("low"))
    kept = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(given))
    if blocks == 1:
        found = rows.mapInArrow(_match_task(shared(0), True), f"{kept}, spans {SPANS}")
    else:
        path = scratch_path(spark, "keyword-texts")
        rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
        stored = spark.read.parquet(path)
        parts = None
        for b in range(blocks):
            part = stored.select("row", "low").mapInArrow(_match_task(shared(b), False), f"row long, spans {SPANS}")
            part = part.filter(F.size("spans") > 0)
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")) \
            .mapInArrow(_settle_task, f"row long, spans {SPANS}")
        found = stored.join(merged, "row", "left").withColumn(
            "spans", F.coalesce("spans", F.array().cast(SPANS)))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(given)), F.col("spans").alias(out))
