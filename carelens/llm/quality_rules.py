"""Quality rules: per-text base figures and cross-document line frequency per host.

DataFrame functions only.  A line is normalised (lower case, digits to 0, other signs to
one space) and hashed; the number of distinct documents of a host that hold it decides
whether it is boilerplate there, against the number of the host's distinct documents.
Documents are told apart by their whole texts: equal copies are one document on both sides,
so copies neither make boilerplate nor hide it.  Near copies are distinct (finding them is
another operator's work).

A boilerplate line is removed from every document of the host but the first that has it
(by id; copies of that one keep it too).  A document is *depleted*, and rejected, when
fewer than ``min_kept_words`` words or ``min_kept_pct`` percent of its words remain.

Counts are aggregates with partial results per task; the only joins are on (host, line
hash), which adaptive execution splits where a host or a line is hot, and on the document.
Texts are never shuffled for the verdict; they are for ``kept_text``, if it is selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[ \x09-\x0D]+"
NO_BLANK = r"[^ \x09-\x0D]"
SYMBOLS = "[#*$%&|<>]+"


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def line_hashes(text: Column) -> Column:
    """64-bit hex hashes of the normalised lines; null where nothing but signs is left."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[^\p{L}0\n]+", " ")
    return F.transform(F.split(norm, "\n"), lambda x: F.when(
        F.trim(x) != "", F.substring(F.md5(F.trim(x)), 1, 16)))


def base_figures(docs: DataFrame, text: str, window: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if window & (window - 1):
        raise ValueError("window is a power of two")
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({
        "__words": word_array(t),
        "__rows": F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(NO_BLANK))),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_dup_lines": (F.size("__rows") - F.size(F.array_distinct("__rows"))).cast("long"),
        "__h": F.transform("__words", lambda w: F.xxhash64(w)),
    }).drop("__words", "__rows")
    # the name of a window of 2k words is the hash of the names of its halves
    k = 1
    while k < window:
        n = F.greatest(F.size("__h") - k, F.lit(0))
        out = out.withColumn("__h", F.zip_with(F.slice("__h", 1, n), F.slice("__h", 1 + k, n),
                                               lambda a, b: F.xxhash64(a, b)))
        k *= 2
    out = out.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__h")) < F.size("__h"),
        F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    out = out.withColumn("__at", F.sort_array(F.filter(F.transform(
        s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])),
        lambda p: p.isNotNull())))
    at = F.col("__at")
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window)))),
        F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    # generated columns are not pushed down: a later filter on a figure must not compute it anew
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = [c for c in out.columns if c not in (*figures, "__h", "__sorted", "__at")]
    return out.select(*rest, F.inline(F.array(F.struct(*figures))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source", min_words: int = 20, max_repeat_pct: int = 30,
                  line_docs: int = 20, line_pct: int = 2, min_kept_words: int = 20,
                  min_kept_pct: int = 10) -> DataFrame:
    """Judge every document; one row per input row, with all input columns.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_kept_words, kept and kept_text (the text without the removed lines, unchanged if none
    is).  A line is removed if more than ``line_docs`` distinct documents of its host hold
    it and these are more than ``line_pct`` percent of the host's distinct documents; the first
    of them keeps it.

    A null or empty text has no words and fails the base rules (kept_text stays null or
    empty).  Documents with a null host share one host.  Rows without an id lose no line.
    Rows repeated under one id and text are judged alike.  An empty table gives no rows; long
    texts cost time linear in their lines.  Input columns named like a
    result column are replaced by the result.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "n_kept_words", "kept", "kept_text")
    keys = {"__id": F.col(id_col), "__text": F.xxhash64(F.col(text_col)),
            "__host": F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))}
    keyed = docs.withColumns(keys)
    hashes = keyed.filter(F.col(text_col).isNotNull()).select(
        "__id", "__text", "__host", F.col(text_col).alias("__t"), line_hashes(F.col(text_col)).alias("hs"))
    counted = (hashes.select("__id", "__text", "__host", F.explode(F.array_distinct("hs")).alias("h"))
               .filter("h IS NOT NULL"))
    placed = (hashes.select("__id", "__text", "__host", F.posexplode(F.arrays_zip("hs", F.transform(
                                F.split("__t", "\n"), lambda x: F.size(word_array(x))).alias("w"))))
              .select("__id", "__text", "__host", "pos", F.col("col.hs").alias("h"), F.col("col.w").alias("w"))
              .filter("h IS NOT NULL"))

    per_host = (hashes.select("__host", "__text").distinct().groupBy("__host")
                .agg(F.count(F.lit(1)).alias("docs")))
    common = (counted.groupBy("__host", "h", "__text").agg(F.min("__id").alias("__id"))
              .groupBy("__host", "h").agg(F.count(F.lit(1)).alias("n"),
                                          F.min(F.struct("__id", "__text"))["__text"].alias("first"))
              .filter(F.col("n") > line_docs)
              .join(per_host, "__host").filter(F.col("n") * 100 > F.col("docs") * line_pct)
              .select("__host", "h", "first"))
    gone = (placed.join(common, ["__host", "h"]).filter("__text <> first")
            .groupBy("__id", "__text").agg(F.collect_set(F.struct("pos", "w")).alias("__gone")))

    judged = base_figures(keyed, text_col).join(gone, ["__id", "__text"], "left")
    lost = F.aggregate("__gone", F.lit(0).cast("long"), lambda a, x: a + x["w"])
    judged = judged.withColumn("n_kept_words", F.col("n_words") - F.coalesce(lost, F.lit(0)))
    judged = judged.withColumn("base_failed", (F.col("n_words") < min_words)
                               | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("n_kept_words") >= min_kept_words)
                               & (F.col("n_kept_words") * 100 >= F.col("n_words") * min_kept_pct))
    rows = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), F.transform("__gone", lambda g: g["pos"]))
    judged = judged.withColumns({"__rows": F.when(F.col("__gone").isNotNull(), rows),
                                 "__stay": F.when(F.col("__gone").isNotNull(), stay)})
    clean = F.array_join(F.transform("__stay", lambda i: F.get("__rows", i)), "\n")
    judged = judged.withColumn("kept_text", F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(clean))
    return judged.select(*[c for c in docs.columns if c not in made], *made)
