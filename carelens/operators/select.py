"""Selection operators: collection predicate, date range, field selection, removed-row
filter, regex tagging, first-occurrence de-duplication, caps and report filters
(F1-F3, F6-F15, S5)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MIN_RESULT_CAP, NO_MATCH, REMOVED_MARKERS
from ..functions.patterns import NON_WORD, py_classes, trie_alternation


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------------------- F1, F2, F3
@dataclass(frozen=True)
class CollectConfig:
    """Parameters of the collection predicate (the run configuration's keyword, date,
    field and language sections)."""

    hashtags: tuple[str, ...] = ()
    include: tuple[str, ...] = ()          # exact phrases
    pre_req: tuple[str, ...] = ()          # at least one must occur
    exclude: tuple[str, ...] = ()          # words, or operators like "is:retweet"
    language: tuple[str, ...] = ("en",)    # only the first is used, as in the original
    start: str | None = None               # inclusive, ISO date or timestamp
    end: str | None = None                 # exclusive
    fields: tuple[str, ...] = ()
    user_fields: tuple[str, ...] = ()      # of the user record; () keeps it whole


#: FIXED VALUES: user fields that are requested whatever the configuration lists.
ALWAYS_USER_FIELDS = ("profile_image_url", "description")

# FIXED VALUES: the sample run configuration (keywords, dates, fields, language, cap).
SAMPLE_CONFIG = CollectConfig(
    hashtags=("longcovid", "covidlong", "longcovid19", "longhauler", "LongHaulers",
              "covidlonghauler", "StopTheLongHaul", "LongCovidRecovery", "LongCovidSymptoms",
              "postcovid19syndrome", "postcovidsyndrome", "CountLongCovid", "PostAcuteCovid19"),
    include=("long-hauler", "long-haulers", "long haul covid", "chronic symptoms",
             "long-term effects", "Post-Acute COVID-19 Syndrome", "long-hauler", "long covid",
             "Long Haulers Act", "longcovid", "long haul", "antigen test"),
    pre_req=("covid", "virus", "test", "pcr", "corona"),
    exclude=("roche", "is:retweet", "is:reply", "is:quote", "is:nullcast"),
    language=("en",),
    start="2017-01-01", end="2021-08-12",
    fields=("text", "created_at", "entities", "geo", "public_metrics", "context_annotations",
            "withheld"),
)
SAMPLE_RESULT_CAP = 10_000_000


def word_set_pattern(terms, prefix: str = "") -> str:
    """Existence pattern: any of ``terms`` (lower case) as whole words, ``prefix`` before each.

    Boundaries are consumed (``(^|\\W)...(\\W|$)``) rather than looked around, so the same
    pattern runs in Java regex and in RE2; for an exists test that is equivalent.
    """
    alt = trie_alternation([t.lower() for t in terms])
    return f"(^|{NON_WORD}){prefix}{alt}({NON_WORD}|$)"


def collect_predicate(cfg: CollectConfig, text: str = "text", lang: str = "lang",
                      flags: dict[str, str] | None = None, hashtag_col: str | None = None) -> Column:
    """F1 as a Column: (any pre-requisite word) AND (any hashtag OR any exact phrase)
    AND NOT any excluded word or flag AND language.

    Matching is case-insensitive (both sides lower-cased) and whole-word.  Hashtags are
    matched as ``#tag`` words in the text, or, when ``hashtag_col`` names an array of
    parsed tags (e.g. ``entities.hashtags.tag``), against that array.  Excluded
    operators ``is:retweet``, ``is:reply``, ``is:quote``, ``is:nullcast`` test the boolean
    columns named in ``flags``; an operator without a column raises, since skipping it would
    keep the posts it excludes.
    """
    hashtags = [h for h in cfg.hashtags if h]
    phrases = [p for p in cfg.include if p]
    if not hashtags and not phrases:
        raise ValueError("the predicate needs at least one hashtag or exact phrase")
    t = F.lower(_c(text))
    any_of = []
    if hashtags and hashtag_col is not None:
        tags = F.transform(_c(hashtag_col), lambda x: F.lower(x))
        wanted = F.array(*[F.lit(h.lower()) for h in hashtags])
        any_of.append(F.coalesce(F.arrays_overlap(tags, wanted), F.lit(False)))
    elif hashtags:
        any_of.append(t.rlike(word_set_pattern(hashtags, prefix="#")))
    if phrases:
        any_of.append(t.rlike(word_set_pattern(phrases)))
    cond = any_of[0] if len(any_of) == 1 else (any_of[0] | any_of[1])
    pre = [p for p in cfg.pre_req if p]
    if pre:
        cond = t.rlike(word_set_pattern(pre)) & cond
    words = [w for w in cfg.exclude if w and not w.startswith("is:")]
    ops = [w for w in cfg.exclude if w.startswith("is:")]
    if words:
        cond = cond & ~t.rlike(word_set_pattern(words))
    flags = flags or {}
    for op in ops:
        if op not in flags:
            raise ValueError(f"no flag column is given for the excluded operator {op!r}")
        cond = cond & ~F.coalesce(_c(flags[op]), F.lit(False))
    if cfg.language:
        cond = cond & (_c(lang) == cfg.language[0])
    return F.coalesce(cond, F.lit(False))


def date_range(df: DataFrame, col: str, start: str | None, end: str | None) -> DataFrame:
    """``start <= col < end`` as plain comparisons (pushed into the parquet scan)."""
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(start).cast(df.schema[col].dataType))
    if end is not None:
        df = df.filter(F.col(col) < F.lit(end).cast(df.schema[col].dataType))
    return df


def collect(df: DataFrame, cfg: CollectConfig, text: str = "text", lang: str = "lang",
            time_col: str | None = "created_at", flags: dict[str, str] | None = None,
            hashtag_col: str | None = None) -> DataFrame:
    """F1 + F2 + F3: date range, predicate, then ``id``, the configured fields that exist and
    the nested ``user`` record, reduced to ``id``, the configured user fields and the always
    requested ones where a list is given."""
    out = df
    if time_col is not None and (cfg.start or cfg.end):
        out = date_range(out, time_col, cfg.start, cfg.end)
    out = out.filter(collect_predicate(cfg, text, lang, flags, hashtag_col))
    if cfg.fields:
        keep = ["id"] + [f for f in cfg.fields if f in df.columns and f != "id"]
        if "user" in df.columns:
            keep.append("user")
        out = out.select(*[c for c in dict.fromkeys(keep) if c in df.columns])
    if cfg.user_fields and "user" in out.columns:
        there = out.schema["user"].dataType.names
        wanted = dict.fromkeys(("id", *cfg.user_fields, *ALWAYS_USER_FIELDS))
        record = F.struct(*[F.col(f"user.{c}") for c in wanted if c in there])
        out = out.withColumn("user", F.when(F.col("user").isNotNull(), record))
    return out


def validate_cap(n) -> int | None:
    """``'all'`` (no cap) or an integer of at least 10."""
    if n == "all" or n is None:
        return None
    n = int(n)
    if n < MIN_RESULT_CAP:
        raise ValueError(f"a result cap is at least {MIN_RESULT_CAP}")
    return n


# ----------------------------------------------------------------------------- F6, F7
def drop_removed(df: DataFrame, col: str, markers=tuple(REMOVED_MARKERS)) -> DataFrame:
    """drop rows whose ``col`` is NULL or exactly one of the moderation markers."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*markers))


def regex_tag(df: DataFrame, patterns: list[str], text: str = "text",
              out: str = "regex_matched", as_array: str | None = None) -> DataFrame:
    """for each pattern (Python syntax, searched anywhere), list the matching patterns
    joined by ``', '`` in list order, or ``'N/A'``.  All rows are kept."""
    if not patterns:
        raise ValueError("regex_tag needs at least one pattern")
    hits = [F.when(_c(text).rlike(py_classes(p)), F.lit(p)) for p in patterns]
    joined = F.concat_ws(", ", *hits)
    df = df.withColumn(out, F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_MATCH)))
    if as_array:
        df = df.withColumn(as_array, F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return df


def self_report_rows(triples: DataFrame, patterns: list[str], text: str = "text",
                     location: str = "location", created_at: str = "created_at") -> DataFrame:
    """F7 output contract: (report_text, regex_matched, geo, timestamp); every row kept,
    ``'N/A'`` when no pattern matches, ``'NA'`` when the timestamp is missing."""
    tagged = regex_tag(triples, patterns, text)
    return tagged.select(F.col(text).alias("report_text"), "regex_matched", F.col(location).alias("geo"),
                         F.coalesce(F.col(created_at).cast("string"), F.lit("NA")).alias("timestamp"))


# ----------------------------------------------------------------------------- F8, F9
def unique_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """F8: one row per distinct ``key`` value: the row with the smallest ``order``.

    Texts are compared by their SHA-256: ``min(order)`` per hash is a hash aggregate with
    partial sums per task, so a text repeated in a third of all rows costs one row per task
    and no text is sorted or shuffled for it.  The rows found are joined back on ``order``,
    which must be a total order (unique, not null); a NULL ``key`` is a value of its own.
    """
    hashed = df.withColumn("__k", F.coalesce(F.sha2(F.col(key).cast("string"), 256), F.lit("")))
    first = hashed.groupBy("__k").agg(F.min(order).alias("__first")).select("__first")
    return df.join(first, df[order] == first["__first"], "left_semi")


def first_n(df: DataFrame, n: int, order: list[str] | str) -> DataFrame:
    """the first ``n`` rows in ``order`` (``-1`` = all); plans as TakeOrderedAndProject."""
    if n == -1:
        return df
    order = [order] if isinstance(order, str) else order
    return df.orderBy(*order).limit(n)


# ----------------------------------------------------------------------------- F10-F15
def similarity_cutoff(df: DataFrame, score: str = "score", concept: str = "semantics",
                      threshold: float = 0.45) -> DataFrame:
    """keep ``score > threshold`` (strict) with a non-empty concept."""
    return df.filter((F.col(score) > threshold) & (F.col(concept) != ""))


def exclude_categories(df: DataFrame, col: str, categories) -> DataFrame:
    """drop listed categories; NULL categories are kept (pandas ``~isin``)."""
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(*categories))


def share_filter(df: DataFrame, col: str = "perc", minimum: float = 1.0) -> DataFrame:
    """``perc > minimum``."""
    return df.filter(F.col(col) > minimum)


def in_categories(df: DataFrame, categories: DataFrame, col: str, cat_col: str | None = None) -> DataFrame:
    """left-semi join on the category values of a (small) category table."""
    cat_col = cat_col or col
    cats = categories.select(F.col(cat_col).alias("__cat")).distinct()
    return df.join(cats, F.col(col) == F.col("__cat"), "left_semi")


def combine_title_body(df: DataFrame, title: str = "title", body: str = "selftext",
                       out: str = "text") -> DataFrame:
    """``title || ' ' || body``; NULL if either is NULL."""
    return df.withColumn(out, F.concat(F.col(title), F.lit(" "), F.col(body)))


SUBMISSION_COLUMNS = ["id", "author", "created_utc", "created_utc_date", "selftext", "title",
                      "text", "domain", "full_link", "is_original_content", "is_video",
                      "num_comments", "num_crossposts", "permalink", "pinned", "retrieved_on",
                      "score", "subreddit", "subreddit_id", "subreddit_subscribers",
                      "subreddit_type", "total_awards_received", "treatment_tags", "upvote_ratio"]


def project_submissions(df: DataFrame, strict: bool = False) -> DataFrame:
    """the 24 submission columns (``title`` once); absent ones skipped unless strict."""
    missing = [c for c in SUBMISSION_COLUMNS if c not in df.columns]
    if strict and missing:
        raise ValueError(f"missing submission columns: {missing}")
    return df.select(*[c for c in SUBMISSION_COLUMNS if c in df.columns])
