"""Stand-in views: the record shapes the operators read, built from the driver tables.

The reference ships no sample posts, comments or mention sheets, so each view below maps
a driver table onto the shape an operator expects (see FIXTURES.md).  A view only
renames, joins and decorates rows; it never filters rows by id, samples or truncates
text, and no operator relies on how a view is built.  Every view has two equal forms:
a Spark builder (used by ``queries()``) and a DuckDB CTE (used by ``oracle_sql()``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Fixed values of the stand-in clock: posts are one hour apart from 2021-01-01T00:00Z,
# submissions one day apart, replies one minute after each other.
EPOCH0 = 1609459200
HOUR = 3600
DAY = 86400
MINUTE = 60


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# ---------------------------------------------------------------- microblog posts
def posts(spark: SparkSession, sf: str) -> DataFrame:
    """documents + pages -> post rows (id, author_id, author, created_utc, lang, text).

    The text is the whole document, prefixed by a mention of its source, followed by the
    page URL and an HTML entity when a page shares the document's id, and by a banned
    product name for two of the languages (once inside a sentence, once at the very end).
    """
    return posts_from(table(spark, sf, "documents"), table(spark, sf, "pages"))


def posts_from(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """The posts view over given documents (batch or streaming) and a static pages table."""
    d = documents
    p = pages.select("page_id", "url")
    j = d.join(p, d.doc_id == p.page_id, "left")
    text = F.concat(
        F.lit("@"), F.col("source"), F.lit(" "), F.col("text"),
        F.coalesce(F.concat(F.lit(" "), F.col("url"), F.lit(" &amp; more")), F.lit("")),
        F.when(F.col("lang") == "es", F.lit(" took Tamiflu, daily"))
        .when(F.col("lang") == "de", F.lit(" roche"))
        .otherwise(F.lit("")),
    )
    created = F.lit(EPOCH0) + F.col("doc_id") * HOUR
    return j.select(
        _s("doc_id").alias("id"),
        _s(F.regexp_extract("source", r"(\d+)$", 1).cast("bigint") + 1).alias("author_id"),
        F.col("source").alias("author"),
        created.cast("bigint").alias("created_utc"),
        # UTC wall time as TIMESTAMP_NTZ: the same value in every session time zone
        (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), created)).alias("created_at"),
        F.col("lang"),
        text.alias("text"),
    )


POSTS_SQL = f"""posts AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id,
         CAST(CAST(regexp_extract(d.source, '(\\d+)$', 1) AS BIGINT) + 1 AS VARCHAR) AS author_id,
         d.source AS author,
         CAST({EPOCH0} + d.doc_id * {HOUR} AS BIGINT) AS created_utc,
         make_timestamp(CAST(({EPOCH0} + d.doc_id * {HOUR}) AS BIGINT) * 1000000) AS created_at,
         d.lang,
         '@' || d.source || ' ' || d.text || coalesce(' ' || p.url || ' &amp; more', '') ||
         CASE WHEN d.lang = 'es' THEN ' took Tamiflu, daily' WHEN d.lang = 'de' THEN ' roche' ELSE '' END AS text
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""


# ---------------------------------------------------------------- users
def users(spark: SparkSession, sf: str) -> DataFrame:
    """customer + nation -> user rows (id, username, name, location, description, profile_image_url)."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select(
        _s("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("location"),
        F.concat(F.lit("@"), F.col("c_name"), F.lit(" likes "), F.col("c_mktsegment")).alias("description"),
        F.concat(F.lit("https://img.example/"), _s("c_custkey")).alias("profile_image_url"),
    )


USERS_SQL = """users AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS id, c.c_name AS username, c.c_name AS name,
         n.n_name AS location, '@' || c.c_name || ' likes ' || c.c_mktsegment AS description,
         'https://img.example/' || CAST(c.c_custkey AS VARCHAR) AS profile_image_url
  FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)"""


# ---------------------------------------------------------------- forum submissions and comments
def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """conversations, opening turns -> submission rows."""
    c = table(spark, sf, "conversations").filter(F.col("turn") == 0)
    return c.select(
        F.concat(F.lit("s"), _s("conv_id")).alias("id"),
        F.concat(F.col("role"), F.lit("_"), _s("conv_id")).alias("author"),
        (F.lit(EPOCH0) + F.col("conv_id") * DAY).cast("bigint").alias("created_utc"),
        F.concat(F.col("role"), F.lit(" post "), _s("conv_id")).alias("title"),
        F.col("text").alias("selftext"),
        F.col("role").alias("subreddit"),
        F.length("text").cast("bigint").alias("score"),
    )


SUBMISSIONS_SQL = f"""submissions AS (
  SELECT 's' || CAST(conv_id AS VARCHAR) AS id, role || '_' || CAST(conv_id AS VARCHAR) AS author,
         CAST({EPOCH0} + conv_id * {DAY} AS BIGINT) AS created_utc,
         role || ' post ' || CAST(conv_id AS VARCHAR) AS title, text AS selftext, role AS subreddit,
         CAST(length(text) AS BIGINT) AS score
  FROM conversations WHERE turn = 0)"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """conversations, reply turns -> comment rows (id, link_id, parent, body, author, created_utc).

    A reply links to the submission of its conversation and to the previous reply; bodies
    carry a ``/u/`` mention, and some are moderation markers or missing, chosen by how the
    reply text starts.
    """
    c = table(spark, sf, "conversations").filter(F.col("turn") > 0)
    body = (
        F.when(F.col("text").startswith("É"), F.lit("[removed]"))
        .when(F.col("text").startswith("Th"), F.lit("[deleted]"))
        .when(F.col("text").startswith("A"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("/u/"), F.col("role"), _s("conv_id"), F.lit(" "), F.col("text")))
    )
    return c.select(
        F.concat(F.lit("c"), _s("conv_id"), F.lit("_"), _s("turn")).alias("id"),
        F.concat(F.lit("t3_s"), _s("conv_id")).alias("link_id"),
        F.when(F.col("turn") > 1, F.concat(F.lit("c"), _s("conv_id"), F.lit("_"), _s(F.col("turn") - 1)))
        .alias("parent"),
        body.alias("body"),
        F.concat(F.col("role"), F.lit("_"), _s("conv_id")).alias("author"),
        (F.lit(EPOCH0) + F.col("conv_id") * DAY + F.col("turn") * MINUTE).cast("bigint").alias("created_utc"),
    )


COMMENTS_SQL = f"""comments AS (
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id,
         't3_s' || CAST(conv_id AS VARCHAR) AS link_id,
         CASE WHEN turn > 1 THEN 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END AS parent,
         CASE WHEN starts_with(text, 'É') THEN '[removed]'
              WHEN starts_with(text, 'Th') THEN '[deleted]'
              WHEN starts_with(text, 'A') THEN NULL
              ELSE '/u/' || role || CAST(conv_id AS VARCHAR) || ' ' || text END AS body,
         role || '_' || CAST(conv_id AS VARCHAR) AS author,
         CAST({EPOCH0} + conv_id * {DAY} + turn * {MINUTE} AS BIGINT) AS created_utc
  FROM conversations WHERE turn > 0)"""


# ---------------------------------------------------------------- mentions and concept dictionary
def mentions(spark: SparkSession, sf: str, lineitem: DataFrame | None = None) -> DataFrame:
    """lineitem (or some of its rows) + part + orders + customer + nation -> one row per
    extracted term."""
    l = table(spark, sf, "lineitem") if lineitem is None else lineitem
    l = l.select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = (l.join(p, l.l_partkey == p.p_partkey)
         .join(o, l.l_orderkey == o.o_orderkey)
         .join(k, o.o_custkey == k.c_custkey)
         .join(n, k.c_nationkey == n.n_nationkey))
    return j.select(
        "l_orderkey", "l_linenumber",
        F.col("p_name").alias("symptom_adjusted"),
        F.col("n_name").alias("country"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_date"),
    )


MENTIONS_SQL = """mentions AS (
  SELECT l.l_orderkey, l.l_linenumber, p.p_name AS symptom_adjusted, n.n_name AS country,
         strftime(o.o_orderdate, '%Y-%m-%d') AS created_date
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer k ON k.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = k.c_nationkey)"""


def concept_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """distinct part names -> (symptoms, categories, abr_symptoms).

    The noun is the abbreviated concept; ``anvil`` terms are Noise, ``bolt`` terms are
    uncategorized, others get a category from the noun's initial.  Names starting with
    ``old`` are left out of the dictionary so some terms stay unmapped.
    """
    p = table(spark, sf, "part").select("p_name").distinct()
    noun = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    adj = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    cat = (F.when(noun == "anvil", F.lit("Noise"))
           .when(noun == "bolt", F.lit("uncategorized"))
           .otherwise(F.concat(F.lit("cat_"), F.substring(noun, 1, 1))))
    return p.filter(adj != "old").select(
        F.col("p_name").alias("symptoms"), cat.alias("categories"), noun.alias("abr_symptoms"))


DICT_SQL = """dict AS (
  SELECT p_name AS symptoms,
         CASE WHEN split_part(p_name, ' ', 2) = 'anvil' THEN 'Noise'
              WHEN split_part(p_name, ' ', 2) = 'bolt' THEN 'uncategorized'
              ELSE 'cat_' || substring(split_part(p_name, ' ', 2), 1, 1) END AS categories,
         split_part(p_name, ' ', 2) AS abr_symptoms
  FROM (SELECT DISTINCT p_name FROM part) z WHERE split_part(p_name, ' ', 1) <> 'old')"""


# ---------------------------------------------------------------- vectors
def stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings -> (term, vector): every embedding row is a term to normalize, its vector as stored."""
    e = table(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("v"), _s("vec_id")).alias("term"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``stored_vectors`` with vectors of doubles."""
    return stored_vectors(spark, sf).withColumn("vector", F.col("vector").cast("array<double>"))


def concept_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings -> (concept, vector): one centroid per label, the concept dictionary."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    cent = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = cent.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return vec.select(F.concat(F.lit("label_"), _s("label")).alias("concept"),
                      F.transform("v", lambda s: s["x"]).alias("vector"))


QVEC_SQL = """qvec AS (
  SELECT 'v' || CAST(vec_id AS VARCHAR) AS term, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""
CVEC_SQL = """cvec AS (
  SELECT 'label_' || CAST(label AS VARCHAR) AS concept, list(x ORDER BY pos) AS vector
  FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x
        FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) u
        GROUP BY label, pos) g
  GROUP BY label)"""


# ---------------------------------------------------------------- model-score stand-ins
def label_scores(spark: SparkSession, sf: str) -> DataFrame:
    """documents -> (doc_id, scores map): a deterministic stub scorer in place of a model.

    ``report`` = ``th`` digraphs per blank-separated word, ``symptom`` = words ending in a
    vowel per word (letter statistics of the lower-cased text).
    """
    d = table(spark, sf, "documents")
    words = F.greatest(F.size(F.split(F.col("text"), " ")), F.lit(1))
    th = F.size(F.regexp_extract_all(F.lower("text"), F.lit("th"), 0)) / words
    vow = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[aeiou] "), 0)) / words
    return d.select("doc_id", F.create_map(F.lit("report"), th.cast("double"),
                                           F.lit("symptom"), vow.cast("double")).alias("scores"))


SCORES_SQL = """scores AS (
  SELECT doc_id,
         CAST(len(regexp_extract_all(lower(text), 'th')) AS DOUBLE) / greatest(len(string_split(text, ' ')), 1) AS s_report,
         CAST(len(regexp_extract_all(lower(text), '[aeiou] ')) AS DOUBLE) / greatest(len(string_split(text, ' ')), 1) AS s_symptom
  FROM documents)"""


# ---------------------------------------------------------------- entity stand-ins
def entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    """events -> one extracted entity per row (event_id, doc, text, type).

    A text's entities are 8 consecutive events, so every text holds a bounded list,
    as model output per text does.
    """
    e = table(spark, sf, "events")
    typ = (F.when(F.col("event_type") == "error", F.lit("PROBLEM"))
           .when(F.col("event_type") == "purchase", F.lit("TREATMENT"))
           .when(F.col("event_type") == "click", F.lit("TEST"))
           .otherwise(F.upper("event_type")))
    return e.select("event_id", F.floor(F.col("event_id") / 8).cast("bigint").alias("doc"),
                    F.concat(F.lit("term "), F.get_json_object("props", "$.k")).alias("text"),
                    typ.alias("type"))


ENTITY_SQL = """ents AS (
  SELECT event_id, CAST(floor(event_id / 8) AS BIGINT) AS doc, 'term ' || json_extract_string(props, '$.k') AS text,
         CASE event_type WHEN 'error' THEN 'PROBLEM' WHEN 'purchase' THEN 'TREATMENT'
                         WHEN 'click' THEN 'TEST' ELSE upper(event_type) END AS type
  FROM events)"""


def entity_lists(spark: SparkSession, sf: str) -> DataFrame:
    """entity rows -> per doc an ordered array<struct<text,type>> (the NER output shape)."""
    e = entity_rows(spark, sf)
    g = e.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("event_id", "text", "type"))).alias("ents"))
    return g.select("doc", F.transform("ents", lambda s: F.struct(s["text"].alias("text"),
                                                                    s["type"].alias("type"))).alias("entities"))


def subword_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """documents -> (doc_id, tokens): blank-split words of the whole text, words that start
    with a vowel marked as word pieces with a ``##`` prefix."""
    d = table(spark, sf, "documents")
    toks = F.transform(F.split(F.col("text"), " "),
                       lambda x: F.when(x.rlike("^[aeiou]"), F.concat(F.lit("##"), x)).otherwise(x))
    return d.select("doc_id", toks.alias("tokens"))


TOKENS_SQL = """toks AS (
  SELECT doc_id, list_transform(string_split(text, ' '),
                                lambda x: CASE WHEN regexp_matches(x, '^[aeiou]') THEN '##' || x ELSE x END) AS tokens
  FROM documents)"""


def term_lists(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem + part -> per order the raw extracted terms, in line order."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    j = l.join(p, l.l_partkey == p.p_partkey)
    g = j.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber",
                                             F.concat(F.upper("p_name"), F.lit("!!")).alias("t")))).alias("ts"))
    return g.select("l_orderkey", F.transform("ts", lambda s: s["t"]).alias("symptoms"))


TERMS_SQL = """terms AS (
  SELECT l.l_orderkey, list(upper(p.p_name) || '!!' ORDER BY l.l_linenumber) AS symptoms
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey)"""


# ---------------------------------------------------------------- lexicon stand-in
def passage_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark -> lexicon rows (Symptom, CUI, LexicalExpression).

    Every sentence of a benchmark passage, and every comma-separated clause of it, is a
    lexical expression of the concept ``passage <item_id>``.  Documents quote whole
    passages, so expressions of 1 to ~35 words occur in the texts, clauses nest inside
    their sentences, and short clauses also match elsewhere: overlaps are common.
    """
    b = table(spark, sf, "benchmark")
    s = b.select("item_id", F.explode(F.array_union(F.split(F.col("text"), r"[.\n]"),
                                                    F.split(F.col("text"), r"[.,\n]"))).alias("expr"))
    out = s.select(
        F.concat(F.lit("passage "), _s("item_id")).alias("Symptom"),
        F.concat(F.lit("B"), _s("item_id")).alias("CUI"),
        F.trim(F.col("expr")).alias("LexicalExpression"),
    )
    return out.filter(F.col("LexicalExpression") != "")


LEXICON_SQL = """lexicon AS (
  SELECT DISTINCT 'passage ' || CAST(item_id AS VARCHAR) AS "Symptom", 'B' || CAST(item_id AS VARCHAR) AS "CUI",
         trim(e) AS "LexicalExpression"
  FROM (SELECT item_id, unnest(list_concat(regexp_split_to_array(text, '[.\n]'),
                                           regexp_split_to_array(text, '[.,\n]'))) AS e FROM benchmark) z
  WHERE trim(e) <> '')"""


VIEW_SQL = {
    "posts": POSTS_SQL, "users": USERS_SQL, "submissions": SUBMISSIONS_SQL,
    "comments": COMMENTS_SQL, "mentions": MENTIONS_SQL, "dict": DICT_SQL,
    "qvec": QVEC_SQL, "cvec": CVEC_SQL, "scores": SCORES_SQL, "ents": ENTITY_SQL,
    "toks": TOKENS_SQL, "terms": TERMS_SQL, "lexicon": LEXICON_SQL,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the named views."""
    if not names:
        return sql
    head = "WITH " + ",\n".join(VIEW_SQL[n] for n in names)
    body = sql.lstrip()
    m = re.match(r"WITH\s+RECURSIVE\s+", body, re.IGNORECASE)
    if m:
        return "WITH RECURSIVE " + head[5:] + ",\n" + body[m.end():]
    m = re.match(r"WITH\s+", body, re.IGNORECASE)
    if m:
        return head + ",\n" + body[m.end():]
    return head + "\n" + body
