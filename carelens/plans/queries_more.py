"""Queries for sources, sinks and selections whose result is a written or projected table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as TXT
from ..operators import privacy as OP
from ..operators import ann, infer, quality, report, semantic, threads
from ..operators import select as SEL
from ..operators import users as USERS
from ..operators.keyword_table import keyword_table_search
from ..session import scratch_path
from ..sources import json_arrays as json_arrays_reader
from ..sources import paging, readers, sinks, views
from ..sources.tables import table
from .queries import ORACLE, q, r6
from .queries_match import _cube, _shares


@q("dictionary_file", """
SELECT categories, count(*) AS terms, count(DISTINCT abr_symptoms) AS concepts FROM dict GROUP BY categories""",
   ("dict",))
def dictionary_file(spark, sf):
    """The concept dictionary written as a delimited sheet and read back with its header."""
    path = scratch_path(spark, "dictionary")
    sinks.write_table(views.concept_dictionary(spark, sf), path, fmt="csv")
    d = readers.read_delimited(spark, path)
    return d.groupBy("categories").agg(F.count(F.lit(1)).alias("terms"),
                                       F.count_distinct("abr_symptoms").alias("concepts"))


@q("json_arrays", "SELECT id, author_id, lang, text FROM posts", ("posts",))
def json_arrays(spark, sf):
    """S9 + S1 in the original's form: posts written as JSON array files, read in byte ranges."""
    path = scratch_path(spark, "posts-arrays")
    sinks.write_json_arrays(views.posts(spark, sf).select("id", "author_id", "lang", "text"), path)
    back = json_arrays_reader.read_array_posts(spark, path, schemas.POST, range_bytes=1 << 20)
    return back.select("id", "author_id", "lang", "text")


@q("posts_json", "SELECT id, author_id, lang, text, 'refused' AS second_write FROM posts", ("posts",))
def posts_json(spark, sf):
    """S9 + S1: posts written as JSON and read back; a second write to the place is refused."""
    p = views.posts(spark, sf).select("id", "author_id", "lang", "text")
    path = scratch_path(spark, "posts-json")
    sinks.write_posts_json(p, path)
    try:
        sinks.write_posts_json(p, path)
        second = "written"
    except Exception as e:                   # Spark's analysis error: the path exists
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        second = "refused"
    back = readers.read_posts(spark, path, schemas.POST, multiline=False)
    return back.select("id", "author_id", "lang", "text", F.lit(second).alias("second_write"))


@q("json_append", """
SELECT id, lang, count(*) AS n FROM (
  SELECT id, lang FROM posts WHERE lang = 'en' UNION ALL SELECT id, lang FROM posts WHERE lang <> 'en'
  UNION ALL SELECT id, lang FROM posts WHERE lang = 'en') z GROUP BY id, lang""", ("posts",))
def json_append(spark, sf):
    """Three batches appended to one place, keys in sorted order, and read back."""
    p = views.posts(spark, sf).select("lang", "id", "author_id")
    path = scratch_path(spark, "posts-append")
    english = p.filter(F.col("lang") == "en")
    for batch in (english, p.filter(F.col("lang") != "en"), english):
        sinks.append_json_sorted(batch, path)
    back = readers.read_posts(spark, path, schemas.POST, multiline=False)
    return back.groupBy("id", "lang").agg(F.count(F.lit(1)).alias("n"))


@q("accumulate_batches", """
SELECT lang, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM posts GROUP BY lang""", ("posts",))
def accumulate_batches(spark, sf):
    """Collection batches (one per language) accumulated into one table by name."""
    p = views.posts(spark, sf)
    whole = threads.accumulate([
        p.filter(F.col("lang") == "en").select("id", "lang", "text"),
        p.filter(F.col("lang") == "de").select("text", "lang", "id"),
        p.filter(~F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))).select("lang", "id", "text")])
    return whole.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"),
                                     F.max("id").alias("last_id"))


@q("country_share_file", None)
def country_share_file(spark, sf):
    """The country share table written as a sheet and read back."""
    cube = _cube(spark, sf)
    share = report.country_share(cube, _shares(spark, sf, cube), count_col="n")
    path = scratch_path(spark, "country-share")
    sinks.write_table(share.select("country", "count", r6(F.col("perc")).alias("perc")), path, fmt="csv")
    return readers.read_delimited(spark, path).select(
        "country", F.col("count").cast("long").alias("count"), F.col("perc").cast("double").alias("perc"))


ORACLE["country_share_file"] = ORACLE["country_share"]


@q("submission_columns", """
SELECT id, author, created_utc, selftext, title, title || ' ' || selftext AS text, score, subreddit
FROM submissions""", ("submissions",))
def submission_columns(spark, sf):
    """F15 (+ F14): the submission columns that exist, in their fixed order, others dropped."""
    s = SEL.combine_title_body(views.submissions(spark, sf)).withColumn("scratch", F.lit(1))
    return SEL.project_submissions(s)


@q("comment_author", "SELECT id, author FROM comments", ("comments",))
def comment_author(spark, sf):
    """The author's name out of the author record of a comment."""
    c = views.comments(spark, sf)
    c = c.withColumn("author", F.struct(F.col("author").alias("name"), F.lit(False).alias("is_mod")))
    return OP.comment_author_name(c).select("id", "author")


@q("cut_before_scoring", """
SELECT doc_id, length(substring(text, 1, 511)) AS n_chars,
       length(regexp_replace(substring(text, 1, 511), '[^e]', '', 'g')) AS n_e FROM documents""")
def cut_before_scoring(spark, sf):
    """A classifier reads the first 511 characters; here a stub that counts a letter."""
    d = table(spark, sf, "documents").select("doc_id", TXT.truncate_chars("text").alias("t"))
    return d.select("doc_id", F.length("t").alias("n_chars"),
                    F.length(F.regexp_replace("t", "[^e]", "")).alias("n_e"))


@q("duplicate_key_pairs", """
SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_key_pairs(spark, sf):
    """Q2: values of two keys together that occur more than once."""
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


USER_FIELDS_CFG = SEL.CollectConfig(include=("the",), language=("en",), fields=("text",), user_fields=("username",))


@q("collect_user_fields", r"""
SELECT p.id, u.id AS user_id, u.username, u.profile_image_url, u.description,
       4 AS user_field_count
FROM posts p LEFT JOIN users u ON u.id = p.author_id
WHERE p.lang = 'en' AND regexp_matches(lower(p.text), '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)')""",
   ("posts", "users"))
def collect_user_fields(spark, sf):
    """a list of user fields, and those that are requested always."""
    p = USERS.attach_users(views.posts(spark, sf), views.users(spark, sf), user_order="username")
    out = SEL.collect(p, USER_FIELDS_CFG, time_col=None)
    n = len(out.schema["user"].dataType.names)
    return out.select("id", F.col("user.id").alias("user_id"), "user.username", "user.profile_image_url",
                      "user.description", F.lit(n).alias("user_field_count"))


FLAG_CFG = SEL.CollectConfig(hashtags=("en", "FR"), include=("of the", "in the"), exclude=("roche", "is:reply"),
                             language=("en",))


@q("collect_flags", r"""
SELECT p.id FROM posts p LEFT JOIN pages g ON CAST(g.page_id AS VARCHAR) = p.id
WHERE p.lang = 'en'
  AND (coalesce(list_has_any([lower(regexp_extract(g.url, '/([a-z]+)/[0-9]', 1))], ['en', 'fr']), false)
       OR regexp_matches(lower(p.text), '(^|[^\p{L}\p{N}_])(of|in) the([^\p{L}\p{N}_]|$)'))
  AND NOT regexp_matches(lower(p.text), '(^|[^\p{L}\p{N}_])roche([^\p{L}\p{N}_]|$)')
  AND NOT coalesce(g.url LIKE '%?page=%', false)""", ("posts",))
def collect_flags(spark, sf):
    """F1 with parsed hashtags (the section of the post's page), phrases, an excluded word and
    an excluded flag (pages that are continuations)."""
    g = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("page_id"), "url")
    p = views.posts(spark, sf)
    p = p.join(g, p.id == g.page_id, "left").withColumns({
        "tags": F.array(F.regexp_extract("url", "/([a-z]+)/[0-9]", 1)),
        "reply": F.col("url").contains("?page=")})
    return p.filter(SEL.collect_predicate(FLAG_CFG, flags={"is:reply": "reply"}, hashtag_col="tags")).select("id")


@q("drop_mentions", """
SELECT p.created_utc, 'tags' AS entity_fields, 'created_at created_utc entities lang text user' AS fields,
       p.lang AS tag
FROM posts p""", ("posts",))
def drop_mentions(spark, sf):
    """P5: ids, the author's name and ``entities.mentions`` dropped; all remaining names listed."""
    p = USERS.attach_users(views.posts(spark, sf), views.users(spark, sf), user_order="username")
    p = p.withColumn("entities", F.struct(F.col("lang").alias("tags"), F.col("author").alias("mentions")))
    p = OP.remove_unused_fields(p)
    return p.select("created_utc", F.lit(" ".join(p.schema["entities"].dataType.names)).alias("entity_fields"),
                    F.lit(" ".join(sorted(p.columns))).alias("fields"), F.col("entities.tags").alias("tag"))


@q("attach_latest_user", """
WITH last AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
SELECT p.id, o.o_orderkey AS version, o.o_orderpriority AS description
FROM posts p LEFT JOIN last l ON CAST(l.o_custkey AS VARCHAR) = p.author_id
LEFT JOIN orders o ON o.o_orderkey = l.o_orderkey""", ("posts",))
def attach_latest_user(spark, sf):
    """J1 with repeated user records (a customer's orders as its versions): the last one wins."""
    u = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"),
                                          F.col("o_orderkey").alias("version"),
                                          F.col("o_orderpriority").alias("description"))
    p = USERS.attach_users(views.posts(spark, sf), u, user_order="version")
    return p.select("id", F.col("user.version").alias("version"), F.col("user.description").alias("description"))


@q("semantic_blocked", None)
def semantic_blocked(spark, sf):
    """M7 + J7 by the blocked kernel, the form for dictionaries too large to broadcast."""
    b = semantic.best_concepts_dense(views.query_vectors(spark, sf), views.concept_vectors(spark, sf), k=1,
                                     broadcast_rows=1, block_rows=500, dict_block_rows=16)
    return b.select("term", "concept", r6(F.col("score")).alias("score"))


ORACLE["semantic_blocked"] = ORACLE["semantic_best"]


@q("page_all", """
SELECT id, created_utc, (row_number() OVER (ORDER BY created_utc DESC, id DESC) - 1) // 500 AS page,
       CAST((row_number() OVER (ORDER BY created_utc DESC, id DESC) - 1) % 500 AS INTEGER) AS place
FROM submissions""", ("submissions",))
def page_all(spark, sf):
    """Every submission with its page of the newest-first walk, all pages at once."""
    return paging.all_pages(views.submissions(spark, sf).select("id", "created_utc"))


@q("model_batches", "SELECT id, length(username) AS prediction FROM users", ("users",))
def model_batches(spark, sf):
    """M9 + J2: batches of exactly 256 users, answers checked in number and order (stand-in predictor)."""
    return infer.score_fixed_batches(views.users(spark, sf).select("id", "username"),
                                     lambda: infer.CharCountPredictor("username", "prediction"),
                                     "id string, prediction long", key="id")


@q("row_snapshots", "SELECT id, lang, length(text) AS chars FROM posts", ("posts",))
def row_snapshots(spark, sf):
    """S14 + ST2: posts processed in snapshots of 500 rows in id order, read back as one."""
    posts = views.posts(spark, sf).select("id", "lang", "text")
    job = sinks.RowSnapshots(spark, scratch_path(spark, "snapshots"), rows=500)
    return job.run(posts, [F.col("id")], [F.col("id"), F.col("lang"), F.length("text").cast("long").alias("chars")])


def _vector_index(spark, sf):
    """An index over all embedding rows as entries, and the same rows as terms."""
    terms = views.stored_vectors(spark, sf)
    return ann.ConceptIndex(terms.withColumnRenamed("term", "concept")), terms


@q("semantic_ivf")
def semantic_ivf(spark, sf):
    """M7 approximate: the nearest other embedding row of every row, through the inverted-file index."""
    index, terms = _vector_index(spark, sf)
    near = index.search(terms, k=2, probes=index.probes_for(terms, k=2)).filter("term <> concept")
    best = near.groupBy("term").agg(F.min(F.struct("rank", "concept", "score")).alias("b"))
    return best.select("term", "b.concept", r6(F.col("b.score")).alias("score"))


@q("semantic_ivf_recall", "SELECT least(count(*), 1000) AS terms, TRUE AS recall_ok FROM embeddings")
def semantic_ivf_recall(spark, sf):
    """M7 approximate: whether the index finds 95 % of the exact two nearest entries (the row itself
    and the nearest other one), measured on 1000 other terms than those that set the probes."""
    index, terms = _vector_index(spark, sf)
    return index.recall(terms, k=2, probes=index.probes_for(terms, k=2), salt=1).select("terms", (F.col("recall") >= 0.95).alias("recall_ok"))


@q("keyword_table", f"""
WITH kw AS (SELECT DISTINCT lower(p_name) AS k FROM part UNION SELECT DISTINCT lower(c_name) FROM customer
            UNION SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) FROM benchmark),
tok AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM (SELECT id, lower(text) AS t FROM posts) x),
word AS (SELECT id, i - 1 AS s, regexp_extract(substring(t, i, 60), '^[a-z0-9_]+') AS w FROM tok
         WHERE regexp_matches(substring(t, i, 1), '[a-z0-9_]')
           AND (i = 1 OR NOT regexp_matches(substring(t, i - 1, 1), '[a-z0-9_]')))
SELECT w AS keyword, count(*) AS hits, count(DISTINCT id) AS posts FROM word JOIN kw ON kw.k = w GROUP BY w""", ("posts",))
def keyword_table(spark, sf):
    """M1 with a keyword table (part names, customer names, words of the benchmark): hits per keyword."""
    posts = views.posts(spark, sf).select("id", "text")
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))
    table_ = (table(spark, sf, "part").select(F.lower("p_name").alias("keyword"))
              .union(table(spark, sf, "customer").select(F.lower("c_name")))
              .union(table(spark, sf, "benchmark").select(words.alias("keyword"))))
    found = keyword_table_search(posts, "text", table_).select("id", F.explode("keywords_text").alias("k"))
    return found.groupBy(F.col("k.keyword").alias("keyword")).agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("id").alias("posts"))
