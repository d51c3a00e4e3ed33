"""Query registry: one entry per operator of the inventory.

Each query takes (spark, sf_dir), reads the driver tables through the stand-in views of
``sources.views`` and returns a DataFrame; its oracle is DuckDB SQL over the same views.
Result columns are plain (arrays are joined to text) and doubles rounded to 6 digits so
both engines can be compared by value.  Every query has an oracle; where the Spark form
uses something DuckDB lacks (look-arounds, a greedy fold, streaming), the SQL is an
independent formulation of the same result (boundary capture, an ASOF-linked recursive
walk, the batch query), and pytest also checks the operator against brute-force models.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy as P
from ..functions import text as T
from ..functions.patterns import py_classes
from ..operators import banned
from ..operators import privacy as OP
from ..operators import quality, select, threads, users
from ..operators.nested import clean_nested
from ..plans.chain import forum_chain, post_chain
from ..sources import paging, views
from ..sources.tables import table
from ..sources.views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def q(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *uses)
        return fn
    return deco


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def r6(c):
    return F.round(c.cast("double"), 6)


# ======================================================================== selection
BANNED_RE = banned.banned_pattern()


@q("banned_filter", f"""
SELECT id, lang FROM posts
WHERE NOT coalesce(regexp_matches(lower(text), {lit(BANNED_RE)}), false)""", ("posts",))
def banned_filter(spark, sf):
    """posts without a banned product name between two non-word characters."""
    return banned.drop_banned(views.posts(spark, sf), "text").select("id", "lang")


@q("banned_filter_comments", f"""
SELECT id FROM comments
WHERE NOT coalesce(regexp_matches(lower(body), {lit(BANNED_RE)}), false)""", ("comments",))
def banned_filter_comments(spark, sf):
    """the same filter on a forum column by name."""
    return banned.drop_banned(views.comments(spark, sf), "body").select("id")


COLLECT_CFG = select.CollectConfig(
    hashtags=("src1", "src7"), include=("of the", "in the"), pre_req=("the", "and"),
    exclude=("roche", "tamiflu"), language=("en",),
    start="2021-01-05", end="2021-03-01")


def _collect_sql(cfg: select.CollectConfig) -> str:
    t = "lower(text)"
    any_of = [f"regexp_matches({t}, {lit(select.word_set_pattern(cfg.hashtags, prefix='#'))})",
              f"regexp_matches({t}, {lit(select.word_set_pattern(cfg.include))})"]
    words = [w for w in cfg.exclude if not w.startswith("is:")]
    return f"""
SELECT id FROM posts
WHERE created_at >= TIMESTAMP '{cfg.start}' AND created_at < TIMESTAMP '{cfg.end}'
  AND regexp_matches({t}, {lit(select.word_set_pattern(cfg.pre_req))})
  AND ({any_of[0]} OR {any_of[1]})
  AND NOT regexp_matches({t}, {lit(select.word_set_pattern(words))})
  AND lang = {lit(cfg.language[0])}"""


@q("collect_predicate", _collect_sql(COLLECT_CFG), ("posts",))
def collect_predicate(spark, sf):
    """F1 + F2: keyword / hashtag / exclusion / language predicate inside a date range.

    The stand-in posts carry their source as an ``@`` mention, so hashtags are matched
    as ``#word``; none occur in the invented prose, so the phrase branch decides.
    """
    p = views.posts(spark, sf)
    return select.collect(p, COLLECT_CFG, time_col="created_at").select("id")


@q("deleted_filter", """
SELECT id FROM comments WHERE body IS NOT NULL AND body NOT IN ('[removed]', '[deleted]')""",
   ("comments",))
def deleted_filter(spark, sf):
    """F6."""
    return select.drop_removed(views.comments(spark, sf), "body").select("id")


TAG_PATTERNS = [r"ing th\w*", r"[0-9]{3,}", r"^@src1[0-9]", r"\s&amp;\s"]


def _tag_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(text, {lit(py_classes(p))}) THEN {lit(p)} END"
                      for p in TAG_PATTERNS)
    return f"SELECT id, coalesce(nullif(concat_ws(', ', {cases}), ''), 'N/A') AS regex_matched FROM posts"


@q("regex_tag", _tag_sql(), ("posts",))
def regex_tag(spark, sf):
    """matching patterns per post joined by ', ', or 'N/A'; all posts kept."""
    return select.regex_tag(views.posts(spark, sf), TAG_PATTERNS).select("id", "regex_matched")


@q("unique_text", """
SELECT doc_id, lang, n_chars FROM (
  SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents) z WHERE rn = 1""")
def unique_text(spark, sf):
    """F8: first occurrence (smallest doc_id) of every distinct text."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    return select.unique_first(d, "text", "doc_id").select("doc_id", "lang", "n_chars")


# ======================================================================== paging
@q("page_top", """
SELECT id, score FROM submissions WHERE subreddit = 'user'
ORDER BY score DESC, id DESC LIMIT 50""", ("submissions",))
def page_top(spark, sf):
    """S3 + S5: the 50 highest-scoring submissions of one forum (a top-k report)."""
    return paging.page_top(views.submissions(spark, sf), subreddit="user", sort_type="score",
                           sort="desc", max_rows=50).select("id", "score")


KEYSET_AT = (views.EPOCH0 + 50 * views.DAY, "s50")


@q("page_keyset", f"""
SELECT id, created_utc FROM submissions
WHERE created_utc < {KEYSET_AT[0]} OR (created_utc = {KEYSET_AT[0]} AND id < '{KEYSET_AT[1]}')
ORDER BY created_utc DESC, id DESC LIMIT 20""", ("submissions",))
def page_keyset(spark, sf):
    """The next page of 20 after a (created_utc, id) position, newest first."""
    return paging.page_keyset(views.submissions(spark, sf), KEYSET_AT[0], KEYSET_AT[1],
                              page_size=20).select("id", "created_utc")


# ======================================================================== de-identification
@q("hash_author", """SELECT id, sha256(author) AS author FROM posts""", ("posts",))
def hash_author(spark, sf):
    """P1/P4 (256-bit form; SHA-224 is the default and is tested in pytest)."""
    p = views.posts(spark, sf)
    return p.select("id", P.hash_value("author", 256).alias("author"))


def _hash_mentions_sql(col: str, prefix: str) -> str:
    pat = lit(prefix.replace("/", "/") + r"[\p{L}\p{N}_]*")
    n = len(prefix) + 1
    return (f"(regexp_split_to_array({col}, {pat}))[1] || coalesce(array_to_string(list_transform("
            f"range(len(regexp_extract_all({col}, {pat}))), "
            f"lambda i: {lit(prefix)} || sha256(substring(regexp_extract_all({col}, {pat})[i + 1], {n})) || "
            f"regexp_split_to_array({col}, {pat})[i + 2]), ''), '')")


@q("hash_mentions", f"SELECT id, {_hash_mentions_sql('text', '@')} AS text FROM posts", ("posts",))
def hash_mentions(spark, sf):
    """Every @name in the post text replaced by @ + hash of the name."""
    return OP.hash_ids(views.posts(spark, sf), bits=256).select("id", "text")


@q("hash_forum_mentions", f"""
SELECT id, sha256(author) AS author, {_hash_mentions_sql('body', '/u/')} AS body FROM comments""",
   ("comments",))
def hash_forum_mentions(spark, sf):
    """P3 + P4: forum author hashed, /u/name mentions in the body hashed."""
    c = OP.anonymize_forum(views.comments(spark, sf), "body", bits=256)
    return c.select("id", "author", "body")


def _posts_with_users(spark, sf):
    return users.attach_users(views.posts(spark, sf), views.users(spark, sf), user_order="username")


@q("attach_user", """
SELECT p.id, u.id AS user_id, u.location FROM posts p LEFT JOIN users u ON u.id = p.author_id""",
   ("posts", "users"))
def attach_user(spark, sf):
    """Each post with its author's user record."""
    p = _posts_with_users(spark, sf)
    return p.select("id", F.col("user.id").alias("user_id"), F.col("user.location").alias("location"))


@q("drop_identity", """
SELECT p.created_utc, u.username, u.description, u.location
FROM posts p LEFT JOIN users u ON u.id = p.author_id""", ("posts", "users"))
def drop_identity(spark, sf):
    """P5: ids and identifying user fields dropped (id, author_id, user.id, user.name,
    user.profile_image_url); the remaining user fields flattened."""
    p = OP.remove_unused_fields(_posts_with_users(spark, sf))
    ufields = [f.name for f in p.schema["user"].dataType.fields]
    return p.select("created_utc", *[F.col(f"user.{f}").alias(f) for f in ufields])


@q("ids_only", "SELECT id AS tweet_id FROM posts", ("posts",))
def ids_only(spark, sf):
    """P6."""
    return OP.only_ids(views.posts(spark, sf))


@q("pass_chain", f"""
SELECT p.created_utc, p.created_at, p.lang, {_hash_mentions_sql('p.text', '@')} AS text,
       sha256(u.username) AS username, {_hash_mentions_sql('u.description', '@')} AS description, u.location
FROM posts p LEFT JOIN users u ON u.id = p.author_id
WHERE NOT coalesce(regexp_matches(lower(p.text), {lit(BANNED_RE)}), false)""", ("posts", "users"))
def pass_chain(spark, sf):
    """X1 + X2: the shipped chain (banned filter, drop fields, hash ids) over posts with users."""
    p = post_chain(bits=256)(_posts_with_users(spark, sf))
    # every column the chain leaves, so a name that slips through shows
    return p.select("user.*", *[c for c in p.columns if c != "user"])


FORUM_SQL_BODY = f"""
SELECT id, sha256(author) AS author, {_hash_mentions_sql('body', '/u/')} AS body,
       CAST(DATE '1970-01-01' + CAST(floor(created_utc / 86400) AS INTEGER) AS VARCHAR) AS created_utc_date
FROM comments"""


@q("forum_chain", f"""
SELECT * FROM ({FORUM_SQL_BODY}) z
WHERE NOT coalesce(regexp_matches(lower(body), {lit(BANNED_RE)}), false)
  AND body IS NOT NULL AND body NOT IN ('[removed]', '[deleted]')""", ("comments",))
def forum_chain_q(spark, sf):
    """Anonymize, banned filter, removed/deleted/null filter, UTC date."""
    c = forum_chain("body", anonymize=True, bits=256)(views.comments(spark, sf))
    return c.select("id", "author", "body", "created_utc_date")


# ======================================================================== text functions
SP = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NSP = r"[^\t-\r\x1c-\x1f\x85\p{Z}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + SP + '+|' + SP + '+$')}, '', 'g')"


def _special_sql(x: str) -> str:
    y = f"regexp_replace({x}, {lit('@' + NSP + '*')}, '', 'g')"
    y = f"replace({y}, chr(10), ' ')"
    y = f"replace({y}, '&amp;', '&')"
    return _strip_sql(y)


def _urls_sql(x: str) -> str:
    return f"regexp_replace({x}, {lit('https?://' + NSP + '+')}, '', 'g')"


@q("strip_urls", f"SELECT id, {_urls_sql('text')} AS text FROM posts", ("posts",))
def strip_urls(spark, sf):
    """T1."""
    return views.posts(spark, sf).select("id", T.remove_urls("text").alias("text"))


@q("strip_special", f"SELECT id, {_special_sql('text')} AS text FROM posts", ("posts",))
def strip_special(spark, sf):
    """T2."""
    return views.posts(spark, sf).select("id", T.remove_special_characters("text").alias("text"))


@q("clean_posts", f"SELECT id, {_special_sql(_urls_sql('text'))} AS text FROM posts", ("posts",))
def clean_posts(spark, sf):
    """T1 then T2."""
    return views.posts(spark, sf).select("id", T.clean_post_text("text").alias("text"))


@q("lower_text", "SELECT id, lower(text) AS text FROM posts", ("posts",))
def lower_text(spark, sf):
    """T4."""
    return views.posts(spark, sf).select("id", T.lowercase("text").alias("text"))


PUNCT_SQL = lit(string.punctuation)


@q("strip_punct", f"SELECT id, translate(text, {PUNCT_SQL}, '') AS text FROM posts", ("posts",))
def strip_punct(spark, sf):
    """T5."""
    return views.posts(spark, sf).select("id", T.remove_punctuation("text").alias("text"))


def _stop_sql() -> str:
    from ..functions.constants import STOPWORDS_EN
    stop = "[" + ", ".join(lit(w) for w in STOPWORDS_EN) + "]"
    words = f"list_filter(regexp_split_to_array({_strip_sql('text')}, {lit(SP + '+')}), lambda w: w <> '')"
    return (f"SELECT id, array_to_string(list_filter({words}, lambda w: NOT list_contains({stop}, w)), ' ') AS text "
            f"FROM posts")


@q("stopwords", _stop_sql(), ("posts",))
def stopwords(spark, sf):
    """English stop words removed (case sensitive), words re-joined by one blank."""
    return views.posts(spark, sf).select("id", T.remove_stopwords("text").alias("text"))


def _contractions_sql(x: str) -> str:
    """Words and the stretches between them, each word through a CASE over the same lists."""
    from ..functions.constants import CONTRACTION_ENDINGS, CONTRACTIONS, SHORT_FORMS
    full = "CASE lower(t) " + " ".join(
        f"WHEN {lit(k)} THEN {lit(v)}" for k, v in (CONTRACTIONS | SHORT_FORMS).items()) + " END"
    ends = " ".join(
        f"WHEN regexp_full_match(lower(t), {lit('[a-z]+' + e)}) THEN left(t, length(t) - {len(e)}) || "
        f"CASE WHEN t = upper(t) AND length(t) > {len(e) + 1} THEN {lit(v.upper())} ELSE {lit(v)} END"
        for e, v in CONTRACTION_ENDINGS.items())
    word = (f"CASE WHEN {full} IS NOT NULL THEN CASE WHEN t = upper(t) THEN upper({full}) "
            f"WHEN regexp_matches(t, '^[A-Z]') THEN upper(left({full}, 1)) || substr({full}, 2) ELSE {full} END "
            f"{ends} ELSE t END")
    y = f"replace({x}, {lit('’')}, {lit(chr(39))})"
    cut = "[A-Za-z0-9_']+|[^A-Za-z0-9_']+"
    joined = f"array_to_string(list_transform(regexp_extract_all({y}, {lit(cut)}), lambda t: {word}), '')"
    short = "(?i)(^|[^A-Za-z0-9_'])(" + "|".join(SHORT_FORMS) + ")([^A-Za-z0-9_']|$)"
    return (f"CASE WHEN contains({x}, {lit(chr(39))}) OR contains({x}, {lit('’')}) "
            f"OR regexp_matches({x}, {lit(short)}) THEN {joined} ELSE {x} END")


@q("contractions", f"SELECT id, {_contractions_sql('text')} AS text FROM posts", ("posts",))
def contractions(spark, sf):
    """Contractions and short forms expanded (the table in functions/constants.py)."""
    return views.posts(spark, sf).select("id", T.expand_contractions("text").alias("text"))


def _term_clean_sql(x: str) -> str:
    y = f"regexp_replace({x}, {lit(T.TERM_NOISE)}, ' ', 'g')"
    y = f"regexp_replace({y}, {lit(SP + '+')}, ' ', 'g')"
    return f"lower({_strip_sql(y)})"


@q("term_clean", f"SELECT id, {_term_clean_sql('text')} AS text FROM posts", ("posts",))
def term_clean(spark, sf):
    """T8."""
    return views.posts(spark, sf).select("id", T.clean_term("text").alias("text"))


def _t9_sql(x: str) -> str:
    y = f"regexp_replace({x}, {lit(T.WWW_URL)}, '', 'g')"
    y = f"regexp_replace({y}, {lit(T.EMOJI)}, '', 'g')"
    y = f"regexp_replace({y}, {lit(T.ESCAPES)}, '', 'g')"
    y = f"translate({y}, {PUNCT_SQL}, {lit(' ' * 32)})"
    return f"regexp_replace({y}, {lit(r'[^\x00-\x7F]')}, '', 'g')"


@q("nested_clean", f"""
SELECT {_t9_sql('p.text')} AS text, {_t9_sql('u.username')} AS username,
       {_t9_sql('u.description')} AS description, {_t9_sql('u.location')} AS location, p.created_utc
FROM posts p LEFT JOIN users u ON u.id = p.author_id""", ("posts", "users"))
def nested_clean(spark, sf):
    """Every string leaf of the nested post record cleaned (URL, emoji, escapes,
    punctuation, non-ASCII)."""
    p = clean_nested(_posts_with_users(spark, sf).select("text", "user", "created_utc"))
    return p.select("text", F.col("user.username").alias("username"),
                    F.col("user.description").alias("description"),
                    F.col("user.location").alias("location"), "created_utc")


@q("utc_date", """
SELECT id, CAST(DATE '1970-01-01' + CAST(floor(created_utc / 86400) AS INTEGER) AS VARCHAR) AS created_utc_date
FROM comments""", ("comments",))
def utc_date(spark, sf):
    """T10."""
    return views.comments(spark, sf).select("id", T.epoch_to_utc_date("created_utc").alias("created_utc_date"))


@q("post_triples", """
SELECT p.text, coalesce(u.location, '') AS location, CAST(p.created_at AS VARCHAR) AS created_at
FROM posts p LEFT JOIN users u ON u.id = p.author_id""", ("posts", "users"))
def post_triples(spark, sf):
    """(text, location or '', created_at)."""
    from ..sources.readers import post_triples as triples
    t = triples(_posts_with_users(spark, sf))
    return t.select("text", "location", F.col("created_at").cast("string").alias("created_at"))


# ======================================================================== forum threads
def _clean_subs(spark, sf):
    s = select.combine_title_body(views.submissions(spark, sf))
    return forum_chain("text", anonymize=True, bits=256)(s)


def _clean_comments(spark, sf):
    return forum_chain("body", anonymize=True, bits=256)(views.comments(spark, sf))


SUBS_SQL = f"""
subs_c AS (
  SELECT id, sha256(author) AS author, created_utc,
         CAST(DATE '1970-01-01' + CAST(floor(created_utc / 86400) AS INTEGER) AS VARCHAR) AS created_utc_date,
         {_hash_mentions_sql("(title || ' ' || selftext)", '/u/')} AS text
  FROM submissions),
subs_k AS (
  SELECT * FROM subs_c WHERE NOT coalesce(regexp_matches(lower(text), {lit(BANNED_RE)}), false)
    AND text IS NOT NULL AND text NOT IN ('[removed]', '[deleted]')),
comm_c AS (SELECT c.*, z.link_id FROM ({FORUM_SQL_BODY}) c JOIN comments z USING (id)),
comm_k AS (
  SELECT * FROM comm_c WHERE NOT coalesce(regexp_matches(lower(body), {lit(BANNED_RE)}), false)
    AND body IS NOT NULL AND body NOT IN ('[removed]', '[deleted]'))"""


@q("merge_thread", f"""
WITH {SUBS_SQL}
SELECT s.id AS sub_id, c.id AS comm_id, substring(c.link_id, 4) AS comm_sub_id
FROM subs_k s LEFT JOIN comm_k c ON s.id = substring(c.link_id, 4)""", ("submissions", "comments"))
def merge_thread(spark, sf):
    """J3 + T12 + F14 + X3: cleaned submissions left-joined with their cleaned comments."""
    m = threads.merge_threads(_clean_subs(spark, sf), _clean_comments(spark, sf))
    return m.select("sub_id", "comm_id", "comm_sub_id")


@q("concat_thread", f"""
WITH {SUBS_SQL}
SELECT id, type, created_utc_date, author FROM (
  SELECT id, 'sub' AS type, created_utc_date, author FROM subs_k
  UNION ALL SELECT id, 'comm' AS type, created_utc_date, author FROM comm_k) z""",
   ("submissions", "comments"))
def concat_thread(spark, sf):
    """Cleaned submissions and comments appended with a type column."""
    c = threads.concat_threads(_clean_subs(spark, sf), _clean_comments(spark, sf))
    return c.select("id", "type", "created_utc_date", "author")


@q("thread_depth", """
WITH RECURSIVE d(cid, depth) AS (
  SELECT id, 0 FROM comments WHERE parent IS NULL
  UNION ALL SELECT c.id, d.depth + 1 FROM comments c JOIN d ON c.parent = d.cid)
SELECT cid AS id, depth FROM d""", ("comments",))
def thread_depth(spark, sf):
    """Reply depth from parent links (recursive CTE)."""
    return threads.reply_depth(views.comments(spark, sf))


@q("quality_counts", f"""
WITH {SUBS_SQL},
m AS (SELECT s.id AS sub_id, c.id AS comm_id FROM subs_k s LEFT JOIN comm_k c ON s.id = substring(c.link_id, 4))
SELECT (SELECT count(*) FROM m) AS merged_rows, (SELECT count(*) FROM subs_k) AS submissions,
       (SELECT count(*) FROM comm_k) AS comments,
       (SELECT count(DISTINCT sub_id) FROM m WHERE comm_id IS NOT NULL) AS subs_with_comments""",
   ("submissions", "comments"))
def quality_counts(spark, sf):
    """Q3: merged rows, submissions, comments, submissions with a comment."""
    s, c = _clean_subs(spark, sf), _clean_comments(spark, sf)
    return quality.thread_counts(threads.merge_threads(s, c), s, c)


@q("duplicate_keys", """
SELECT l_orderkey, count(*) AS n FROM mentions GROUP BY l_orderkey HAVING count(*) > 1""", ("mentions",))
def duplicate_keys(spark, sf):
    """Q1/Q2: key values that occur more than once (here: orders with several mentions)."""
    return quality.duplicate_keys(views.mentions(spark, sf), ["l_orderkey"])


def registry() -> tuple[dict[str, QueryFn], dict[str, str]]:
    from . import queries_match, queries_more, queries_stream  # noqa: F401  (they register further queries)
    return QUERIES, ORACLE
