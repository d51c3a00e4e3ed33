"""Matching, extraction, normalization, similarity, report and model queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as TXT
from ..functions.patterns import WORD
from ..functions.text import clean_term
from ..operators import classify, entities, infer, keywords, lexicon, normalize, report, semantic
from ..operators import select as SEL
from ..operators import users as USERS
from ..operators.cube import MonthCube
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources import readers, sinks, views
from ..sources.tables import table
from ..streaming import stream
from .flagship import flagship
from .queries import ORACLE, lit, q, r6

# ======================================================================== M1 keyword spans
KEYWORDS = ["the", "of the", "and", "tion", "src1", "example.com", "Tamiflu", "ing"]


def _keyword_sql(kws) -> str:
    canon = {}
    for k in kws:
        canon[k.lower()] = k
    values = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in canon.items())
    # every boundary-valid occurrence, the longest per start, then the greedy walk over
    # ASOF links (first candidate starting at or after the end of the current one)
    return f"""
WITH RECURSIVE kw(k, name) AS (VALUES {values}),
lt AS (SELECT id, lower(text) AS t FROM posts),
pos AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM lt),
cand0 AS (SELECT p.id, p.i - 1 AS s, p.i - 1 + length(kw.k) AS e, kw.name
          FROM pos p JOIN kw ON substring(p.t, p.i, length(kw.k)) = kw.k
          WHERE (p.i = 1 OR NOT regexp_matches(substring(p.t, p.i - 1, 1), '[A-Za-z0-9_]'))
            AND (p.i + length(kw.k) > length(p.t)
                 OR NOT regexp_matches(substring(p.t, p.i + length(kw.k), 1), '[A-Za-z0-9_]'))),
cand AS (SELECT id, s, max(e) AS e, arg_max(name, e) AS name FROM cand0 GROUP BY id, s),
nxt AS (SELECT a.id, a.s, a.e, a.name, b.s AS ns FROM cand a ASOF LEFT JOIN cand b ON a.id = b.id AND b.s >= a.e),
walk AS (
  SELECT id, s, e, name, ns FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) AS rn FROM nxt) z
  WHERE rn = 1
  UNION ALL
  SELECT n.id, n.s, n.e, n.name, n.ns FROM walk w JOIN nxt n ON n.id = w.id AND n.s = w.ns)
SELECT id, name AS keyword, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM walk"""


@q("keyword_spans", _keyword_sql(KEYWORDS), ("posts",))
def keyword_spans(spark, sf):
    """M1: (id, keyword, start, end) for every keyword hit in the post texts (whole words,
    case-insensitive, longest first, no overlap)."""
    p = views.posts(spark, sf).select("id", "text")
    k = keywords.keyword_search(p, "text", KEYWORDS)
    # the outer form keeps Catalyst from inferring a filter on the array, which it would push
    # below the projections, matching every text several times more
    e = k.select("id", F.explode_outer("keywords_text").alias("k")).filter("k IS NOT NULL")
    return e.select("id", F.col("k.keyword").alias("keyword"), F.col("k.start").alias("start"),
                    F.col("k.end").alias("end"))


# ======================================================================== M2 lexicon
TOK = lit(WORD + "+")

def lex_ctes(source: str = "documents", id_col: str = "doc_id") -> str:
    """Oracle CTEs: normalized lexicon (lxx) and token positions (pos) of ``source``."""
    return f"""
lx0 AS (SELECT DISTINCT trim(replace("Symptom", chr(65279), '')) AS concept,
                        trim(replace("CUI", chr(65279), '')) AS code,
                        lower(trim(replace("LexicalExpression", chr(65279), ''))) AS expression FROM lexicon),
lx AS (SELECT concept, code, expression, regexp_extract_all(expression, {TOK}) AS et FROM lx0),
lxx AS (SELECT * FROM lx WHERE len(et) > 0),
dt AS (SELECT {id_col} AS doc_id, regexp_extract_all(lower(text), {TOK}) AS toks FROM {source}),
pos AS (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM dt),
hits AS (SELECT p.doc_id, p.i - 1 AS s, len(x.et) AS w, x.expression, x.concept, x.code
         FROM pos p JOIN lxx x ON p.toks[p.i] = x.et[1]
         WHERE p.toks[p.i : p.i + len(x.et) - 1] = x.et),
best AS (SELECT doc_id, s, max(w) AS w FROM hits GROUP BY doc_id, s),
nxt AS (SELECT a.doc_id, a.s, a.w, b.s AS ns FROM best a ASOF LEFT JOIN best b
        ON a.doc_id = b.doc_id AND b.s >= a.s + a.w),
walk AS (
  SELECT doc_id, s, w, ns FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS rn FROM nxt) z
  WHERE rn = 1
  UNION ALL
  SELECT n.doc_id, n.s, n.w, n.ns FROM walk k JOIN nxt n ON n.doc_id = k.doc_id AND n.s = k.ns),
kept AS (SELECT h.* FROM hits h JOIN walk k ON k.doc_id = h.doc_id AND k.s = h.s AND k.w = h.w)"""


# greedy leftmost-longest in SQL: each best span links to the first span starting at or
# after its end (ASOF join); the recursive walk follows those links from the first span
LEX_CTES = lex_ctes()


@q("lexicon_hits", f"""
WITH RECURSIVE {LEX_CTES}
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(w AS INTEGER) AS width, expression, concept, code
FROM hits""", ("lexicon",))
def lexicon_hits(spark, sf):
    """M2 before overlap removal: every occurrence of every lexicon expression in the
    documents (token positions)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lexicon.lexicon_hits(docs, views.passage_lexicon(spark, sf))


@q("lexicon_matches", f"""
WITH RECURSIVE {LEX_CTES}
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(w AS INTEGER) AS width, expression, concept, code
FROM kept""", ("lexicon",))
def lexicon_matches(spark, sf):
    """M2: leftmost-longest non-overlapping matches (also checked in pytest against a
    brute-force model)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lexicon.lexicon_matches(docs, views.passage_lexicon(spark, sf))


@q("lexicon_concepts", f"""
WITH RECURSIVE {LEX_CTES}
SELECT concept, code, count(*) AS mentions, count(DISTINCT doc_id) AS texts FROM kept GROUP BY concept, code""",
   ("lexicon",))
def lexicon_concepts(spark, sf):
    """M2 report: mentions and texts per concept after overlap removal."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lexicon.concept_counts(lexicon.lexicon_matches(docs, views.passage_lexicon(spark, sf)))


def _flagship_sql() -> str:
    from .queries import BANNED_RE, _hash_mentions_sql, _special_sql, _urls_sql
    # the cleaning step removes the hashed mentions, so the 256-bit hash gives the same result
    return f"""
WITH RECURSIVE
fp AS (SELECT id, created_utc, {_hash_mentions_sql('text', '@')} AS text FROM posts
       WHERE NOT coalesce(regexp_matches(lower(text), {lit(BANNED_RE)}), false)),
fc AS (SELECT id, created_utc, {_special_sql(_urls_sql('text'))} AS text FROM fp),
fu AS (SELECT id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY created_utc) AS rn FROM fc) z WHERE rn = 1),
{lex_ctes('fu', 'id')}
SELECT concept, code, count(*) AS mentions, count(DISTINCT doc_id) AS texts FROM kept GROUP BY concept, code"""


@q("flagship_concepts", _flagship_sql(), ("posts", "lexicon"))
def flagship_concepts(spark, sf):
    """The end-to-end slice: banned filter, mention hashing, cleaning, de-duplication,
    lexicon extraction, concept counts (the ``entry`` query on any scale)."""
    return flagship(spark, sf)


# ======================================================================== M3-M6, A1
@q("entity_strings", """
SELECT doc, string_agg(text, ', ' ORDER BY event_id) AS entity_texts,
       string_agg(type, ', ' ORDER BY event_id) AS entity_types
FROM ents GROUP BY doc""", ("ents",))
def entity_strings(spark, sf):
    """M3: entities and their types per text as ', '-joined strings ('N/A' when none)."""
    return entities.entity_strings(views.entity_lists(spark, sf)).select("doc", "entity_texts", "entity_types")


@q("entity_split", """
SELECT doc, string_agg(text, '|' ORDER BY event_id) FILTER (WHERE type = 'PROBLEM') AS symptoms,
       string_agg(text, '|' ORDER BY event_id) FILTER (WHERE type = 'TREATMENT') AS treatments
FROM ents GROUP BY doc""", ("ents",))
def entity_split(spark, sf):
    """M4: symptoms (PROBLEM) and treatments (TREATMENT) per text, NULL when none."""
    e = entities.split_symptoms_treatments(views.entity_lists(spark, sf))
    return e.select("doc", F.array_join("symptoms", "|").alias("symptoms"),
                    F.array_join("treatments", "|").alias("treatments"))


@q("entity_columns", """
SELECT doc,
  coalesce(string_agg(text, '|' ORDER BY event_id) FILTER (WHERE type = 'PROBLEM'), '') AS symptoms,
  coalesce(string_agg(text, '|' ORDER BY event_id) FILTER (WHERE type = 'TEST'), '') AS tests,
  coalesce(string_agg(text, '|' ORDER BY event_id) FILTER (WHERE type = 'TREATMENT'), '') AS treatments
FROM ents GROUP BY doc""", ("ents",))
def entity_columns(spark, sf):
    """M5: Symptoms, Tests, Treatments lists per text (empty when none)."""
    e = entities.extract_entity_columns(views.entity_lists(spark, sf))
    return e.select("doc", F.array_join("Symptoms", "|").alias("symptoms"),
                    F.array_join("Tests", "|").alias("tests"),
                    F.array_join("Treatments", "|").alias("treatments"))


@q("entity_frequency", """
SELECT type, text, count(*) AS frequency FROM ents
WHERE type IN ('PROBLEM', 'TREATMENT', 'TEST') GROUP BY type, text""", ("ents",))
def entity_frequency(spark, sf):
    """A1: frequency per (entity type, raw text)."""
    return entities.entity_frequency(views.entity_rows(spark, sf))


@q("subword_merge", """
SELECT doc_id,
  CASE WHEN len(tokens) > 0 THEN array_to_string(list_transform(starts, lambda s, j:
         tokens[s] || array_to_string(list_transform(tokens[s + 1 : coalesce(starts[j + 1], len(tokens) + 1) - 1],
                                                     lambda x: replace(x, '##', '')), '')), ' ') END AS merged
FROM (SELECT doc_id, tokens,
             list_filter(range(1, len(tokens) + 1), lambda i: i = 1 OR NOT starts_with(tokens[i], '##')) AS starts
      FROM toks) z""", ("toks",))
def subword_merge(spark, sf):
    """M6: word pieces glued back into words, joined by blanks (NULL when no tokens)."""
    t = views.subword_tokens(spark, sf)
    return t.select("doc_id", F.array_join(entities.merge_subwords("tokens"), " ").alias("merged"))


# ======================================================================== M9-M11
@q("model_score", "SELECT doc_id, length(text) AS prediction FROM documents")
def model_score(spark, sf):
    """M9: a batch predictor over Arrow batches (stand-in model: character count)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    parts = spark.sparkContext.defaultParallelism
    return infer.score_batches(d, lambda: infer.CharCountPredictor("text", "prediction"),
                               "doc_id long, prediction long", partitions=parts)


LABELS = ["report", "symptom"]
THRESHOLDS = {"report": 0.28, "symptom": 0.27}


@q("label_best", """
SELECT doc_id, CASE WHEN s_symptom > s_report THEN 1 ELSE 0 END AS best FROM scores""", ("scores",))
def label_best(spark, sf):
    """Index of the best-scoring candidate label (first on ties)."""
    s = views.label_scores(spark, sf)
    return s.select("doc_id", classify.best_label_index("scores", LABELS).alias("best"))


@q("label_vote", f"""
SELECT doc_id, CASE WHEN s_report > {THRESHOLDS['report']} AND s_symptom > {THRESHOLDS['symptom']}
                    THEN 1 ELSE 0 END AS vote FROM scores""", ("scores",))
def label_vote(spark, sf):
    """1 when every label score is strictly above its threshold."""
    s = views.label_scores(spark, sf)
    return s.select("doc_id", classify.threshold_vote("scores", THRESHOLDS).alias("vote"))


# ======================================================================== M12, M13, A9
def _clean_sql(x: str) -> str:
    from .queries import _term_clean_sql
    return _term_clean_sql(x)


NORM_CTES = f"""
rm AS (SELECT DISTINCT {_clean_sql('p_name')} AS t FROM part WHERE {_clean_sql('p_name')} LIKE 'new %'),
mp AS (SELECT symptoms AS k, min(abr_symptoms) AS v FROM dict GROUP BY symptoms),
ex AS (SELECT l_orderkey, unnest(symptoms) AS raw FROM terms),
cl AS (SELECT l_orderkey, {_clean_sql('raw')} AS t FROM ex),
nj AS (SELECT cl.l_orderkey, rm.t IS NULL AS keep, mp.v, cl.t FROM cl LEFT JOIN rm ON rm.t = cl.t
       LEFT JOIN mp ON mp.k = cl.t)"""


def _normalized(spark, sf):
    terms = views.term_lists(spark, sf)
    d = views.concept_dictionary(spark, sf)
    part = table(spark, sf, "part").select(clean_term("p_name").alias("t"))
    remove = part.filter(F.col("t").startswith("new ")).distinct()
    mapping = d.groupBy("symptoms").agg(F.min("abr_symptoms").alias("abr"))
    return normalize.normalize_terms(terms, "l_orderkey", "symptoms", mapping, remove)


@q("normalize_terms", f"""
WITH {NORM_CTES}
SELECT l_orderkey,
  array_to_string(list_sort(list_distinct(list(CASE WHEN keep THEN replace(coalesce(v, t), ' ', '_') END))), ' ')
    AS normalized_symptom_str,
  coalesce(bool_or(keep AND v IS NOT NULL AND v <> t), false) AS replaced
FROM nj GROUP BY l_orderkey""", ("terms", "dict"))
def normalize_terms(spark, sf):
    """Cleaned, filtered, mapped, de-duplicated term lists per order; ``replaced``."""
    return _normalized(spark, sf).select("l_orderkey", "normalized_symptom_str", "replaced")


@q("vocabulary", f"""
WITH {NORM_CTES}
SELECT DISTINCT replace(coalesce(v, t), ' ', '_') AS term FROM nj WHERE keep""", ("terms", "dict"))
def vocabulary(spark, sf):
    """The vocabulary of normalized terms."""
    return normalize.vocabulary(_normalized(spark, sf), "normalized_symptom_list")


@q("normalize_treatments", f"""
WITH {NORM_CTES}
SELECT l_orderkey,
  array_to_string(list_sort(list_distinct(list(CASE WHEN keep THEN replace(coalesce(v, t), ' ', '_') END))), ' ')
    AS normalized_treatment_str
FROM nj GROUP BY l_orderkey""", ("terms", "dict"))
def normalize_treatments(spark, sf):
    """The same normalization without the ``replaced`` flag."""
    terms = views.term_lists(spark, sf)
    d = views.concept_dictionary(spark, sf)
    part = table(spark, sf, "part").select(clean_term("p_name").alias("t"))
    remove = part.filter(F.col("t").startswith("new ")).distinct()
    mapping = d.groupBy("symptoms").agg(F.min("abr_symptoms").alias("abr"))
    n = normalize.normalize_terms(terms, "l_orderkey", "symptoms", mapping, remove,
                                  out_prefix="normalized_treatment", with_replaced=False)
    return n.select("l_orderkey", "normalized_treatment_str")


# ======================================================================== M7 dense
@q("semantic_best", """
SELECT term, concept, round(score, 6) AS score FROM (
  SELECT q.term, c.concept, list_cosine_similarity(q.vector, c.vector) AS score,
         row_number() OVER (PARTITION BY q.term ORDER BY list_cosine_similarity(q.vector, c.vector) DESC,
                                                       c.concept) AS rn
  FROM qvec q CROSS JOIN cvec c) z WHERE rn = 1""", ("qvec", "cvec"))
def semantic_best(spark, sf):
    """M7 + J7: best dictionary concept per term vector by cosine."""
    b = semantic.best_concepts_dense(views.query_vectors(spark, sf), views.concept_vectors(spark, sf), k=1)
    return b.select("term", "concept", r6(F.col("score")).alias("score"))


@q("semantic_top3", """
SELECT term, CAST(rn AS INTEGER) AS rank, concept, round(score, 6) AS score FROM (
  SELECT q.term, c.concept, list_cosine_similarity(q.vector, c.vector) AS score,
         row_number() OVER (PARTITION BY q.term ORDER BY list_cosine_similarity(q.vector, c.vector) DESC,
                                                       c.concept) AS rn
  FROM qvec q CROSS JOIN cvec c) z WHERE rn <= 3""", ("qvec", "cvec"))
def semantic_top3(spark, sf):
    """O3: top-3 concepts per term (the reference keeps rank 1)."""
    b = semantic.best_concepts_dense(views.query_vectors(spark, sf), views.concept_vectors(spark, sf), k=3)
    return b.select("term", "rank", "concept", r6(F.col("score")).alias("score"))


# ======================================================================== M7 sparse, M8, A2-A8, E1
BOW_CTES = f"""
qt AS (SELECT term, len(tk) AS nq, unnest(tk) AS tok FROM (
  SELECT term, list_distinct(regexp_extract_all(lower(term), {TOK})) AS tk
  FROM (SELECT DISTINCT symptom_adjusted AS term FROM mentions WHERE symptom_adjusted IS NOT NULL) a) b),
ct AS (SELECT key, label, len(tk) AS nc, unnest(tk) AS tok FROM (
  SELECT symptoms AS key, abr_symptoms AS label, list_distinct(regexp_extract_all(lower(symptoms), {TOK})) AS tk
  FROM dict) c),
pr AS (SELECT term, key, label, CAST(count(*) AS DOUBLE) / sqrt(CAST(nq * nc AS DOUBLE)) AS score
       FROM qt JOIN ct USING (tok) GROUP BY term, key, label, nq, nc),
best AS (SELECT term, label AS semantics, score FROM (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, key) AS rn FROM pr) r WHERE rn = 1)"""

MAP_CTES = BOW_CTES + """,
freq AS (SELECT symptom_adjusted, count(*) AS frequency FROM mentions WHERE symptom_adjusted IS NOT NULL GROUP BY 1),
cut AS (SELECT f.symptom_adjusted, f.frequency, b.semantics, b.score FROM freq f
        JOIN best b ON b.term = f.symptom_adjusted WHERE b.score > 0.45 AND b.semantics <> ''),
mapped AS (SELECT semantics, sum(frequency) AS frequency FROM cut GROUP BY semantics),
dim AS (SELECT DISTINCT abr_symptoms AS abr, categories AS category FROM dict),
mcat AS (SELECT m.semantics AS symptom, d.category AS lancet_category FROM mapped m LEFT JOIN dim d ON d.abr = m.semantics),
enr AS (SELECT mn.*, c.semantics, c.score FROM mentions mn LEFT JOIN cut c ON c.symptom_adjusted = mn.symptom_adjusted),
enr2 AS (SELECT e.*, mc.symptom, mc.lancet_category FROM enr e LEFT JOIN mcat mc ON mc.symptom = e.semantics),
f4 AS (SELECT symptom, count(*) AS frequency FROM enr2 WHERE symptom IS NOT NULL GROUP BY symptom),
c4 AS (SELECT f4.symptom, f4.frequency, d.category AS lancet_category FROM f4 LEFT JOIN dim d ON d.abr = f4.symptom),
k4 AS (SELECT * FROM c4 WHERE lancet_category IS NULL OR lancet_category NOT IN ('Noise')),
tot AS (SELECT CAST(sum(frequency) AS DOUBLE) AS t FROM k4),
cats AS (SELECT DISTINCT lancet_category FROM k4),
fin AS (SELECT e.* FROM enr2 e WHERE EXISTS (
  SELECT 1 FROM cats c WHERE c.lancet_category IS NOT DISTINCT FROM e.lancet_category))"""


def _best_bow(spark, sf, source=None):
    """Best dictionary entry per distinct term; ``source`` is any table with the term
    column (the mentions view by default, or an aggregate of it)."""
    m = views.mentions(spark, sf) if source is None else source
    terms = m.select(F.col("symptom_adjusted").alias("term")).filter(F.col("term").isNotNull()).distinct()
    d = views.concept_dictionary(spark, sf)
    return semantic.best_concepts_sparse(terms.withColumn("text", F.col("term")),
                                         d.select(F.col("symptoms").alias("key"),
                                                  F.col("abr_symptoms").alias("label"),
                                                  F.col("symptoms").alias("text")))


def _enriched(spark, sf):
    return semantic.map_mentions(views.mentions(spark, sf), _best_bow(spark, sf),
                                 views.concept_dictionary(spark, sf))


def _month_cube(spark, sf, path=None):
    """The stored cube of a folder of tables; lineitem holds the mentions, by order month."""
    def dated(rows):
        orders = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        return rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("file", "month")

    def build(rows):
        # the mapping depends on the term only, so it is applied to (term, country, month) counts;
        # distinct terms come from the same aggregate (its exchange is reused)
        terms = report.term_cube(views.mentions(spark, sf, rows))
        mapped = semantic.map_mentions(terms, _best_bow(spark, sf, terms), views.concept_dictionary(spark, sf),
                                       count_col="n")
        return report.mention_cube(mapped, "month", count_col="n", is_month=True)

    sf = sf.rstrip("/")
    place = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/mention-cube-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    return MonthCube(spark, place, f"{sf}/lineitem.parquet",
                     [f"{sf}/{t}.parquet" for t in ("part", "orders", "customer", "nation")], dated, build)


def _cube(spark, sf):
    """Mentions counted by (symptom, category, country, month), brought up to date with the tables.

    The reports below read it several times each; months whose files are as they were are
    read, the others are counted again (``operators.cube``)."""
    cube = _month_cube(spark, sf)
    cube.refresh()
    return cube.read()


def _shares(spark, sf, cube=None):
    c = cube if cube is not None else _cube(spark, sf)
    return report.concept_share(c, views.concept_dictionary(spark, sf), count_col="n")


@q("semantic_bow", f"WITH {BOW_CTES} SELECT term, semantics, round(score, 6) AS score FROM best",
   ("mentions", "dict"))
def semantic_bow(spark, sf):
    """M7 (sparse): best dictionary entry per distinct term by bag-of-words cosine."""
    return _best_bow(spark, sf).select("term", "semantics", r6(F.col("score")).alias("score"))


@q("term_frequency", """
SELECT symptom_adjusted, count(*) AS frequency FROM mentions WHERE symptom_adjusted IS NOT NULL GROUP BY 1""",
   ("mentions",))
def term_frequency(spark, sf):
    """A2: frequency per extracted term."""
    return report.term_frequency(views.mentions(spark, sf))


@q("semantic_concepts", f"WITH {MAP_CTES} SELECT semantics, sum(frequency) AS count FROM cut GROUP BY semantics",
   ("mentions", "dict"))
def semantic_concepts(spark, sf):
    """F10 + A3: summed term frequency per mapped concept above the cut-off."""
    freq = report.term_frequency(views.mentions(spark, sf))
    b = _best_bow(spark, sf).withColumnRenamed("term", "symptom_adjusted")
    return semantic.semantic_frequency(freq.join(b, "symptom_adjusted"))


@q("map_mentions", f"""
WITH {MAP_CTES}
SELECT l_orderkey, l_linenumber, symptom, lancet_category, round(score, 6) AS score FROM enr2""",
   ("mentions", "dict"))
def map_mentions(spark, sf):
    """M8 + J4-J6: every mention with its mapped concept, category and score."""
    e = _enriched(spark, sf)
    return e.select("l_orderkey", "l_linenumber", "symptom", "lancet_category", r6(F.col("score")).alias("score"))


@q("concept_share", f"""
WITH {MAP_CTES}
SELECT symptom, frequency, lancet_category, round(CAST(100 AS DOUBLE) * frequency / (SELECT t FROM tot), 6) AS perc
FROM k4""", ("mentions", "dict"))
def concept_share(spark, sf):
    """A4 + F11: concept frequency, category, percent of the total after noise removal."""
    s = _shares(spark, sf)
    return s.select("symptom", "frequency", "lancet_category", r6(F.col("perc")).alias("perc"))


@q("category_share", f"""
WITH {MAP_CTES}
SELECT lancet_category, sum(frequency) AS count,
       round(CAST(100 AS DOUBLE) * sum(frequency) / (SELECT t FROM tot), 6) AS perc
FROM k4 WHERE lancet_category IS NOT NULL AND lancet_category NOT IN ('uncategorized', 'noise')
GROUP BY lancet_category""", ("mentions", "dict"))
def category_share(spark, sf):
    """A5: category share over the A4 total."""
    c = report.category_share(_shares(spark, sf))
    return c.select("lancet_category", "count", r6(F.col("perc")).alias("perc"))


@q("uncategorized_top", f"""
WITH {MAP_CTES}
SELECT symptom, frequency, round(CAST(100 AS DOUBLE) * frequency / (SELECT t FROM tot), 6) AS perc
FROM k4 WHERE lancet_category = 'uncategorized' ORDER BY frequency DESC, symptom LIMIT 16""",
   ("mentions", "dict"))
def uncategorized_top(spark, sf):
    """A6 + O2: the 16 most frequent uncategorized concepts (a top-k report)."""
    u = report.uncategorized_top(_shares(spark, sf), 16)
    return u.select("symptom", "frequency", r6(F.col("perc")).alias("perc"))


@q("country_share", f"""
WITH {MAP_CTES}
SELECT country, count(*) AS count, round(count(*) / (SELECT t FROM tot), 6) AS perc
FROM fin WHERE country IS NOT NULL GROUP BY country""", ("mentions", "dict"))
def country_share(spark, sf):
    """A7 + F13: mentions per country among the reported categories, fraction of the total."""
    cube = _cube(spark, sf)
    c = report.country_share(cube, _shares(spark, sf, cube), count_col="n")
    return c.select("country", "count", r6(F.col("perc")).alias("perc"))


@q("category_country", f"""
WITH {MAP_CTES},
bm AS (SELECT lancet_category AS category, sum(frequency) AS bm FROM k4 GROUP BY 1),
g AS (SELECT lancet_category AS category, country, count(*) AS n FROM fin WHERE country IS NOT NULL GROUP BY 1, 2),
x AS (SELECT g.category, g.country, CAST(100 AS DOUBLE) * g.n / bm.bm AS perc
      FROM g JOIN bm ON g.category IS NOT DISTINCT FROM bm.category)
SELECT category, country, round(perc, 6) AS perc FROM x WHERE perc >= 1""", ("mentions", "dict"))
def category_country(spark, sf):
    """A8 (long form): percent of a category's mentions per country, cells under 1 dropped."""
    cube = _cube(spark, sf)
    c = report.category_country_long(cube, _shares(spark, sf, cube), count_col="n")
    return c.select("category", "country", r6(F.col("perc")).alias("perc"))


# FIXED VALUES: the nations of the test tables.
COUNTRIES = ["ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "CHINA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY",
             "INDIA", "INDONESIA", "IRAN", "IRAQ", "JAPAN", "JORDAN", "KENYA", "MOROCCO", "MOZAMBIQUE", "PERU",
             "ROMANIA", "RUSSIA", "SAUDI ARABIA", "UNITED KINGDOM", "UNITED STATES", "VIETNAM"]


@q("category_country_matrix", f"""
WITH {MAP_CTES},
bm AS (SELECT lancet_category AS category, sum(frequency) AS bm FROM k4 GROUP BY 1),
g AS (SELECT lancet_category AS category, country, count(*) AS n FROM fin WHERE country IS NOT NULL GROUP BY 1, 2),
x AS (SELECT g.category, g.country, CAST(100 AS DOUBLE) * g.n / bm.bm AS perc
      FROM g JOIN bm ON g.category IS NOT DISTINCT FROM bm.category)
SELECT category, {", ".join(f"max(round(perc, 6)) FILTER (WHERE country = '{c}') AS {chr(34)}{c}{chr(34)}" for c in COUNTRIES)}
FROM x WHERE perc >= 1 GROUP BY category""", ("mentions", "dict"))
def category_country_matrix(spark, sf):
    """A8 as the pivoted category x country matrix (one column per listed country)."""
    cube = _cube(spark, sf)
    m = report.category_country_matrix(cube, _shares(spark, sf, cube), COUNTRIES, count_col="n")
    return m.select("category", *[r6(F.col(f"`{c}`")).alias(c) for c in m.columns if c != "category"])


@q("month_trend", f"""
WITH {MAP_CTES}
SELECT strftime(CAST(created_date AS DATE), '%Y-%m') AS month, symptom AS concept, count(*) AS count
FROM enr2 WHERE symptom IS NOT NULL GROUP BY 1, 2""", ("mentions", "dict"))
def month_trend(spark, sf):
    """Mapped-concept mentions per month."""
    return report.month_trend(_cube(spark, sf), "month", count_col="n", is_month=True)


# ======================================================================== streaming


@q("stream_clean")
def stream_clean(spark, sf):
    """ST1 + ST2: the shipped cleaning chain as a file-stream query (availableNow, checkpointed)."""
    out = stream.run_to_parquet(stream.clean_post_stream(spark, sf, bits=256, max_files_per_trigger=4), "stream-clean")
    return out.select("user.*", *[c for c in out.columns if c != "user"])


ORACLE["stream_clean"] = ORACLE["pass_chain"]


@q("stream_unique", "SELECT DISTINCT user_id, event_type FROM events")
def stream_unique(spark, sf):
    """ST3: every (user, event type) of the event stream once, over all micro-batches."""
    out = stream.run_to_parquet(stream.unique_events_stream(spark, sf), "stream-unique")
    return out.select("user_id", "event_type")


@q("stream_unique_text", "SELECT DISTINCT sha256(text) AS text_sha FROM documents")
def stream_unique_text(spark, sf):
    """ST3 / F8 across micro-batches: one row per distinct document text."""
    out = stream.run_to_parquet(stream.unique_text_stream(spark, sf), "stream-unique-text")
    return out.select("text_sha")


@q("stream_daily", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2""")
def stream_daily(spark, sf):
    """E1 streaming: events per day and type; every batch writes the groups it changed."""
    return stream.run_to_parquet(stream.daily_counts_stream(spark, sf), "stream-daily", "update",
                                 keys=["day", "event_type"])


# ======================================================================== sources and sinks


@q("json_roundtrip", "SELECT id, author_id, text FROM posts", ("posts",))
def json_roundtrip(spark, sf):
    """S10 + S1: posts appended as JSON with sorted keys and read back with the explicit post schema."""
    p = views.posts(spark, sf).select("id", "author_id", "text", "lang")
    path = scratch_path(spark, "posts-json")
    sinks.append_json_sorted(p, path)
    back = readers.read_posts(spark, path, schemas.POST, multiline=False)
    return back.select("id", "author_id", "text")


@q("csv_roundtrip", """
SELECT symptom_adjusted, count(*) AS frequency FROM mentions WHERE symptom_adjusted IS NOT NULL GROUP BY 1""",
   ("mentions",))
def csv_roundtrip(spark, sf):
    """S11 + S8: the mention table written as CSV with a header and read back (all strings,
    as a sheet export is), then counted per term (A2)."""
    path = scratch_path(spark, "mentions-csv")
    sinks.write_table(views.mentions(spark, sf), path, fmt="csv")
    back = readers.read_delimited(spark, path)
    return report.term_frequency(back)


@q("entity_sink", """
SELECT type, text, count(*) AS frequency FROM ents
WHERE type IN ('PROBLEM', 'TREATMENT', 'TEST') GROUP BY type, text""", ("ents",))
def entity_sink(spark, sf):
    """Entity frequencies written as one table partitioned by entity type, read back."""
    path = scratch_path(spark, "entity-freq")
    freq = entities.entity_frequency(views.entity_rows(spark, sf))
    sinks.write_entity_frequencies(freq, path)
    return spark.read.schema(freq.schema).parquet(path).select("type", "text", "frequency")


@q("lexicon_file", f"""
WITH RECURSIVE {LEX_CTES}
SELECT concept, count(*) AS expressions FROM lxx GROUP BY concept""", ("lexicon",))
def lexicon_file(spark, sf):
    """The lexicon written as a tab-separated file with a header (and a byte-order mark
    in a data row, as the shipped file has), read back and normalized."""
    lex = views.passage_lexicon(spark, sf)
    lex = lex.withColumn("Symptom", F.concat(F.lit("﻿"), F.col("Symptom")))
    path = scratch_path(spark, "lexicon-tsv")
    lex.write.option("header", True).option("sep", "\t").csv(path)
    norm = lexicon.normalize_lexicon(readers.read_lexicon(spark, path))
    return norm.groupBy("concept").agg(F.count(F.lit(1)).alias("expressions"))


@q("stage_output", "SELECT id, lang FROM posts WHERE lang = 'en'", ("posts",))
def stage_output(spark, sf):
    """S14 (batch): a stage output written to the shared folder and read back (lineage cut)."""
    p = views.posts(spark, sf).filter(F.col("lang") == "en").select("id", "lang")
    return sinks.stage_output(p, scratch_path(spark, "stage"))


# ======================================================================== more selection / reports
FIELDS_CFG = SEL.CollectConfig(include=("the", "and"), language=("en",), fields=("text", "created_at"))


@q("collect_fields", f"""
SELECT p.id, p.text, CAST(p.created_at AS VARCHAR) AS created_at, u.id AS user_id
FROM posts p LEFT JOIN users u ON u.id = p.author_id
WHERE p.lang = 'en' AND regexp_matches(lower(p.text), {lit(SEL.word_set_pattern(FIELDS_CFG.include))})""",
   ("posts", "users"))
def collect_fields(spark, sf):
    """F1 + F3: posts with either phrase, projected to the configured fields plus the user record."""
    p = USERS.attach_users(views.posts(spark, sf), views.users(spark, sf), user_order="username")
    out = SEL.collect(p, FIELDS_CFG, time_col=None)
    return out.select("id", "text", F.col("created_at").cast("string").alias("created_at"),
                      F.col("user.id").alias("user_id"))


@q("first_texts", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_texts(spark, sf):
    """process only the first n texts (n = 100 here; -1 keeps all)."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return SEL.first_n(d, 100, "doc_id")


@q("concept_share_over1", f"""
WITH {MAP_CTES}
SELECT symptom, round(CAST(100 AS DOUBLE) * frequency / (SELECT t FROM tot), 6) AS perc FROM k4
WHERE lancet_category IS NULL OR lancet_category NOT IN ('uncategorized', 'noise')""", ("mentions", "dict"))
def concept_share_over1(spark, sf):
    """F11 + F12: plotted concepts: categorized rows of A4 whose share is above 1 %."""
    s = SEL.exclude_categories(_shares(spark, sf), "lancet_category", ["uncategorized", "noise"])
    s = SEL.share_filter(s, "perc", 1.0)
    return s.select("symptom", r6(F.col("perc")).alias("perc"))


ORACLE["concept_share_over1"] = ORACLE["concept_share_over1"].replace(
    "WHERE lancet_category IS NULL OR lancet_category NOT IN ('uncategorized', 'noise')",
    "WHERE (lancet_category IS NULL OR lancet_category NOT IN ('uncategorized', 'noise')) "
    "AND CAST(100 AS DOUBLE) * frequency / (SELECT t FROM tot) > 1")


@q("user_demographics", "SELECT id, length(username) AS prediction FROM users", ("users",))
def user_demographics(spark, sf):
    """J2 + M9: per-user predictions from a batch predictor joined back to the users
    (stand-in predictor: length of the user name)."""
    u = views.users(spark, sf)
    pred = infer.score_batches(u.select("id", "username"),
                               lambda: infer.CharCountPredictor("username", "prediction"),
                               "id string, prediction long")
    out = USERS.attach_predictions(u, pred, "id")
    return out.select("id", F.col("demographic_info.prediction").alias("prediction"))


def _default_clean_sql() -> str:
    from .queries import _contractions_sql, _special_sql
    return f"SELECT id, {_special_sql(_contractions_sql('text'))} AS text FROM posts"


@q("default_clean", _default_clean_sql(), ("posts",))
def default_clean(spark, sf):
    """Default cleaning order (contractions, special characters) on the posts."""
    return views.posts(spark, sf).select("id", TXT.default_clean("text").alias("text"))


@q("vocabulary_size", f"""
WITH {NORM_CTES}
SELECT count(DISTINCT replace(coalesce(v, t), ' ', '_')) AS n_terms FROM nj WHERE keep""", ("terms", "dict"))
def vocabulary_size(spark, sf):
    """Number of distinct normalized terms."""
    return normalize.vocabulary_size(_normalized(spark, sf), "normalized_symptom_list")


@q("term_totals", """
SELECT sum(frequency) AS total, count(*) AS n_terms FROM (
  SELECT symptom_adjusted, count(*) AS frequency FROM mentions WHERE symptom_adjusted IS NOT NULL GROUP BY 1) z""",
   ("mentions",))
def term_totals(spark, sf):
    """A2: total term occurrences and number of distinct terms."""
    return report.frequency_totals(report.term_frequency(views.mentions(spark, sf)))


@q("top_terms", """
SELECT symptom_adjusted, count(*) AS frequency FROM mentions WHERE symptom_adjusted IS NOT NULL
GROUP BY 1 ORDER BY frequency DESC, symptom_adjusted LIMIT 10""", ("mentions",))
def top_terms(spark, sf):
    """O1 + O2: the ten most frequent extracted terms (a top-k report; ties by term)."""
    return report.top_n(report.term_frequency(views.mentions(spark, sf)), 10, "frequency", "symptom_adjusted")


@q("top_concepts_per_country", f"""
WITH {MAP_CTES},
cc AS (SELECT country, symptom, count(*) AS count FROM enr2 WHERE symptom IS NOT NULL AND country IS NOT NULL
       GROUP BY 1, 2)
SELECT country, symptom, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY country ORDER BY count DESC, symptom) AS rank FROM cc) z
WHERE rank <= 3""", ("mentions", "dict"))
def top_concepts_per_country(spark, sf):
    """O2 per group: the three most frequent mapped concepts of every country."""
    cube = _cube(spark, sf)
    cc = (cube.filter(F.col("symptom").isNotNull() & F.col("country").isNotNull())
          .groupBy("country", "symptom").agg(F.sum("n").alias("count")))
    top = report.top_n_per_group(cc, "country", 3, [F.col("count").desc(), F.col("symptom")])
    return top.select("country", "symptom", "count", F.col("rank").cast("int").alias("rank"))


@q("country_coverage", f"""
WITH {MAP_CTES}
SELECT round((SELECT count(*) FROM fin WHERE country IS NOT NULL) / (SELECT t FROM tot), 6) AS covered""",
   ("mentions", "dict"))
def country_coverage(spark, sf):
    """Fraction of the reported mentions that carry a country."""
    cube = _cube(spark, sf)
    c = report.country_coverage(cube, _shares(spark, sf, cube), count_col="n")
    return c.select(r6(F.col("covered")).alias("covered"))


def _self_report_sql() -> str:
    from .queries import TAG_PATTERNS, _special_sql, _urls_sql
    from ..functions.patterns import py_classes
    cases = ", ".join(f"CASE WHEN regexp_matches(text, {lit(py_classes(p))}) THEN {lit(p)} END"
                      for p in TAG_PATTERNS)
    return f"""
WITH t AS (SELECT p.created_utc, {_special_sql(_urls_sql('p.text'))} AS text, coalesce(u.location, '') AS geo,
                  CAST(p.created_at AS VARCHAR) AS ts
           FROM posts p LEFT JOIN users u ON u.id = p.author_id),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY created_utc) AS rn FROM t) z
      WHERE rn = 1)
SELECT text AS report_text, coalesce(nullif(concat_ws(', ', {cases}), ''), 'N/A') AS regex_matched,
       geo, coalesce(ts, 'NA') AS timestamp FROM f"""


@q("self_reports", _self_report_sql(), ("posts", "users"))
def self_reports(spark, sf):
    """The extraction entry chain: post triples (S2) -> cleaning (T3) -> first occurrence
    per text (F8) -> regex self-report table (F7): report_text, regex_matched, geo, timestamp."""
    from ..sources.readers import post_triples
    from .queries import TAG_PATTERNS
    p = USERS.attach_users(views.posts(spark, sf), views.users(spark, sf), user_order="username")
    t = post_triples(p.withColumn("text", TXT.clean_post_text("text")), keep=("created_utc",))
    t = sinks.stage_output(t, scratch_path(spark, "clean-triples"))        # a text is cleaned once
    u = SEL.unique_first(t, "text", "created_utc")
    return SEL.self_report_rows(u, TAG_PATTERNS)
