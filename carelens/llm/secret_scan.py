"""Secret scan by a trigram inverted index, with DataFrame functions only.

Each rule is a regular expression.  Its Boolean trigram query follows from the expression
itself: a text that matches must hold all trigrams of one of some alternatives.  The texts
are indexed by the trigrams that any rule's query names (lower case, so the query holds in
either case): a posting is (trigram, text).  The postings of an alternative are intersected
by counting, per text, how many of its trigrams are there; a text with all of them is a
candidate of the rule.  Candidates alone are searched with the expression.  A rule without a
mandatory trigram is searched in every text.

Postings name a text by a 64-bit hash of id and text; equal hashes of different rows only
make needless candidates.  The rule set is the small side and is broadcast; postings are
aggregated per text, so a trigram in a third of all texts is no hot key.  Candidates are
joined to the documents by that hash, by broadcast where they are few.
"""

from __future__ import annotations

import re
from re import _constants as sre, _parser

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import prefix_sum
from ..session import scratch_path

#: Rules: kind, expression, the group that the least length is for, the least length.
BASE_RULES = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a run of 16 or more is a whole run: shorter ones need not be matched to be dropped
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further published shapes of credentials.
MORE_RULES = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36),
    ("bearer", r"(?i:authorization)\x20*[:=]\x20*[\"']?(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
    ("url_login", r"://[A-Za-z0-9._%-]+:([^\x00-\x20@/:]+)@", 1, 4),
)
RULES = BASE_RULES + MORE_RULES

#: Exact string sets of an expression are followed up to this many strings.
_STRINGS = 64


# ---------------------------------------------------------------- trigram queries
def _grams(text: str) -> frozenset:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _absorbed(query: set) -> frozenset:
    """A disjunction without the conjunctions that imply another one."""
    return frozenset(c for c in query if not any(other < c for other in query))


ANY = frozenset([frozenset()])


def _both(a: frozenset, b: frozenset) -> frozenset:
    """The query a AND b; one too long to write out keeps its more selective side."""
    if len(a) * len(b) > _STRINGS:
        return max(a, b, key=lambda q: min(map(len, q)))
    return _absorbed({x | y for x in a for y in b})


class _Part:
    """What a piece of an expression matches: exactly some strings, or what the query allows."""

    def __init__(self, strings: set | None, query: frozenset = ANY):
        self.strings, self.query = strings, query

    def asked(self) -> frozenset:
        if self.strings is None:
            return self.query
        return _absorbed({_grams(s) for s in self.strings})


def _sequence(parts: list[_Part]) -> _Part:
    """Parts side by side: neighbouring exact sets are joined while they stay small."""
    query, run = ANY, {""}
    for part in parts:
        if part.strings is not None and len(run) * len(part.strings) <= _STRINGS:
            run = {a + b for a in run for b in part.strings}
            continue
        query = _both(query, _Part(run).asked())
        run = {""}
        if part.strings is not None:
            run = part.strings
        else:
            query = _both(query, part.query)
    if query == ANY and len(run) and not any(p.strings is None for p in parts):
        return _Part(run)
    return _Part(None, _both(query, _Part(run).asked()))


def _parsed(tree) -> _Part:
    parts = []
    for op, arg in tree:
        if op is sre.LITERAL:
            # one letter in either case may be longer in lower case, or have other forms
            parts.append(_Part({chr(arg).lower()}) if arg < 128 else _Part(None))
        elif op is sre.IN:
            chars = {chr(a) for kind, a in arg if kind is sre.LITERAL and a < 128}
            small = all(kind is sre.LITERAL and a < 128 for kind, a in arg)
            parts.append(_Part({c.lower() for c in chars}) if small else _Part(None))
        elif op is sre.SUBPATTERN:
            parts.append(_parsed(arg[3]))
        elif op is sre.BRANCH:
            choices = [_parsed(x) for x in arg[1]]
            if all(c.strings is not None for c in choices):
                parts.append(_Part(set().union(*(c.strings for c in choices))))
            else:
                parts.append(_Part(None, _absorbed(set().union(*(c.asked() for c in choices)))))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            one = _parsed(inner)
            if least == 0:
                optional = most == 1 and one.strings is not None
                parts.append(_Part(one.strings | {""}) if optional else _Part(None))
            else:
                parts += [one] * min(least, 16) + ([] if least == most <= 16 else [_Part(None)])
        elif op is sre.AT:
            parts.append(_Part({""}))
        else:
            parts.append(_Part(None))
    return _sequence(parts)


def trigram_query(pattern: str) -> list[list[str]]:
    """The alternatives of lower-case ASCII trigrams, one of which a matching text holds whole.

    An empty list means that no trigram is mandatory.
    """
    query = _parsed(_parser.parse(pattern)).asked()
    if any(not c for c in query):
        return []
    return sorted(sorted(c) for c in query)


# ---------------------------------------------------------------- index and candidates
def queries_of(spark, rules=RULES) -> DataFrame:
    """(rule, alternative, gram, needed): the trigram queries of the rules that have one."""
    rows = [(r, a, gram, len(grams)) for r, (_, pattern, _, _) in enumerate(rules)
            for a, grams in enumerate(trigram_query(pattern)) for gram in grams]
    return spark.createDataFrame(rows, "rule int, alternative int, gram string, needed int")


def postings(docs: DataFrame, key: str, text: str, grams: list[str]) -> DataFrame:
    """(gram, key): the inverted index of the texts over ``grams``."""
    low = docs.select(F.col(key).alias("key"), F.lower(text).alias("low"))
    held = F.filter(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull())
    return low.select(F.explode(held).alias("gram"), "key")


def candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(key, rules): the texts whose postings satisfy the query of a rule."""
    met = (index.join(F.broadcast(queries), "gram").groupBy("key", "rule", "alternative")
           .agg(F.count_distinct("gram").alias("held"), F.first("needed").alias("needed"))
           .filter("held = needed"))
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


# ---------------------------------------------------------------- spans
def _with_spans(rows: DataFrame, text: str, rules: tuple, wanted: list[Column]) -> DataFrame:
    """Adds __r0, __r1, ...: structs (start, end) of each rule's matches where it is wanted.

    Matches are leftmost and do not overlap; the text between two matches is what splitting
    leaves, so running lengths give the positions.  Each step is one projection for all rules.
    """
    each = range(len(rules))
    rows = rows.withColumns({f"__f{r}": wanted[r] & F.col(text).rlike(rules[r][1]) for r in each})
    ints = F.array().cast("array<int>")
    step = {}
    for r, (_, pattern, group, _) in enumerate(rules):
        found = F.col(f"__f{r}")
        step[f"__gaps{r}"] = F.when(found, F.transform(F.split(text, pattern), F.length)).otherwise(ints)
        for name, part in ((f"__hits{r}", 0), (f"__part{r}", group)):
            step[name] = F.when(found, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(part)), F.length)) \
                .otherwise(ints)
    rows = rows.withColumns(step)
    # gap and match lengths in turn: match i ends at the running sum of 2 i of them
    rows = rows.withColumns({f"__sums{r}": F.flatten(F.zip_with(
        F.slice(f"__gaps{r}", 1, F.size(f"__hits{r}")), f"__hits{r}", lambda g, h: F.array(g, h))) for r in each})
    rows = rows.withColumns({f"__sums{r}": F.when(F.size(f"__sums{r}") > 0, prefix_sum(f"__sums{r}"))
                             .otherwise(ints) for r in each})

    def spans(r: int) -> Column:
        sums, part = F.col(f"__sums{r}"), F.col(f"__part{r}")
        all_ = F.transform(part, lambda size, i: F.struct(
            F.get(sums, i * 2).alias("start"), F.get(sums, i * 2 + 1).alias("end"), size.alias("size")))
        return F.transform(F.filter(all_, lambda s: s["size"] >= rules[r][3]),
                           lambda s: F.struct(s["start"], s["end"]))
    return rows.withColumns({f"__r{r}": spans(r) for r in each})


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, spans): one row per row; spans are structs (start, rule, end, kind).

    ``rules`` are tuples (kind, pattern, group, least length of that group), in a dialect
    that Java and Python share; the rule is its place in the list.  Spans count code
    points, the end not included, and are sorted by start, then rule.  Matches of one
    rule are leftmost and do not overlap; too short ones are dropped after matching.  A
    null text is empty and has no spans; null and repeated ids and repeated rows are kept as
    they come; an empty table gives no rows; further columns are ignored.  Work on a text
    is linear in its length but for the running sums of very many matches (blocks of 128).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")) \
        .withColumn("key", F.xxhash64("doc_id", "text"))
    queries = queries_of(spark, rules)
    asked = {r: trigram_query(rule[1]) for r, rule in enumerate(rules)}
    grams = sorted({g for q in asked.values() for grams in q for g in grams})
    rows = texts.withColumn("rules", F.array().cast("array<int>"))
    if grams:
        index, chosen = scratch_path(spark, "trigram-index"), scratch_path(spark, "candidates")
        postings(texts, "key", "text", grams).write.parquet(index)
        candidates(spark.read.parquet(index), queries).write.parquet(chosen)
        # written, so that their size is known before the texts move
        rows = texts.join(spark.read.parquet(chosen), "key", "left")
    wanted = [F.coalesce(F.array_contains("rules", r), F.lit(False)) if q else F.lit(True) for r, q in asked.items()]
    rows = _with_spans(rows, "text", rules, wanted)

    def named(r: int, kind: str) -> Column:
        return F.transform(f"__r{r}", lambda s: F.struct(
            s["start"].alias("start"), F.lit(r).alias("rule"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    kinds = [named(r, rule[0]) for r, rule in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.concat(*kinds)).alias("spans"))


def joined(spans: Column) -> Column:
    """The spans as text: kind:start:end, by comma."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
